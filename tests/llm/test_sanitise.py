import hashlib
import re
import time
from collections import Counter, defaultdict
from math import log2

import pytest
import regex
from pyspark.sql import functions as F

from lumenspan.llm import sanitise
from lumenspan.llm.queries import op10_sanitise
from tests.llm.conftest import SF

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def good(kind, match):
    d = re.sub(r"[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 10 <= len(d) <= 15


def brute(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if good(kind, m[0])]
    return [(kind, s, e) for s, _, e, kind in sorted(found)]


def check(text, r):
    want = brute(text)
    assert [r[f"n_{k}"] for k in PLAIN] == [sum(w[0] == k for w in want) for k in PLAIN]
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
    assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (text[:200], joined, r["spans"])
    assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op10_sanitise(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        check(docs[r["doc_id"]], r)
    assert sum(r["n_card"] + r["n_ip"] for r in got) > 0


TRICKY = [
    "a@b.c_d@e.f x@y x@@y.z a.b+c%d@e-f.g.h.", "é@b.com 🙂a@b.co", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 1.2.3", "9.9.9.99999999999999999999",
    "4111 1111 1111 1111 and 4111-1111-1111-1111 41111111111111111", "4111 1111 1111 1111 1", "4111  1111", "12 4111111111111111", "+1 (988) 555-2485 +12 +123456789012345678 ++1 2345678901",
    "+1.234.567.8901.4111111111111111", "0" * 14, "0" * 19, "0" * 20, "5 " * 14, "1-" * 40, "a" * 3000, "x@" * 200, "1." * 500, "+1" * 100, "a@b.c-d@e.f", "", None,
]


def test_tricky_texts(spark, odd, empty):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    docs.createOrReplaceTempView("tricky")
    found = sanitise.find(docs)
    rows = {r["doc_id"]: [(sanitise.KINDS[s["rank"]], s["start"], s["end"]) for s in r["base"]] for r in found.collect()}
    for i, text in enumerate(TRICKY):
        assert rows[i] == brute(text or ""), text
    assert sanitise.find(odd).count() == odd.count() and sanitise.find(empty).count() == 0
    clean = sanitise.sanitise(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count() and sanitise.sanitise(empty).count() == 0


def story():
    """An address that a rare nickname gives away, in several contexts, among documents that do not have it."""
    names = ["Monday", "garden", "letter", "window", "silver"]
    rows = [(i, f"The {names[i]} note went to quillfeather at qf@mail.example.com before the {names[-i]} came.") for i in range(5)]
    rows += [(10 + i, f"The note went out before the {n} came, nothing else at all {i}.") for i, n in enumerate(names * 10)]
    rows += [(100 + i, "A copied page says write to someone special at copy@mail.example.com now.") for i in range(30)]
    return rows


def test_disclosing_terms(spark):
    docs = spark.createDataFrame(story(), "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r["doc_id"]: r for r in sanitise.find(docs).collect()}
    text = dict(story())
    terms = {i: {text[i][e["start"] : e["end"]] for e in r["extra"]} for i, r in got.items()}
    assert all(terms[i] == {"quillfeather"} for i in range(5))
    assert not any(terms[i] for i in range(10, 60)) and not any(terms[i] for i in range(100, 130))
    clean = {r["doc_id"]: r for r in sanitise.sanitise(docs).collect()}
    assert all("quillfeather" not in clean[i]["text"] and "[EMAIL]" in clean[i]["text"] and len(clean[i]["text"]) == clean[i]["n_chars"] for i in range(5))
    assert clean[0]["text"] == "The Monday note went to  at [EMAIL] before the Monday came."
    assert all(clean[i]["text"] == text[i] for i in range(10, 60))


TERM = regex.compile(sanitise.TERM)


def blanked(text):
    """The text with base spans blanked, kind by kind."""
    for kind in ("email", "phone", "card", "ip"):
        text = re.sub(PLAIN[kind], lambda m, k=kind: "\ufdd0" * len(m[0]) if good(k, m[0]) else m[0], text)
    return text


def brute_terms(docs, min_contexts=3, share=0.9):
    """Disclosing terms by the formula, over sets of distinct texts."""
    texts = sorted({t or "" for t in docs})
    may = lambda w: len(w) > 2 or regex.search(r"[\p{Lu}\p{Lo}\p{N}]", w)
    words = [set(w.lower() for w in TERM.findall(blanked(t))) for t in texts]
    able = [set(w.lower() for w in TERM.findall(blanked(t)) if may(w)) for t in texts]
    df = Counter(w for ws in words for w in ws)
    owners, windows, beside = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, text in enumerate(texts):
        for kind, pattern in PLAIN.items():
            found = list(re.finditer(pattern, text))
            for k, m in enumerate(found):
                if not good(kind, m[0]):
                    continue
                left = text[found[k - 1].end() if k else 0 : m.start()]
                right = text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)]
                near, e = TERM.findall(left)[-5:] + TERM.findall(right)[:5], (kind, m[0].lower())
                window = " ".join(near).lower()
                owners[e].add(i)
                windows[e].add(window)
                for w in near:
                    if may(w):
                        beside[e, w.lower()].add(window)
    out = {}
    for e, mine in owners.items():
        if max(len(mine), len(windows[e])) < min_contexts:
            continue
        n, m = max(len(texts), len(mine) + 1), len(mine)
        for t in set().union(*(able[i] for i in mine)):
            both = sum(t in able[i] for i in mine)
            if both >= min_contexts or len(beside.get((e, t), ())) >= min_contexts:
                ratio = log2(both / max(df[t], both) * n / m) / log2(n / m)
                if ratio >= share:
                    out[t] = max(out.get(t, 0), ratio)
    return out


@pytest.mark.parametrize("share", [0.9, 0.4])
def test_terms_equal_brute_force(spark, share):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = rows.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in story()], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    want = brute_terms(texts.values(), share=share)
    guilty = {r["term"]: r["ratio"] for r in sanitise.guilty_terms(rows, 3, share).collect()}
    assert guilty.keys() == want.keys() and len(want) >= 1
    assert all(guilty[t] == pytest.approx(want[t]) for t in want)
    for r in sanitise.find(rows, share=share).collect():
        text = blanked(texts[r["doc_id"]] or "")
        assert [(e["start"], e["end"]) for e in r["extra"]] == [m.span() for m in TERM.finditer(text) if m[0].lower() in want]


def test_many_matches_in_one_text(spark):
    """A log of addresses: linear work in the matches of one text."""
    text = "\n".join(f"host {i % 256}.{i // 256 % 256}.7.9 says word{i}" for i in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, "plain")], "doc_id long, text string")
    began = time.perf_counter()
    found = sanitise.with_spans(docs).where("doc_id = 1").select("base").first()["base"]
    assert time.perf_counter() - began < 10
    assert len(found) == 100_000 and [(s["start"], s["end"]) for s in found] == [m.span() for m in re.finditer(PLAIN["ip"], text)]
    clean = {r["doc_id"]: r["text"] for r in sanitise.sanitise(docs).collect()}
    assert clean[2] == "plain" and clean[1].count("[IP]") == 100_000 and not re.search(PLAIN["ip"], clean[1])


def test_many_entities_in_three_texts(spark):
    """Three versions of a log: entities and words of the same texts are counted as one."""
    n = 20_000
    line = lambda v: "\n".join(f"u{i}q@h{i}.example.org says zw{i}x" for i in range(n)) + f"\nversion {v} ends\nonly{v}here mail v{v}@h.example.org"
    rows = [(v, line(v)) for v in range(3)] + [(10 + i, f"plain text number {i}") for i in range(50)]
    began = time.perf_counter()
    guilty = {r["term"]: r["ratio"] for r in sanitise.guilty_terms(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.9).collect()}
    assert time.perf_counter() - began < 120
    assert set(guilty) >= {f"zw{i}x" for i in range(n)} and all(guilty[f"zw{i}x"] == pytest.approx(1.0) for i in range(0, n, 999))
    assert not any(f"only{v}here" in guilty for v in range(3)) and "plain" not in guilty


@pytest.mark.parametrize("share", [0.9, 0.5])
def test_terms_of_random_texts(spark, share):
    """Many entities and words that stand in the same, in overlapping and in different texts, with copies."""
    import random

    rng = random.Random(7)
    texts = []
    for i in range(120):
        words = [f"w{rng.randrange(40)}x" for _ in range(rng.randrange(3, 14))]
        texts.append(" ".join([*words, *(f"p{k}@mail.example.com tok{k}y" for k in rng.sample(range(12), rng.randrange(0, 4)))]))
    texts += texts[:20] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_terms(texts, share=share)
    guilty = {r["term"]: r["ratio"] for r in sanitise.guilty_terms(docs, 3, share).collect()}
    assert guilty.keys() == want.keys() and want
    assert all(guilty[t] == pytest.approx(want[t]) for t in want)


def test_copies_do_not_hide_a_term(spark):
    """One of three disclosing documents a thousand times; copies of another text do not make its plain words disclosing."""
    texts = [f"The {x} note went to quillfeather at qf@mail.example.com before the {x} came." for x in ("garden", "letter", "window")]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[0]) for i in range(1000)]
    rows += [(5000 + i, f"The note went out before day number {i} came.") for i in range(500)]
    got = {r["doc_id"]: r for r in sanitise.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    for i, r in got.items():
        terms = {text[i][e["start"] : e["end"]] for e in r["extra"]}
        assert terms == ({"quillfeather"} if i < 5000 else set()), (i, terms)


def test_terms_of_the_whole_text(spark):
    """Far from the mention, two-character names, identifiers, a text without the value, every occurrence."""
    far = "as plain words that say nothing much about who wrote it all"
    texts = [f"AB-7731x and Wu and 李明, then {far} day {x}: mail qf@mail.example.com now, {far}, says Quillfeather, quillfeather" for x in ("one", "two", "three", "four")]
    alone = "Quillfeather was seen here."
    rows = list(enumerate([*texts, alone])) + [(100 + i, f"{far} mail now, says day then and {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    got = {r["doc_id"]: [text[r["doc_id"]][e["start"] : e["end"]] for e in r["extra"]] for r in sanitise.find(docs).collect()}
    assert all(got[i] == ["AB-7731x", "Wu", "李明", "Quillfeather", "quillfeather"] for i in range(4)), got[0]
    assert got[4] == ["Quillfeather"] and not any(got[i] for i in range(100, 400))
    clean = {r["doc_id"]: r["text"] for r in sanitise.sanitise(docs).collect()}
    assert clean[4] == "[TERM] was seen here." and "Wu" not in clean[0] and "李明" not in clean[0]
    assert all(clean[i] == text[i] for i in range(100, 400))
