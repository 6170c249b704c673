import random
import re
from collections import Counter
from itertools import chain, combinations

from pyspark.sql import functions as F

from lumenspan.llm import urlrules
from lumenspan.llm.queries import URL_RULES, op3_url_rules
from tests.llm.conftest import SF


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lower, re.match(r"[^?#]*", rest[len(host) :])[0]


def listed(host, path):
    fits = [(len(h + p), h + p, a) for h, p, a in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_query(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op3_url_rules(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path = host_path(pages[r["page_id"]])
        rule, action = listed(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") if rule is None else r["verdict"] == action


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.com", "http://Example.COM/en/x?q#f", "https://www.example.com/en/", "x://a.net/es/1", "x://net/fr/", "x://fooexample.com/en/",
    "x://a.b.example.com/en/y", "x://a.net#/es/", "x://a.net/de?/es/", "mailto:x@y", "x://É.com/ü", "x://a.com/\n/en", "x://a.net/es/1",
]


def test_odd_urls(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, "x://q.net/es/")], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("key", F.lit("k"))
    rules = spark.createDataFrame([*URL_RULES, URL_RULES[0], (None, "/", "block")], "host string, path string, action string")
    labels = spark.createDataFrame([], "url string, block boolean")
    got = {r["page_id"]: r for r in urlrules.judge_pages(spark, pages, rules, labels).collect()}
    assert len(got) == len(URLS) + 1 and got[None]["verdict"] == "block"
    for i, u in enumerate(URLS):
        host, path = host_path(u)
        rule, action = listed(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, action or "allow"), u
    assert urlrules.judge_pages(spark, pages.limit(0), rules, labels).count() == 0


def test_mined_rules_match_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        host, path = rng.choice(["ads.x.org", "m.x.org", "y.org"]), rng.choice(["/win/", "/news/", "/a/"])
        bad = (host.startswith("ads") and path == "/win/") or rng.random() < 0.03
        rows.append((f"http://{host}{path}{i}", bad if i % 3 else None))
    frame = spark.createDataFrame(rows, "url string, block boolean")
    host, path = urlrules.host_and_path(F.col("url"))
    baskets = frame.select(urlrules.tokens(host, path).alias("tokens"), "block")
    mined = {tuple(sorted(r["antecedent"])): r for r in urlrules.mine(baskets).collect()}
    sets = [(set(r["tokens"]), r["block"]) for r in baskets.collect() if r["block"] is not None]
    assert mined
    for tokens, r in mined.items():
        over = [b for t, b in sets if t >= set(tokens)]
        assert r["confidence"] == sum(over) / len(over) >= 0.8 and sum(over) >= 20
        assert not any(set(other) < set(tokens) for other in mined)
    assert any({"h:ads.x.org", "p:win"} == set(t) for t in mined)
    pages = spark.createDataFrame([(1, "http://ads.x.org/win/7"), (2, "http://ads.x.org/news/7"), (3, "http://y.org/win/7")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, action string")
    got = {r["page_id"]: r["verdict"] for r in urlrules.judge_pages(spark, pages, rules, frame).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def test_clashing_columns_and_empty_tables(spark):
    """Columns that the operator uses itself, none of them read; no pages, no labels, no rules."""
    plain = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, "http://a.net/es/1"), (3, URLS[3])], "page_id long, url string")
    clash = plain
    for name in ("key", "host", "path", "tokens", "rule", "action", "suffix", "prefix", "best", "verdict", "confidence", "rule_id"):
        clash = clash.withColumn(name, F.lit(f"x{name}"))
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    labels = spark.createDataFrame([], "url string, block boolean")
    sort = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    want = sort(urlrules.judge_pages(spark, plain, rules, labels))
    assert sort(urlrules.judge_pages(spark, clash, rules.withColumn("n", F.lit("x")), labels.withColumn("tokens", F.lit("x")))) == want and len(want) == len(URLS) + 2
    assert urlrules.judge_pages(spark, plain.limit(0), rules, labels).count() == 0
    none = urlrules.judge_pages(spark, plain, rules.limit(0), labels).collect()
    assert {(r["rule"], r["verdict"]) for r in none} == {(None, "allow")}


def minimal_rules(sets, least, share=0.8):
    """Rules by counting every subset of every url's tokens."""
    seen, bad = Counter(), Counter()
    for tokens, block in sets:
        for part in chain.from_iterable(combinations(sorted(tokens), k) for k in range(1, len(tokens) + 1)):
            seen[part] += 1
            bad[part] += block
    strong = {p: bad[p] / seen[p] for p in seen if bad[p] >= least and bad[p] / seen[p] >= share}
    return {p: c for p, c in strong.items() if not any(set(o) < set(p) for o in strong)}


def test_rules_equal_every_subset_counted(spark):
    """Nested domains, tokens that always stand together, rules of a domain and a path, a path alone, two paths."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        host = rng.choice(["a.m.x.org", "b.m.x.org", "x.org", "s.lone.net", "y.com"])
        path = [p for p in ("en", "win", "go", "deal") if rng.random() < 0.5] + (["cgi", "bin"] if rng.random() < 0.3 else [])
        bad = ("m.x" in host and "win" in path) or ("cgi" in path and "go" in path) or host.startswith("s.lone") or rng.random() < 0.05
        rows.append((f"http://{host}/{'/'.join(path)}/{'abcdefgh'[i % 8]}", bad))
    frame = spark.createDataFrame(rows, "url string, block boolean")
    host, path = urlrules.host_and_path(F.col("url"))
    baskets = frame.select(urlrules.tokens(host, path).alias("tokens"), "block")
    want = minimal_rules([(r["tokens"], r["block"]) for r in baskets.collect()], 20)
    got = urlrules.mine(baskets).collect()
    assert {tuple(sorted(r["antecedent"])): r["confidence"] for r in got} == want and len(got) == len(want)
    assert {("h:s.lone.net",), ("h:lone.net",), ("p:bin", "p:go"), ("p:cgi", "p:go"), ("h:m.x.org", "p:win")} <= want.keys()


def test_deep_urls_do_not_list_their_subsets(spark):
    """A host of six labels over a path of forty segments, all frequent: 2^46 sets of tokens, but 45 rules (org is not only theirs)."""
    deep = "http://a.b.c.d.trap.org/" + "/".join(chr(97 + i // 26) + chr(97 + i % 26) for i in range(40))
    rows = [(deep, True)] * 30 + [(f"http://fine.org/{i}", False) for i in range(70)]
    frame = spark.createDataFrame(rows, "url string, block boolean")
    host, path = urlrules.host_and_path(F.col("url"))
    got = urlrules.mine(frame.select(urlrules.tokens(host, path).alias("tokens"), "block")).collect()
    assert all(len(r["antecedent"]) == 1 and r["confidence"] == 1 for r in got)
    assert {r["antecedent"][0] for r in got} == {f"p:{s}" for s in deep.split("/")[3:]} | {f"h:{d}" for d in ("a.b.c.d.trap.org", "b.c.d.trap.org", "c.d.trap.org", "d.trap.org", "trap.org")}
