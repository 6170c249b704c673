"""Fill-in-the-middle against a plain computation, by code points and by words."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lumenspan.llm import fim

WORDS = r"\s*\S+"


def plain(doc_id, text, unit=fim.UNIT, seed=1, rate=90):
    text = text or ""
    ends = [m.end() for m in re.finditer(f"(?s)(?:{unit}|.)", text)]
    n = len(ends)
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, q = [0, *ends][a], [0, *ends][b]
    if h[3] % 100 < 20:
        return n, "spm", p, q - p, f"<S>{text[q:]}<P>{text[:p]}<M>{text[p:q]}"
    return n, "psm", p, q - p, f"<P>{text[:p]}<S>{text[q:]}<M>{text[p:q]}"


def check(docs, **options):
    made = fim.transform(docs, **options)
    got = made.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored().alias("back")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r)[2:7] == plain(r.doc_id, r.text, options.get("unit", fim.UNIT), options.get("seed", 1), options.get("fim_percent", 90))
        assert r.back == (r.text or "")
    return got


@pytest.mark.parametrize("frame", ["real", "odd"])
@pytest.mark.parametrize("options", [{}, {"block": 3, "seed": 5}, {"unit": WORDS, "block": 4, "fim_percent": 100}])
def test_documents(frame, options, request):
    docs = request.getfixturevalue(frame)
    got = check(docs, **options)
    if frame == "real":
        assert {r.form for r in got} >= {"psm", "spm"}


def test_columns_stay(odd):
    made = fim.transform(odd)
    assert set(odd.columns) | {"form", "prefix_chars", "middle_chars", "output"} == set(made.columns)
    assert made.where("key <> 'xkey' OR block <> 'xblock' OR length <> 'xlength'").count() == 0


def test_edges(spark):
    """Sentinels in texts, texts of one unit, astral characters, block edges, ends that look like a sentinel's beginning."""
    texts = ["", None, "a", "<P>", "x<S>y", "x<M", "<<P", "🙂" * 1024, "🙂a" * 1024, "ab\r\n" * 700, "<P<S<M" * 300, "é" * 50, " " * 2049]
    rows = [(k * 100 + j if k else None, t) for k in range(12) for j, t in enumerate(texts)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))
    check(spark.createDataFrame(rows, "doc_id long, text string"), unit=r"[a-z]+", block=2)


def test_empty_table(empty):
    assert fim.transform(empty).count() == 0


def test_one_id_and_text_in_a_third_of_all_rows(spark):
    docs = spark.range(900).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same " * 500)).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    check(docs)


def test_sentinels_that_could_not_be_found(spark, empty):
    with pytest.raises(ValueError):
        fim.transform(empty, sentinels=("<<", "<S>", "<M>"))
