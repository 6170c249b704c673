"""Exact dedup against grouping in Python; the codes and the exchange on their own."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.llm import exactdedup


def plain(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is not None, doc_id or 0, doc_id))
    out = []
    for bare, members in groups.items():
        members.sort()
        sha = hashlib.sha256(bare.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), i == 0, sha) for i, m in enumerate(members)]
    return out


def check(docs):
    got = [tuple(r) for r in exactdedup.duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=repr) == sorted(plain([tuple(r) for r in docs.select("doc_id", "text").collect()]), key=repr)


@pytest.mark.parametrize("frame", ["real", "odd", "empty"])
def test_documents(frame, request):
    check(request.getfixturevalue(frame))


def test_spaces_lengths_and_ids(spark):
    """White space alone differs; no-break spaces count; longest first, then least id, null ids before all; repeated rows."""
    rows = [(5, "a b"), (3, "ab"), (4, "a\tb"), (None, "a\nb"), (9, "a b"), (1, " "), (2, None), (8, ""), (7, "x"), (7, "x"), (6, "x "), (6, "x "), (10, "\x0ba\x0cb\r"), (11, "\x1fab")]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_a_third_of_all_rows_is_one_text(spark):
    docs = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot text " * 50)).otherwise(F.concat(F.lit("t"), (F.col("id") % 1500).cast("string"))).alias("text"))
    check(docs.withColumnRenamed("id", "doc_id").repartition(7))


def test_many_senders_and_owners(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "RUN_BITS", 4)
    monkeypatch.setattr(exactdedup, "OWNED", 20)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.pmod(F.hash("id"), F.lit(1500))).alias("text"))
    check(docs)


@pytest.mark.parametrize("bits", [0, 1, 5, 12])
def test_codes_round_trip(bits):
    rng = random.Random(bits)
    span = 1 << (64 - bits)
    for n in (0, 1, 2, 100, 3000):
        base = rng.randrange(1 << bits) * span
        values = sorted({base + rng.randrange(span) for _ in range(n)} | ({base, base + span - 1} if n > 50 else set()))
        ordered = np.array(values, np.uint64)
        k, codes = exactdedup.rice(ordered, base, span)
        assert exactdedup.unrice(codes, k, len(ordered), base).tolist() == values
        if n >= 100:
            assert len(codes) * 8 <= len(values) * (np.log2(span / len(values)) + 3) + 64


def test_a_fingerprint_shared_by_two_texts_is_only_a_suspicion(spark, tmp_path):
    """Rows with one fingerprint and different digests: both suspects; digests differ, so nothing is dropped."""
    rows = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 1), (2, "d", 2), (-1, "e", 2), (-1, "f", 2)], "print long, sha string, sender long")
    got = {r.sha: r.suspect for r in exactdedup.marked(exactdedup.cut(rows)).collect()}
    assert got == {"a": True, "b": True, "c": True, "d": True, "e": True, "f": True}
    lone = spark.createDataFrame([(5, "a", 0), (6, "b", 0), (5, "c", 1), (-9, "d", 1)], "print long, sha string, sender long")
    assert {r.sha: r.suspect for r in exactdedup.marked(exactdedup.cut(lone)).collect()} == {"a": True, "b": False, "c": True, "d": False}
