"""The Merkle manifest against a plain recursive computation."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lumenspan.llm import merkle, queries


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    values = (row[0], row[3], row[2], row[4] if row[4] is None else row[4] + more, row[1])
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(hashes):
    """All levels from the leaves to the root."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h("".join(now[i : i + 2])) for i in range(0, len(now), 2)])
    return levels


def path_of(levels, i):
    steps = []
    for level in levels[:-1]:
        other = i ^ 1
        steps.append((level[other] if other < len(level) else "", i & 1))
        i >>= 1
    return steps


def fold(x, steps):
    for other, right in steps:
        x = h(other + x if right else x + other)
    return x


def plain(rows):
    """doc_id, leaf, subroot, root, proof, folded of every row."""
    scopes = {}
    for row in rows:
        scopes.setdefault("" if row[2] is None else "=" + row[2], []).append(row)
    names = sorted(scopes, key=lambda s: s.encode())
    trees = {}
    for s in names:
        scopes[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = climb([leaf_of(r) for r in scopes[s]])
    top = climb([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, row in enumerate(scopes[s]):
            steps = path_of(trees[s], i) + path_of(top, k)
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            out.append((row[0], trees[s][0][i], trees[s][-1][0], top[-1][0], "".join(o for o, _ in steps), fold(leaf_of(row, int(bad)), steps)))
    return out


def found(docs):
    got = merkle.check_documents(docs)
    return [tuple(r) for r in got.select("doc_id", "hash", "subroot", "root", "proof", "folded").collect()]


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]


@pytest.mark.parametrize("frame", ["real", "odd"])
def test_documents(frame, request):
    docs = request.getfixturevalue(frame)
    assert sorted(found(docs), key=repr) == sorted(plain(rows_of(docs)), key=repr)


def test_empty(empty):
    assert found(empty) == []


@pytest.mark.parametrize("sizes", [[1], [2, 1], [511, 512, 513], [1025, 3, 1100]])
def test_sizes_around_blocks(spark, sizes):
    """Lone leaves, full and just overflowing blocks, several tiers (one leaf over a power of two), null ids first."""
    rows = [(None if i == 3 else 7 * i - 50, f"t{i}", None if k == 0 else f"é{k}", "s", i if i % 5 else None) for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(found(docs), key=repr) == sorted(plain(rows), key=repr)


def test_three_tiers_and_the_stored_preimages(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    rows = [(i, f"text {i}", "en", "s", i) for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(found(docs), key=repr) == sorted(plain(rows), key=repr)
    leaves = docs.select(merkle.scope_of("lang").alias("scope"), "doc_id", merkle.digest("doc_id", "source", "lang", "n_chars", "text").alias("hash"))
    stored = merkle.manifest(merkle.forest(merkle.ranked(leaves, ["doc_id"]))).collect()
    levels = climb([leaf_of(r) for r in rows])
    expected = {(i + 1, j // 2): "".join(level[j : j + 2]) for i, level in enumerate(levels[:-1]) for j in range(0, len(level), 2)}
    assert {(r.level, r.node): r.preimage for r in stored} == expected


def test_one_scope_with_most_rows_and_one_id(spark):
    """A third of the rows have one id; all rows of one language spread over tasks."""
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 10).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(2).cast("long").alias("n_chars"))
    assert sorted(found(docs)) == sorted(plain(rows_of(docs)))


def test_tampered_rows_fail(spark):
    got = queries.QUERIES["op11_merkle"](spark, "/root/testdata/sf0.001").collect()
    for r in got:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)
