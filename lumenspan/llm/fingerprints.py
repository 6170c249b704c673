"""Document fingerprints from prefix polynomial hashes.

Modular prefix arrays give the hash of any span in constant time: the texts of a batch share one pair of arrays
(two bases modulo the prime 2**31 - 1), from which spans at different places compare equal exactly when their
text is equal, up to a collision chance of about 2**-60. A fingerprint keeps a text's length, its whole hash and
its prefix arrays from either end on a grid; grids of different texts nest, so two fingerprints answer whether any two
spans between grid points are equal, and their longest common extensions are found by binary search.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import accumulate
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm.sparkkit import partitions

PRIME = np.uint64((1 << 31) - 1)
BASES = (1_000_003, 911_382_323)
GRID = 32
PAIRED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


class _Powers:
    def __init__(self, base: int):
        p = int(PRIME)
        self.steps, self.tables = (base % p, pow(base, -1, p)), [np.ones(1, np.uint64)] * 2

    def upto(self, n: int) -> list[np.ndarray]:
        for which, step in enumerate(self.steps):
            table = self.tables[which]
            while len(table) < n:
                table = np.concatenate([table, table * np.uint64(pow(step, len(table), int(PRIME))) % PRIME])
            self.tables[which] = table
        return [t[:n] for t in self.tables]


_powers = [_Powers(b) for b in BASES]


class PrefixHashes:
    """Span equality and longest common extensions over one flat array of code points."""

    def __init__(self, codes: np.ndarray):
        values, self.prefix, self.shift = codes.astype(np.uint64) + np.uint64(1), [], []
        for powers in _powers:
            up, down = powers.upto(len(codes) + 1)
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(values * up[:-1] % PRIME, out=sums[1:])
            self.prefix.append(sums % PRIME)
            self.shift.append(down)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans [start, end); equal text, equal hash, wherever it stands."""
        a, b = ((h[end] + PRIME - h[start]) % PRIME * s[start] % PRIME for h, s in zip(self.prefix, self.shift))
        return a << np.uint64(31) | b

    def extension(self, i: int, j: int, most: int) -> int:
        """Length, up to `most`, of the longest common extension to the right of positions i and j."""
        same = lambda n: self.spans(np.array([i]), np.array([i + n]))[0] == self.spans(np.array([j]), np.array([j + n]))[0]
        low, high = 0, most
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if same(mid) else (low, mid - 1)
        return low


def grid_step(n: int) -> int:
    """The least power of two that cuts n characters into at most GRID steps."""
    step = 1
    while n > GRID * step:
        step *= 2
    return step


def fingerprints(texts: list[str]) -> list[str]:
    """length.whole.prefixes.suffixes in hexadecimal, 16 digits a hash."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    hashes, at, starts, ends, shape = PrefixHashes(codes), 0, [], [], []
    for text in texts:
        n = len(text)
        marks = np.arange(1, n // (step := grid_step(n)) + 1) * step
        k = len(marks)
        starts += [np.array([at]), np.full(k, at), at + n - marks]
        ends += [np.array([at + n]), at + marks, np.full(k, at + n)]
        shape.append((n, k))
        at += n
    if not texts:
        return []
    found = hashes.spans(np.concatenate(starts).astype(np.int64), np.concatenate(ends).astype(np.int64))
    digits, out, at = found.astype(">u8").tobytes().hex(), [], 0
    for n, k in shape:
        whole, mid, end = at + 16, at + 16 + 16 * k, at + 16 + 32 * k
        out.append(f"{n:x}.{digits[at:whole]}.{digits[whole:mid]}.{digits[mid:end]}")
        at = end
    return out


def differences(a: str, b: str, step: int, own: tuple[int, int], suffix: bool) -> list[tuple[int, int]]:
    """Prefix arrays of a minus those of b at every `step` characters, from either end: two entries are equal exactly
    when the texts are between them. a, b: hexadecimal hashes at steps own[0] and own[1]."""
    x, y = ([int(side[at : at + 16], 16) for at in range(16 * (step // size - 1), len(side), 16 * (step // size))] for side, size in zip((a, b), own))
    shrink = [pow(base, -step, int(PRIME)) if suffix else 1 for base in BASES]
    out, scale, low = [(0, 0)], [1, 1], (1 << 31) - 1
    for p, q in zip(x, y):
        # A suffix hash begins at its own first character; scaled, all begin at the text's end.
        scale = [c * s % int(PRIME) for c, s in zip(scale, shrink)]
        out.append(tuple((u - v) * c % int(PRIME) for u, v, c in zip((p >> 31, p & low), (q >> 31, q & low), scale)))
    return out


def matched(entries: list[tuple[int, int]]) -> list[bool]:
    """Which steps are equal: each longest common extension is found by binary search, and the step after it differs."""
    out: list[bool] = []
    last = len(entries) - 1
    while len(out) < last:
        i = len(out)
        if entries[i + 1] == entries[i]:
            end = bisect_left(range(i + 1, last + 1), True, key=lambda j: entries[j] != entries[i])  # noqa: B023
            out += [True] * end
        if len(out) < last:
            out.append(False)
    return out


def likeness(a: str, b: str) -> float:
    """Share of the longer text that both texts have at the same distance from the beginning or, behind some point, from
    the end, as far as the grids tell; 1 for equal texts only. So it sees edits anywhere, and one insertion or deletion."""
    (na, whole_a, *sides_a), (nb, whole_b, *sides_b) = a.split("."), b.split(".")
    na, nb = int(na, 16), int(nb, 16)
    if na == nb and whole_a == whole_b:
        return 1.0
    if not na or not nb:
        return 0.0
    own = grid_step(na), grid_step(nb)
    step = max(own)
    left, right = (matched(differences(x, y, step, own, suffix)) for x, y, suffix in zip(sides_a, sides_b, (False, True)))
    before, after = list(accumulate(left, initial=0)), list(accumulate(right, initial=0))
    covered = step * max(map(add, before, reversed(after)))
    return min(covered, na, nb, max(na, nb) - 1) / max(na, nb)


def edited(text: str, following: str) -> str:
    """The last third (floor) of text replaced by as many first characters of the following text, or all."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def with_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs dealt into ranges of doc_id, sorted from the highest down within each, with the first document of the
    next range at the end (helper = true), so that every document's successor is the row after it.

    Order: doc_id descending, null last, then text descending; after the last comes the first. The ranges' bounds
    are quantiles over all ids, at most four a shuffle partition, so no task sees more than its range. Rows of one
    doc_id, null included, share a range, since their order needs their texts; ids are meant to be keys."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    held = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = min(2000, 4 * partitions(spark))
    quantiles = F.percentile_approx("key", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(10_000)) if n > 1 else F.array().cast("array<long>")
    bounds = sorted(set(held.agg(quantiles.alias("q")).first()["q"] or []))
    block = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<long>"), lambda x: x < F.col("key")))
    held = held.withColumn("block", block)
    tops = {r["block"]: r["top"] for r in held.groupBy("block").agg(F.max("key").alias("top")).collect()}  # <= n rows
    order = sorted(tops)
    helps = {tops[b]: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    if not helps:
        return held.withColumn("helper", F.lit(False))
    table = F.create_map(*[F.lit(x) for pair in helps.items() for x in pair])
    homes = F.array(F.struct(F.col("block"), F.lit(False).alias("helper")))
    both = F.when(F.col("key").isin(list(helps)), F.concat(homes, F.array(F.struct(table[F.col("key")].alias("block"), F.lit(True).alias("helper"))))).otherwise(homes)
    dealt = held.select("key", "doc_id", "text", F.explode(both).alias("home")).select("key", "doc_id", "text", "home.*")
    rank = [F.col("block"), F.col("helper"), F.col("key").desc(), F.coalesce("text", F.lit("")).desc()]
    return dealt.repartition(n, "block").sortWithinPartitions(*rank).select("block", "helper", "doc_id", "text")


def fingerprint_documents(spark: SparkSession, docs: DataFrame, max_chars: int = 500_000) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likenesses to each other and to the next
    document. A null text is empty; repeated rows follow one another; one row is its own next; an empty table
    gives no rows; extra columns are ignored."""

    def emit(rows):
        texts = [r[3] for r in rows]
        marks = fingerprints(texts)
        mine = [i for i, r in enumerate(rows) if not r[1] and i + 1 < len(rows) and rows[i + 1][0] == r[0]]
        changed = [edited(texts[i], texts[i + 1]) for i in mine]
        after = fingerprints(changed)
        columns = [
            pa.array([rows[i][2] for i in mine], pa.int64()),
            pa.array([len(texts[i]) for i in mine], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([marks[i] for i in mine], pa.string()),
            pa.array(after, pa.string()),
            pa.array([likeness(marks[i], f) for i, f in zip(mine, after)], pa.float64()),
            pa.array([likeness(marks[i], marks[i + 1]) for i in mine], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PAIRED.split(", ")])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            block, helper, doc_id, text = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                row = (block[i].as_py(), helper[i].as_py(), doc_id[i].as_py(), text[i].as_py() or "")
                rows.append(row)
                size += len(row[3])
                if size > max_chars and len(rows) > 1:
                    yield emit(rows)
                    rows, size = rows[-1:], len(row[3])
        if len(rows) > 1:
            yield emit(rows)

    return with_next(spark, docs).mapInArrow(run, PAIRED)
