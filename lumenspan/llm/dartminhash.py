"""Near-duplicate documents by DartMinHash.

A document is a weighted set of word shingles. Darts are thrown, by hashing, into the region of each element
([0, weight) wide) along a rank axis: each unit cell of weight and rank holds a Poisson(1) number of darts with
hashed places and coordinates. The earliest dart of each coordinate is the signature: two documents agree there with
the probability of their weighted Jaccard similarity. Large sets need about one hash an element, small ones about
k ln k darts. Banded signatures give candidates, whose similarity is then computed exactly.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.components import BANDED, Combiner, near_components
from lumenspan.llm.sparkkit import cut, slices, small, texts_of
from lumenspan.llm.textkit import MIX, mix64, shingle_bags, shingle_sets

BANDS, ROWS = 32, 5
#: A working column beside those of the caller.
KEY = "__lumenspan_key"
SIGNED = "doc_id long, key long, id long, size long, bands array<long>"
#: Cumulative Poisson(1) probabilities; the rest beyond 12 is under 1e-10.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(13)])
_RANK_BITS, _EMPTY = np.uint64(24), np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(sets: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = BANDS * ROWS) -> np.ndarray:
    """A row of k 64-bit values per set of element hashes; all ones for an empty set. weights: positive, else 1."""
    out = np.full(len(sets) * k, _EMPTY)
    sizes = np.array([len(s) for s in sets], np.int64)
    total = sizes.astype(float) if weights is None else np.array([w.sum() for w in weights])
    active = np.flatnonzero(total > 0)
    low = np.zeros(len(sets))
    high = np.zeros(len(sets))
    high[active] = k * (math.log(k) + 3) / total[active]
    while len(active):
        work = np.cumsum(np.maximum(sizes[active], k * 8)) // 100_000
        for some in np.split(active, np.flatnonzero(np.diff(work)) + 1):
            _throw(out, some, sets, weights, low, high, k)
        empty = (out.reshape(-1, k)[active] == _EMPTY).any(axis=1)
        active = active[empty]
        low[active], high[active] = high[active], 2 * high[active]
    return out.reshape(len(sets), k)


def _throw(out, docs, sets, weights, low, high, k) -> None:
    """Put the darts of the given sets with ranks in [low, high) into out, the earliest per coordinate."""
    element = np.concatenate([sets[d] for d in docs])
    owner = np.repeat(docs, [len(sets[d]) for d in docs])
    weight = None if weights is None else np.concatenate([weights[d] for d in docs])
    first = np.floor(low[owner]).astype(np.int64)
    cells = np.ceil(high[owner]).astype(np.int64) - first
    wide = np.ones(len(element), np.int64) if weight is None else np.ceil(weight).astype(np.int64)
    times = cells * wide
    which = np.repeat(np.arange(len(element)), times)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    rank = first[which] + inner % cells[which]
    layer = inner // cells[which]
    seed = mix64(mix64(element[which] + rank.astype(np.uint64) * MIX) + layer.astype(np.uint64))
    darts = np.searchsorted(_POISSON, (seed >> np.uint64(11)).astype(float) * 2.0**-53, "right")
    cell = np.repeat(np.arange(len(which)), darts)
    number = np.arange(len(cell)) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = mix64(seed[cell] ^ mix64(number.astype(np.uint64) + MIX))
    place = (rank[cell].astype(np.uint64) << _RANK_BITS) | (dart & np.uint64((1 << 24) - 1))
    mine = owner[which[cell]]
    height = place.astype(float) * 2.0**-24
    good = (height >= low[mine]) & (height < high[mine])
    spot = mix64(dart)
    if weight is not None:
        across = layer[cell] + (spot >> np.uint64(40)).astype(float) * 2.0**-24
        good &= across < weight[which[cell]]
    coordinate = ((spot & np.uint64(0xFFFFFF)) * np.uint64(k) >> np.uint64(24)).astype(np.int64)
    value = (place << np.uint64(20)) | (spot >> np.uint64(24) & np.uint64(0xFFFFF))
    np.minimum.at(out, (mine * k + coordinate)[good], value[good])


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per row and band."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix64(key * MIX + parts[:, :, r])
    return key.view(np.int64)


def occurrences(items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sorted hashes of (element, k) for k up to the element's count: their plain Jaccard similarity is the weighted one
    of the counts."""
    k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.unique(mix64(np.repeat(items, counts) + k.astype(np.uint64) * MIX))


def set_id(items: np.ndarray) -> int:
    """A 64-bit id of a set of hashes; equal sets, equal ids."""
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(items).sum(dtype=np.uint64) + np.uint64(len(items))]))[0].view(np.int64))


def signed(docs: DataFrame, width: int, counted: bool = False) -> DataFrame:
    """Per row: its key, the id of its (weighted) shingle set, and the set's band keys (null where the task has given them
    before or the text has no words)."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", 500_000):
                bags = shingle_bags(texts_of(part), width) if counted else [(s, None) for s in shingle_sets(texts_of(part), width)]
                sets = [s for s, _ in bags]
                ids, fresh = [set_id(s if w is None else occurrences(s, w)) for s, w in bags], []
                for i, (own, items) in enumerate(zip(ids, sets)):
                    if own not in seen and len(items):
                        fresh.append(i)
                        if len(seen) < 100_000:
                            seen.add(own)
                weights = [bags[i][1].astype(float) for i in fresh] if counted else None
                keys = band_keys(signatures([sets[i] for i in fresh], weights)) if fresh else []
                bands: list = [None] * len(sets)
                for i, row in zip(fresh, keys):
                    bands[i] = row
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "key", "id", "size", "bands"],
                )

    return keyed(docs).mapInArrow(run, SIGNED)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("key"), text.alias("text"))


def short_sets(texts: list[str], width: int, counted: bool = False) -> list[np.ndarray]:
    """Sorted distinct 32-bit hashes of shingles, or of their occurrences."""
    sets = [occurrences(*b) for b in shingle_bags(texts, width)] if counted else shingle_sets(texts, width)
    return [np.unique((s >> np.uint64(32)).astype(np.uint32)) for s in sets]


def combined_bands(rows: DataFrame) -> DataFrame:
    """Band keys of signed rows, combined in each task."""

    def run(batches):
        combiner = Combiner()
        for batch in batches:
            bands = batch.column("bands")
            ids = np.repeat(batch.column("id").to_numpy(), np.diff(bands.offsets.to_numpy()))
            yield from combiner.add(ids, bands.flatten().to_numpy())
        yield from combiner.flush()

    return rows.where(F.col("bands").isNotNull()).select("id", "bands").mapInArrow(run, BANDED)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, counted: bool = False) -> DataFrame:
    """doc_id, class_id, class_size, kept for each row of docs (doc_id, text).

    Documents whose sets of `width`-word shingles (lower-cased words between white space) have a Jaccard similarity of
    at least threshold are linked; a class is a component of links, its class_id the least doc_id in it (null only if
    all are), and only the rows with that id are kept. A text of fewer words is one shingle; texts without words, null
    ones included, are one class. Rows of equal doc_id and text are one document. Extra columns are ignored; an empty
    table gives no rows. With counted, a shingle weighs as often as it occurs and the similarity is the weighted one,
    the sum of the lesser over that of the greater counts; without, every weight is 1."""
    rows = cut(signed(docs, width, counted))
    bands = combined_bands(rows)

    def locate(ids: DataFrame) -> DataFrame:
        mine = rows.join(small(ids), "id", "left_semi")
        return mine.groupBy("id").agg(F.min("key").alias("key"), F.max("size").alias("size"))

    def fetch(located: DataFrame) -> DataFrame:
        return keyed(docs).drop("doc_id").join(small(located), "key")

    roots = near_components(bands, locate, fetch, partial(short_sets, width=width, counted=counted), threshold)
    if roots is None:
        classed = rows.select("doc_id", "key", F.col("id").alias("class"))
    else:
        classed = rows.select("doc_id", "key", "id").join(small(roots), "id", "left").select("doc_id", "key", F.coalesce("root", "id").alias("class"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("key"))).alias("first")
    groups = classed.groupBy("class").agg(first, F.count("*").alias("class_size")).where("class_size > 1")
    groups = small(cut(groups))
    joined = classed.join(groups, "class", "left")
    return joined.select(
        "doc_id",
        "key",
        F.when(F.col("first").isNotNull(), F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.when(F.col("first").isNotNull(), F.col("first.key") == F.col("key")).otherwise(F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """docs, all columns, with one document of each class; of rows equal in doc_id and text one stays. Null and empty
    texts are one class like any other; an empty table stays empty."""
    gone = cut(near_duplicates(docs, threshold, width).select("key", "kept", "class_size"))
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    dropped = gone.where("NOT kept").select(F.col("key").alias(KEY)).distinct()
    left = docs.withColumn(KEY, key).join(small(cut(dropped)), KEY, "left_anti")
    repeats = gone.where("kept AND class_size > 1").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    if not repeats.isEmpty():
        left = left.dropDuplicates([KEY])
    return left.select(*docs.columns)
