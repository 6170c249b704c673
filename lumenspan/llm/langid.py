"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in NumPy.

A text's letters (lower-cased, other characters cut words) give subwords of 2 to 4 characters within words; each
hashes to an embedding, their average goes through one linear layer. For prediction both layers fold into one
table of logits per bucket. A temperature is fitted on held-out training rows; predictions under a confidence
that those rows justify are rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.sparkkit import slices, texts_of

WIDTHS = (2, 3, 4)
BITS = 15
#: Bytes of text whose subwords are in memory at once.
SLICE = 250_000
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
_breaks = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logits: np.ndarray  # a row per bucket, a column per language
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of all texts, text by text, and each text's number of them."""
    plain = [f" {_breaks.sub(' ', t.lower()).strip()} " for t in texts]
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in plain])
    blank = codes == 32
    buckets, owners = [], []
    for width in WIDTHS:
        n = len(codes) - width + 1
        if n < 1:
            continue
        h, good = np.full(n, width, np.uint32), owner[:n] == owner[width - 1 :]
        for k in range(width):
            h = h * np.uint32(0x01000193) ^ codes[k : k + n]
            h = h * np.uint32(0x9E3779B1)
            if 0 < k < width - 1:
                good &= ~blank[k : k + n]
        if width == 2:
            good &= ~(blank[:n] & blank[1:])
        h ^= h >> np.uint32(15)
        buckets.append((h[good] * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS))
        owners.append(owner[:n][good])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    bucket, whose = np.concatenate(buckets).astype(np.int64), np.concatenate(owners)
    order = np.argsort(whose, kind="stable")
    return bucket[order], np.bincount(whose, minlength=len(texts))


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), values.shape[1]))
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full], axis=0, dtype=np.float64)
    return out


def scores(model: Model, texts: list[str]) -> np.ndarray:
    """Calibrated probabilities, a row per text and a column per language."""
    bucket, counts = subwords(texts)
    z = segment_sums(model.logits[bucket], counts) / np.maximum(counts, 1)[:, None] + model.bias
    return softmax(z / model.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


Bag = tuple[np.ndarray, np.ndarray]


def bags_of(texts: list[str]) -> list[Bag]:
    """Each whole text's distinct buckets and their shares of its subwords: at most 2**BITS numbers, however long."""
    bucket, counts = subwords(texts)
    out = []
    for mine in np.split(bucket, np.cumsum(counts)[:-1]):
        found, times = np.unique(mine, return_counts=True)
        out.append((found, (times / max(len(mine), 1)).astype(np.float32)))
    return out


def averages(table: np.ndarray, bags: list[Bag]) -> np.ndarray:
    """The average of table over each bag's subwords."""
    bucket, share = np.concatenate([b for b, _ in bags]), np.concatenate([s for _, s in bags])
    return segment_sums(table[bucket] * share[:, None], np.array([len(b) for b, _ in bags]))


def sgd(bags: list[Bag], target: np.ndarray, languages: int, dim: int = 12, epochs: int = 12, rate: float = 20.0, batch: int = 32):
    """Embeddings, weights and biases of the averaged-embedding softmax, by stochastic gradient descent."""
    random = np.random.default_rng(7)
    embed = random.normal(0, 0.1, (1 << BITS, dim)).astype(np.float32)
    weight, bias = random.normal(0, 0.1, (dim, languages)), np.zeros(languages)
    rows = np.array([i for i, (b, _) in enumerate(bags) if len(b)], dtype=int)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        random.shuffle(rows)
        for at in range(0, len(rows), batch):
            mine = rows[at : at + batch]
            some = [bags[i] for i in mine]
            hidden = averages(embed, some)
            error = softmax(hidden @ weight + bias)
            error[np.arange(len(mine)), target[mine]] -= 1
            error /= len(mine)
            back = (error @ weight.T).astype(np.float32)
            weight -= step * hidden.T @ error
            bias -= 0.1 * step * error.sum(axis=0)
            bucket, share = np.concatenate([b for b, _ in some]), np.concatenate([s for _, s in some])
            np.subtract.at(embed, bucket, step * np.repeat(back, [len(b) for b, _ in some], axis=0) * share[:, None])
    return embed, weight, bias


def train(bags: list[Bag], labels: list[str], accuracy: float = 0.98, most: float = 0.02) -> Model:
    """Fit on labelled bags; every fifth calibrates instead."""
    languages = tuple(sorted(set(labels)))
    if not languages:
        return Model((), np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    target = np.array([languages.index(x) for x in labels])
    held = np.arange(len(bags)) % 5 == 4
    fitted = [b for b, h in zip(bags, held) if not h]
    embed, weight, bias = sgd(fitted, target[~held], len(languages))
    model = Model(languages, (embed @ weight).astype(np.float32), bias)
    return calibrated(model, [b for b, h in zip(bags, held) if h], target[held], accuracy, most)


def calibrated(model: Model, bags: list[Bag], target: np.ndarray, accuracy: float, most: float) -> Model:
    """The temperature with the least held-out loss; the lowest confidence from which predictions are right as often
    as `accuracy`, but never one that turns away over a share of `most` of the held-out rows."""
    if not bags:
        return model
    z = averages(model.logits, bags) + model.bias
    row = np.arange(len(target))
    loss = lambda t: -np.log(np.maximum(softmax(z / t)[row, target], 1e-12)).mean()
    temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    p = softmax(z / temperature)
    sure, right = p.max(axis=1), p.argmax(axis=1) == target
    order = np.argsort(-sure, kind="stable")
    kept = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(kept >= accuracy)
    threshold = sure[order][enough[-1]] if len(enough) else sure.max()
    return Model(model.languages, model.logits, model.bias, float(temperature), float(min(threshold, np.quantile(sure, most))))


def fold(doc_id="doc_id"):
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 5


def fit(docs: DataFrame, per_language: int = 400, train_on_all: bool = False, most_languages: int = 200) -> Model:
    """Train on rows with text, lang and fold other than 0 (all with train_on_all).

    The sample is bounded: labels beyond the most_languages most frequent ones (ties by name) are not learned, so that a
    column of stray labels does not fill the driver; rows are drawn by a hash of the id at a rate that gives about
    per_language rows a language, and of those the first 2 * per_language * languages by a hash of id and text are taken, the same ones on any
    cluster. Their whole texts count; only their bags of subwords, bounded however long a text is, go to the driver."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    if not train_on_all:
        rows = rows.where(fold() != 0)
    common = rows.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    counts = {r["lang"]: r["n"] for r in common.collect()}
    if not counts:
        return train([], [])
    scale = 1 << 30
    rates = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(scale, scale * per_language // n))])
    drawn = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(scale)) < rates[F.col("lang").cast("string")])
    sample = drawn.select(F.xxhash64("doc_id", "text").alias("h"), F.col("lang").cast("string").alias("lang"), "text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                bags = bags_of(texts_of(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column("h"), part.column("lang"), pa.array([b.astype("<u2").tobytes() for b, _ in bags], pa.binary()), pa.array([s.astype("<f4").tobytes() for _, s in bags], pa.binary())],
                    ["h", "lang", "buckets", "shares"],
                )

    bagged = sample.mapInArrow(run, "h long, lang string, buckets binary, shares binary")
    held = bagged.orderBy("h", "lang", "buckets").limit(2 * per_language * len(counts)).collect()
    bags = [(np.frombuffer(r["buckets"], "<u2").astype(np.int64), np.frombuffer(r["shares"], "<f4")) for r in held]
    return train(bags, [r["lang"] for r in held])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs (doc_id, text), by its whole text.

    'und' with score 0, rejected, if the text is null or has no letter, or nothing was learned. held_out is false for a
    null doc_id, which stays null. Repeated rows are predicted alike, a row each; extra columns are ignored; an empty
    table gives no rows."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shipped.value
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = texts_of(part)
                known = np.array([bool(model.languages) and any(map(str.isalpha, t)) for t in texts], bool)
                best, sure = np.full(len(texts), len(model.languages)), np.zeros(len(texts))
                if known.any():
                    p = scores(model, [t for t, k in zip(texts, known) if k])
                    best[known], sure[known] = p.argmax(axis=1), p.max(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names[best], pa.string()), pa.array(sure), pa.array(sure < max(model.threshold, 1e-9))],
                    ["doc_id", "held_out", "lang_pred", "score", "rejected"],
                )

    ids = F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(ids, F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text").mapInArrow(run, PREDICTED)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose language is not rejected. Row by row: repeated rows share their fate.

    Null texts and texts without a letter go, as they have no language, and all rows go where the model has none; further
    columns pass whatever their names; an empty table stays empty."""
    shipped, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches):
        model = shipped.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = texts_of(part)
                keep = np.array([bool(model.languages) and any(map(str.isalpha, t)) for t in texts], bool)
                if keep.any():
                    keep[keep] = scores(model, [t for t, k in zip(texts, keep) if k]).max(axis=1) >= model.threshold
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
