"""Quality rules by tokeniser fertility.

A public vocabulary tokenises every word; documents whose characters per token, byte-fallback share or token
entropy lie outside the band of their language and length are rejected. Bands are quartile fences over all documents
that pass the base rules, so they follow the corpus, without labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.sparkkit import cut, slices, small, texts_of
from lumenspan.llm.textkit import MIX, mix64
from lumenspan.llm.wordcache import WordCache

MEASURES = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, byte_share double, entropy double"
)
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5
#: Steps a unit in which measures are counted for their quartiles.
STEPS = 10_000
#: The least interquartile ranges that count.
FLOORS = {"chars_per_token": 0.15, "byte_share": 0.02, "entropy": 0.01}
#: What a band is taken over, from the closest class to all documents.
LEVELS = {"of_fine": ("lang", "fine"), "of_coarse": ("lang", "coarse"), "of_lang": ("lang",), "of_all": ()}


class Fertility:
    """Hash and token ids of words by a sentencepiece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.words = WordCache(self._measure, 150_000)

    def _measure(self, words: list[bytes]):
        found = self.model.encode([w.decode() for w in words], num_threads=1)
        return [(xxhash.xxh64_intdigest(w), np.array(ids, "<u4").tobytes()) for w, ids in zip(words, found)]


_models: dict[str, Fertility] = {}


def fertility(path: str) -> Fertility:
    if path not in _models:
        _models[path] = Fertility(path)
    return _models[path]


def repeated(hashes: np.ndarray, docs: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document, its words inside windows of five words that the document has twice or more."""
    n = len(hashes) - WINDOW + 1
    if n < 1:
        return np.zeros(n_docs, np.int64)
    window = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        window = mix64(window * MIX + hashes[k : k + n])
    inside = np.flatnonzero(docs[:n] == docs[WINDOW - 1 :])
    keys = mix64(window[inside] + docs[inside].astype(np.uint64) * MIX)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, inside[twice], 1)
    np.add.at(edges, inside[twice] + WINDOW, -1)
    covered = np.cumsum(edges[:-1]) > 0
    return np.bincount(docs[covered], minlength=n_docs)


def entropy(ids: np.ndarray) -> float:
    """Entropy of the token distribution, as a share of the most that so many tokens could have (1 for one token)."""
    if len(ids) < 2:
        return 1.0
    counts = np.unique(ids, return_counts=True)[1]
    share = counts / len(ids)
    return float(-(share * np.log(share)).sum() / np.log(len(ids)))


def measure(docs: DataFrame, model_path: str) -> DataFrame:
    """Base counts and fertility of every whole text. Null text: no words; null lang: 'und'."""

    def run(batches):
        model = fertility(model_path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part)
                words = [t.encode().split() for t in texts]
                known = model.words.prepare([w for ws in words for w in ws])
                found = [[known[w] for w in ws] for ws in words]
                n_words = np.array([len(ws) for ws in words], np.int64)
                hashes = np.fromiter((h for f in found for h, _ in f), np.uint64, int(n_words.sum()))
                repeats = repeated(hashes, np.repeat(np.arange(len(texts)), n_words), len(texts))
                ids = [np.frombuffer(b"".join([x for _, x in f]), "<u4") for f in found]
                chars = np.array([len(t) - sum(map(t.count, BLANKS)) for t in texts], np.int64)
                lines = [[x for x in t.split("\n") if x.strip(BLANKS)] for t in texts]
                n_tokens = np.array([len(x) for x in ids], np.int64)
                columns = {
                    "doc_id": part.column("doc_id"),
                    "lang": part.column("lang"),
                    "n_words": n_words,
                    "word_chars": chars,
                    "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
                    "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
                    "n_repeat_words": repeats.astype(np.int64),
                    "n_tokens": n_tokens,
                    "chars_per_token": chars / np.maximum(n_tokens, 1),
                    "byte_share": np.array([model.is_byte[x].mean() if len(x) else 0.0 for x in ids]),
                    "entropy": np.array([entropy(x) for x in ids]),
                }
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang, "text").mapInArrow(run, MEASURES)


def bands(passing: DataFrame, level: tuple[str, ...], name: str) -> DataFrame:
    """Quartiles of the three measures over the documents of each class of a level, and their number. Values are
    counted in steps of 1 / STEPS, so the quartiles are exact, from a bounded histogram, and alike on any cluster."""
    measured = [F.percentile(F.round(F.col(c) * STEPS), F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in FLOORS]
    band = F.struct(F.count("*").alias("n"), *measured).alias(name)
    return passing.groupBy(*level).agg(band)


def judge(docs: DataFrame, model_path: str, width: float = 3.0, least: int = 30) -> DataFrame:
    """Measures, base_failed and kept for each row of docs (doc_id, lang, text).

    Each measure may lie `width` interquartile ranges beyond the quartiles of its class (at 3 about one in 400,000 normal
    values lies outside): characters per token on either side, the byte share above, the entropy, less its linear
    trend in the logarithm of the length, below. A class is a language and a quarter of an octave of tokens, as short
    texts scatter more; with fewer than `least` passing documents an octave, then the language, then all documents,
    so every document has a band. Bands that span all lengths are wider for short texts, as their means scatter.
    A byte share may also hold one odd character of four bytes. Text without words fails the base rules; null text has
    none; a null lang is a language of its own. Repeated rows are judged alike; extra columns are ignored; an empty
    table gives no rows."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    octaves = F.log2(F.greatest("n_tokens", F.lit(1)).cast("double"))
    held = cut(measure(docs, model_path).withColumns({"base_failed": failed, "fine": F.floor(4 * octaves), "coarse": F.floor(octaves)}))
    counted = held.where(~F.col("base_failed"))
    slope = counted.agg(F.round(F.regr_slope("entropy", F.log2("n_tokens")), 6)).first()[0] or 0.0
    levelled = held.withColumn("raw", F.col("entropy")).withColumn("entropy", F.col("entropy") - F.lit(slope) * octaves)
    passing = levelled.where(~F.col("base_failed"))
    banded = levelled
    for name, level in LEVELS.items():
        found = small(cut(bands(passing, level, name)))
        banded = banded.join(found, list(level), "left") if level else banded.crossJoin(F.broadcast(found))  # a single row
    narrow = F.coalesce(*[F.when(F.col(f"{k}.n") >= least, F.col(k)) for k in ("of_fine", "of_coarse")])
    wide = F.coalesce(F.when(F.col("of_lang.n") >= least, F.col("of_lang")), F.col("of_all"))
    scatter = F.when(F.col("narrow").isNull(), F.sqrt(1 + F.lit(100.0) / F.greatest("n_tokens", F.lit(1)))).otherwise(1.0)
    banded = banded.withColumns({"narrow": narrow, "wide": wide}).withColumns({"band": F.coalesce("narrow", "wide"), "room": scatter * width})

    def fence(measure: str, side: int) -> Column:
        low, high = F.col(f"band.{measure}")[0] / STEPS, F.col(f"band.{measure}")[1] / STEPS
        return (high if side > 0 else low) + side * F.greatest(high - low, F.lit(FLOORS[measure])) * F.col("room")

    inside = (
        F.col("chars_per_token").between(fence("chars_per_token", -1), fence("chars_per_token", 1))
        & (F.col("byte_share") <= fence("byte_share", 1) + F.lit(4.0) / F.greatest("n_tokens", F.lit(1)))
        & (F.col("entropy") >= fence("entropy", -1))
    )
    return banded.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
        "n_tokens", "chars_per_token", "byte_share", F.col("raw").alias("entropy"),
    )
