"""Best-two-fit packing of token pieces into fixed-size sequences.

Greedy best-fit-decreasing fills a bin; then its smallest member is replaced by two still unpacked pieces if
they fit the expanded gap more tightly. Piece lengths are integers up to the capacity, so the plan is made on
the histogram of lengths alone (at most `capacity` counts, whatever the corpus): bins with the same content are
planned as one pattern with a multiplicity, and executors map each piece to its bin by its rank within its length.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspan.llm.sparkkit import cut, partitions, slices, texts_of
from lumenspan.llm.textkit import BEYOND_LATIN, LETTERS, NUMBERS
from lumenspan.llm.wordcache import WordCache

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Working columns beside those of the caller.
BLOCK, RANK, SHIFT = "__lumenspan_block", "__lumenspan_rank", "__lumenspan_shift"
#: Separators that Python's str.split knows and the tokenizer's \s does not.
ODD_SPACES = "\x1c\x1d\x1e\x1f"


#: The vocabulary's pre-tokenizer (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What a vocabulary file must say for words to be encoded one by one (fixed values).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


#: SPLIT for text below U+0250, whose letters and numbers no Unicode version changes: alternatives begin with different
#: characters, so that the frequent ones may come first.
LATIN_SPLIT = rf"[{LETTERS}]+|[{NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\s{LETTERS}{NUMBERS}]+"


class WordTokenizer:
    """Ids of whole texts as the tokenizers library gives them, a word at a time: this vocabulary's normaliser,
    pre-tokenizer and special tokens never look across white space, so ids of a text are those of its words one after
    the other. A vocabulary with other rules is an error. Special tokens in a text are special, as in the library;
    with special_as_text their strings are ordinary text."""

    def __init__(self, path: str, special_as_text: bool = False):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        if rules["normalizer"] != NORMALIZER or rules["pre_tokenizer"] != PRE_TOKENIZER or rules["post_processor"]:
            raise ValueError(f"{path}: not a vocabulary whose words can be encoded one by one")
        special = [t["content"] for t in rules["added_tokens"]]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in rules["added_tokens"]) or any(x.split() != [x] for x in special):
            raise ValueError(f"{path}: its special tokens reach beyond a word")
        self.special = [] if special_as_text else special
        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = special_as_text
        self.model, self.split = self.full.model, regex.compile(SPLIT).findall
        # Byte-level text: a byte that is no visible Latin-1 character stands as the next code point from 256 on.
        seen = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
        rest = [b for b in range(256) if b not in set(seen)]
        self.byte_level = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.latin = re.compile(LATIN_SPLIT).findall
        self.parts = WordCache(lambda parts: [self._part(p) for p in parts], 250_000)
        self.words = WordCache(self._words, 150_000)

    def _part(self, part: str) -> bytes:
        if not (part.isascii() and part.isprintable()):
            part = part.encode().decode("latin-1").translate(self.byte_level)
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _whole(self, text: str) -> bytes:
        """By the tokenizer itself: for what needs its normaliser or its special tokens."""
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pieces(self, word: str) -> list[str] | None:
        """The pre-tokenizer's parts of a word, None for one that is left to the tokenizer itself."""
        # Latin letters and ASCII are the same to Python's and the tokenizer's Unicode tables, whatever their versions.
        if not word.isascii() and (max(word) >= "\u0250" or not unicodedata.is_normalized("NFC", word)):
            return None
        low = word.lower()
        if low.isalpha():
            return [low]
        if low[:-1].isalpha():
            return [low[:-1], low[-1]]
        if "<" in word and any(x in word for x in self.special):
            return None
        return self.split(low)

    def _words(self, words: list[str]):
        split = [self._pieces(w) for w in words]
        known = self.parts.prepare([x for s in split if s for x in s])
        return [self._whole(w) if s is None else b"".join([known[x] for x in s]) for w, s in zip(words, split)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        odd = [any(c in t for c in ODD_SPACES) for t in texts]
        plain = [not o and self._plain(t) for t, o in zip(texts, odd)]
        words = [[] if o or p else t.split() for t, o, p in zip(texts, odd, plain)]
        known = self.words.prepare(list(chain.from_iterable(words)))
        out = [self._whole(t) if o else b"".join(map(known.__getitem__, w)) for t, w, o in zip(texts, words, odd)]
        parts = [self.latin(t.lower()) if p else [] for t, p in zip(texts, plain)]
        known = self.parts.prepare(list(chain.from_iterable(parts)))
        return [b"".join(map(known.__getitem__, x)) if p else o for x, p, o in zip(parts, plain, out)]

    def _plain(self, text: str) -> bool:
        """Whether a whole text can be split at once: Latin, in which the normaliser only lowers, without special tokens."""
        return (text.isascii() or not BEYOND_LATIN.search(text)) and not any(x in text for x in self.special)


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker; its words stay known from task to task."""
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of at most `capacity` ids (a text's ids, then end_id). Null or empty text: end_id alone.
    A null doc_id stays null; repeated rows give their pieces again; extra columns are ignored; an empty table gives no
    rows."""

    def run(batches):
        tokenizer, end = word_tokenizer(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                doc_ids, rows = part.column("doc_id").to_pylist(), []
                for doc_id, found in zip(doc_ids, tokenizer.ids(texts_of(part))):
                    ids = found + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut_ids = ids[at : at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(cut_ids) // 4, zlib.crc32(cut_ids)))
                columns = zip(*rows)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(multiplicity, piece lengths) of bins that use up the histogram exactly, by best-two-fit."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("a piece must have from 1 to capacity tokens")
    lengths, plan = sorted(left), []

    def largest(most: int, used: dict[int, int]) -> int | None:
        for i in range(bisect_right(lengths, most) - 1, -1, -1):
            if left[lengths[i]] > used.get(lengths[i], 0):
                return lengths[i]
        return None

    while lengths:
        used: dict[int, int] = {}
        gap, content = capacity, []
        while (n := largest(gap, used)) is not None:
            take = max(1, min(left[n] - used.get(n, 0), gap // n))
            used[n] = used.get(n, 0) + take
            content += [n] * take
            gap -= n * take
        while gap > 0 and len(content) > 1:
            smallest = content[-1]
            pair = _tighter_pair(lengths, left, used, smallest + gap, smallest)
            if pair is None:
                break
            content.pop()
            used[smallest] -= 1
            for n in pair:
                used[n] = used.get(n, 0) + 1
            content = sorted(content + list(pair), reverse=True)
            gap = capacity - sum(content)
        used = {n: c for n, c in used.items() if c}
        times = min(left[n] // c for n, c in used.items())
        plan.append((times, tuple(content)))
        for n, c in used.items():
            left[n] -= c * times
        lengths = [n for n in lengths if left[n]]
    return plan


def _tighter_pair(lengths, left, used, room: int, smallest: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum in (smallest, room]; two pointers over the sorted lengths."""
    free = [n for n in lengths if n < room and left[n] > used.get(n, 0)]
    best, pair, i, j = smallest, None, 0, len(free) - 1
    while i <= j:
        a, b = free[i], free[j]
        if i == j and left[a] - used.get(a, 0) < 2:
            break
        if a + b > room:
            j -= 1
            continue
        if a + b > best:
            best, pair = a + b, (b, a)
            if best == room:
                break
        i += 1
    return pair


def _slots(plan: list[tuple[int, tuple[int, ...]]]) -> dict[int, dict[str, np.ndarray]]:
    """For each length, where its pieces go by rank: first rank, slots a bin, first sequence, offsets."""
    table: dict[int, list] = {}
    taken: dict[int, int] = {}
    first = 0
    for times, content in plan:
        offsets: dict[int, list[int]] = {}
        at = 0
        for n in content:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, places in offsets.items():
            table.setdefault(n, []).append((taken.get(n, 0), len(places), first, places))
            taken[n] = taken.get(n, 0) + len(places) * times
        first += times
    return table


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = 2048, blocks: int | None = None) -> DataFrame:
    """Give each row of pieces (with a `length` from 1 to capacity) a sequence_id and an offset, gapless from 0.

    Ties of one length are ranked by all columns, so equal rows are exchangeable. The rank is taken within hashed
    blocks of rows and shifted by the counts of the blocks before, so no length, however common, meets in one task.
    An empty input gives an empty result. `pieces` is read several times: pass a materialised table."""
    columns = pieces.columns
    blocks = blocks or 4 * partitions(spark)
    spread: Column = F.pmod(F.xxhash64(*columns), F.lit(blocks))
    held = pieces.withColumn(BLOCK, spread)
    counts = held.groupBy(BLOCK, "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    shifts = cut(counts.withColumn(SHIFT, F.coalesce(F.sum("n").over(before), F.lit(0))))
    histogram = {r["length"]: r["n"] for r in shifts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    slots = spark.sparkContext.broadcast(_slots(plan_bins(histogram, capacity)))
    order = Window.partitionBy(BLOCK, "length").orderBy(*columns)
    ranked = (
        held.withColumn(RANK, F.row_number().over(order) - 1)
        .join(shifts.select(BLOCK, "length", SHIFT), [BLOCK, "length"])
        .select(*columns, (F.col(RANK) + F.col(SHIFT)).alias(RANK))
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def place(batches):
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column(RANK).to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for n in np.unique(lengths):
                rows, at = np.flatnonzero(lengths == n), slots.value[int(n)]
                pattern = np.searchsorted(np.array([x[0] for x in at]), ranks[rows], "right") - 1
                for p in np.unique(pattern):
                    mine, (start, width, first, places) = rows[pattern == p], at[p]
                    k = ranks[mine] - start
                    sequence[mine], offset[mine] = first + k // width, np.array(places)[k % width]
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Tokenise docs (doc_id, text) once, then pack all their pieces: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, by the rules of token_pieces and pack. Null and empty texts are one piece of the end id alone;
    repeated rows are packed once each; extra columns are ignored; an empty table gives no rows."""
    return pack(spark, cut(token_pieces(docs, tokenizer_path, capacity)), capacity)
