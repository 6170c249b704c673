"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string, exactly one token can end its encoding. The table of these last tokens is
filled from left to right: a candidate that ends at i is right if it and the last token of the prefix before it
stay apart when merged as BPE would. An encoding is read off the table backwards, an append only extends it, and
an edit refills it from the changed byte to where it meets the old table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.sparkkit import slices, texts_of
from lumenspan.llm.textkit import BEYOND_LATIN, LETTERS, NUMBERS
from lumenspan.llm.wordcache import WordCache

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
FAR = 1 << 60
#: Bytes that an edit refills before it looks whether the table has met the old one.
STEP = 64
#: Lengths of tokens that any bytes may end in.
SHORT = (2, 1)
#: Separators that Python's \s knows and the tokenizer's \s does not.
ODD_SPACES = "\x1c\x1d\x1e\x1f"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


#: The pattern that re can split Latin text by, with classes of characters in place of Unicode properties (a fixed value).
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class BytePairs:
    """The vocabulary: tokens by rank and the compatibility of neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        ends: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 2:
                ends.setdefault(token[-3:], set()).add(len(token))
        #: Lengths, the longest first, of the tokens that end in three given bytes, and of the shorter ones.
        self.sizes = {tail: (*sorted(sizes, reverse=True), 2, 1) for tail, sizes in ends.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.proven: set[int] = set()

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte (or a token that merges never make)."""
        if token not in self.halves:
            parts = self._merge(self.tokens[token], self.ranks[self.tokens[token]])
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def _merge(self, text: bytes, below: int = FAR) -> list[int]:
        """Plain BPE with the merges ranked under `below`."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], FAR), i) for i in range(len(parts) - 1))
            if rank >= below or rank == FAR:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Whether BPE turns the token's bytes into that token."""
        good = len(self.tokens[token]) == 1 or self.split(token) is not None
        if good:
            self.proven.add(token)
        return good

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves the bytes of left+right as these two tokens: walk both merge trees from the last
        merge down; no merge across the seam may come before the merges that closed either side."""
        key = (left, right)
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > 500_000:
                self.apart.clear()
            known = self.apart[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        limit = FAR
        while True:
            joined = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joined is not None and joined < limit:
                return False
            if left > right:
                limit, parts = left, self.split(left)
                if parts is not None:
                    left = parts[1]
                    continue
                limit, parts = right + 1, self.split(right)
                if parts is None:
                    return True
                right = parts[0]
            else:
                limit, parts = right + 1, self.split(right)
                if parts is not None:
                    right = parts[0]
                    continue
                limit, parts = left, self.split(left)
                if parts is None:
                    return True
                left = parts[1]


class PrefixTable:
    """Last tokens of all prefixes of `data`; supports exact appends and edits."""

    def __init__(self, pairs: BytePairs, data: bytes = b""):
        self.pairs, self.data, self.last, self.length = pairs, b"", [0], [0]
        self.append(data)

    def append(self, more: bytes) -> None:
        pairs, old = self.pairs, len(self.data)
        rank, sizes, proven, apart = pairs.ranks.get, pairs.sizes.get, pairs.proven, pairs.apart
        self.data = data = self.data + more
        last, length = self.last, self.length
        for i in range(old + 1, len(data) + 1):
            for size in sizes(data[i - 3 : i] if i > 2 else b"", SHORT):
                j = i - size
                if j < 0:
                    continue
                token = rank(data[j:i])
                if token is None or (token not in proven and not pairs.whole(token)):
                    continue
                if j:
                    left = last[j]
                    fits = apart.get((left, token))
                    if fits is None:
                        fits = pairs.compatible(left, token)
                    if not fits:
                        continue
                last.append(token)
                length.append(size)
                break
            else:
                raise ValueError(f"no token ends at byte {i}")

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Put `new` in place of bytes start to end. Prefixes up to start keep their entries, and so do those behind the
        edit from where the table meets the old one: an entry rests on the last `longest` bytes and entries alone."""
        data, last, length = self.data, self.last, self.length
        rest, old_last, old_length = data[end:], last[end:], length[end:]
        self.data = data[:start]
        del last[start + 1 :], length[start + 1 :]
        self.append(new)
        edge, run, longest = len(self.data), 0, self.pairs.longest
        for at in range(0, len(rest), STEP):
            self.append(rest[at : at + STEP])
            for i in range(at + 1, min(at + STEP, len(rest)) + 1):
                run = run + 1 if i >= longest and last[edge + i] == old_last[i] and length[edge + i] == old_length[i] else 0
                if run == longest:
                    del last[edge + i + 1 :], length[edge + i + 1 :]
                    last += old_last[i + 1 :]
                    length += old_length[i + 1 :]
                    self.data = data[:start] + new + rest
                    return

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i])
            i -= self.length[i]
        return out[::-1]


class ByteTokenizer:
    """Encoding and decoding of whole texts, each match of the pattern separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.pairs, self.pattern = BytePairs(ranks), regex.compile(pattern)
        # A run of visible characters with the blank before it never shares a match with its neighbours.
        self.chunks = re.compile(r" ?\S+|\s+(?!\S)|\s+")
        # Below U+0250 no Unicode version changes what is a letter or a number, so re splits such text as regex does.
        latin = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{LETTERS}{NUMBERS}]").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]")
        self.latin = None if pattern != KNOWN_PATTERN else re.compile(latin)
        self.words = WordCache(self._words, 250_000)
        self.runs = WordCache(self._run, 200_000)

    def _word(self, word: str) -> bytes:
        data = word.encode()
        token = self.pairs.ranks.get(data)
        if token is not None and self.pairs.whole(token):
            return token.to_bytes(4, "little")
        ids = PrefixTable(self.pairs, data).ids()
        return struct.pack(f"<{len(ids)}I", *ids)

    def _words(self, words: list[str]) -> list[bytes]:
        """In byte order, so that a word keeps the table's entries for what it begins with like the word before."""
        pairs, found, table = self.pairs, {}, PrefixTable(self.pairs)
        for word in sorted(words):
            data = word.encode()
            token = pairs.ranks.get(data)
            if token is not None and pairs.whole(token):
                found[word] = token.to_bytes(4, "little")
                continue
            old, same = table.data, 0
            for a, b in zip(old, data):
                if a != b:
                    break
                same += 1
            table.replace(same, len(old), data[same:])
            ids = table.ids()
            found[word] = struct.pack(f"<{len(ids)}I", *ids)
        return [found[w] for w in words]

    def _run(self, runs: list[str]):
        split = [self.pattern.findall(r) for r in runs]
        known = self.words.prepare([w for words in split for w in words])
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(c in text for c in ODD_SPACES):
            return b"".join(map(self._word, self.pattern.findall(text)))
        runs = self.chunks.findall(text)
        return b"".join(map(self.runs.prepare(runs).__getitem__, runs))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """encode for each text; words of Latin texts are looked up together."""
        plain = [self.latin is not None and (t.isascii() or not BEYOND_LATIN.search(t)) and not any(c in t for c in ODD_SPACES) for t in texts]
        words = [self.latin.findall(t) if p else [] for t, p in zip(texts, plain)]
        known = self.words.prepare(list(chain.from_iterable(words)))
        found = [b"".join(map(known.__getitem__, w)) for w in words]
        return [f if p else self.encode(t) for t, p, f in zip(texts, plain, found)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pairs.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_tokenizers: dict[tuple[str, str], ByteTokenizer] = {}


def byte_tokenizer(path: str, pattern: str) -> ByteTokenizer:
    if (path, pattern) not in _tokenizers:
        _tokenizers[path, pattern] = ByteTokenizer(load_ranks(path), pattern)
    return _tokenizers[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes, and the ids themselves on request.
    A null text is empty (no ids); a null doc_id stays null; repeated rows are encoded again; extra columns are ignored; an
    empty table gives no rows. Work is linear in a text, one run without spaces included."""

    def run(batches):
        tokenizer = byte_tokenizer(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                ids = tokenizer.encode_all(texts_of(part))
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    "decoded_sha256": pa.array([hashlib.sha256(tokenizer.decode(x)).hexdigest() for x in ids]),
                }
                if with_ids:
                    columns["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = ENCODED + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
