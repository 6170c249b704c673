"""Vectorised text kernels: hashing, words, shingles and prefix polynomial hashes over flat arrays."""

from __future__ import annotations

import re

import numpy as np

#: Letters and numbers below U+0250, for classes of characters; no Unicode version changes them.
LETTERS, NUMBERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
BEYOND_LATIN = re.compile("[^\0-\u024f]")

MIX = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x + MIX
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


class Powers:
    """Growing tables of powers of an odd number modulo 2**64 and of its inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_powers = Powers(0xD6E8FEB86659FD93 | 1)
_letters = mix64(np.arange(256, dtype=np.uint64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words (runs without white space), and each text's number of words."""
    split = [t.lower().split() for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    data = np.frombuffer(" ".join([w for s in split for w in s]).encode(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), counts
    up, down = _powers.upto(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_letters[data] * up[:-1], out=prefix[1:])
    gaps = np.flatnonzero(data == 32)
    start = np.concatenate([[0], gaps + 1])
    end = np.concatenate([gaps, [len(data)]])
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64)), counts


def shingle_lists(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """Each text's shingles of `width` words in order, as 64-bit hashes; a shorter text is one shingle, a text without
    words has none."""
    words, counts = word_hashes(texts)
    n = len(words) - width + 1
    window = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        window = mix64(window * MIX + words[k : k + max(n, 0)])
    out, at = [], 0
    for count in counts.tolist():
        if count >= width:
            out.append(window[at : at + count - width + 1])
        elif count:
            short = np.uint64(count)
            with np.errstate(over="ignore"):
                for w in words[at : at + count]:
                    short = mix64(np.array([short * MIX + w]))[0]
            out.append(np.array([short]))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    return [np.unique(x) for x in shingle_lists(texts, width)]


def shingle_bags(texts: list[str], width: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct shingles, sorted, and how often it has each."""
    return [np.unique(x, return_counts=True) for x in shingle_lists(texts, width)]
