"""A bounded memo for functions of words: most running text repeats few words, whatever the size of the corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class WordCache:
    """Two generations of `capacity` entries each: old words fall out, frequent ones are carried over. Words longer than
    `longest` (unspaced blobs) are not kept beyond the call that needs them, so the bytes held are bounded too."""

    def __init__(self, compute: Callable[[list[str]], Iterable], capacity: int = 250_000, longest: int = 64):
        self.compute, self.capacity, self.longest = compute, capacity, longest
        self.young: dict = {}
        self.old: dict = {}
        self.passing: list = []

    def prepare(self, words: list[str]) -> dict:
        """A dict that has every one of `words`; valid until the next call."""
        young, old = self.young, self.old
        for w in self.passing:
            del young[w]
        self.passing = []
        if len(young) > self.capacity:
            self.old = old = young
            self.young = young = {}
        unseen = set(words).difference(young)
        if unseen:
            if old:
                kept = [w for w in unseen if w in old]
                young.update(zip(kept, map(old.__getitem__, kept)))
                unseen.difference_update(kept)
            todo = list(unseen)
            young.update(zip(todo, self.compute(todo)))
            self.passing = [w for w in todo if len(w) > self.longest]
        return young
