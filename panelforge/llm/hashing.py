"""Stable 64-bit hashes of words, in numpy arrays."""

from __future__ import annotations

from functools import cache

import numpy as np

CACHE_WORDS = 100_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


@cache
def _words() -> _Words:
    """One cache in a worker process."""
    return _Words()


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = _words()
    if len(known) > CACHE_WORDS:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class HashTable:
    """An immutable map from int64 keys (but -1) to doubles with vectorised look-up (open addressing).

    It is sent as its rows and built where it is first used.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.rows: tuple[np.ndarray, np.ndarray] | None = (keys, values)

    def _build(self) -> None:
        keys, values = self.rows
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            spot = at[left]
            free = self.keys[spot] == -1
            _, first = np.unique(spot[free], return_index=True)
            placed = left[free][first]
            self.keys[at[placed]], self.values[at[placed]] = keys[placed], values[placed]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask
        self.rows = None

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, NaN where a key is absent."""
        if self.rows is not None:
            self._build()
        at = self._home(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.nan)
        on = np.flatnonzero((there != keys) & (there != -1))
        while len(on):
            at[on] = (at[on] + 1) & self.mask
            there = self.keys[at[on]]
            hit = there == keys[on]
            out[on[hit]] = self.values[at[on[hit]]]
            on = on[~hit & (there != -1)]
        return out
