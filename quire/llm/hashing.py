"""Hashes of words and of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of two rolling hashes (any odd 64-bit numbers do).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MOST_WORDS = 200_000


class Hashes(dict):
    """Word hashes, kept while few enough."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 32:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MOST_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            one = np.ones(1, np.uint64)
            self.up = np.concatenate((one, np.cumprod(np.full(n, self.base, np.uint64), dtype=np.uint64)))
            self.down = np.concatenate((one, np.cumprod(np.full(n, self.back, np.uint64), dtype=np.uint64)))
        return self.up, self.down


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def rolling(h: np.ndarray, n: int, powers: Powers) -> np.ndarray:
    """A hash of every run of n consecutive entries, the same wherever it stands."""
    up, down = powers.get(len(h) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)))
    return mix((sums[n:] - sums[:-n]) * down[: len(h) - n + 1])
