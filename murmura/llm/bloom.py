"""Word-blocked Bloom filters on numpy arrays.

A key is a 64-bit hash. It sets ``BITS`` bits of one 64-bit word, so that adding
and testing are vector operations. A filter's words are a power of two in number;
folding a filter onto its lower half keeps every key in it.
"""

from __future__ import annotations

import numpy as np

BITS = 4


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash once more, so that words, bits and slices are taken from independent bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def masks(mixed: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mixed), np.uint64)
    for i in range(BITS):
        out |= np.uint64(1) << ((mixed >> np.uint64(40 + 6 * i)) & np.uint64(63))
    return out


class Bloom:
    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def sized(cls, keys: int, bits_per_key: int = 16) -> Bloom:
        n = 1
        while n * 64 < keys * bits_per_key:
            n *= 2
        return cls(np.zeros(n, np.uint64))

    def at(self, mixed: np.ndarray) -> np.ndarray:
        return (mixed & np.uint64(len(self.words) - 1)).astype(np.int64)

    def has(self, mixed: np.ndarray) -> np.ndarray:
        m = masks(mixed)
        return (self.words[self.at(mixed)] & m) == m

    def add(self, mixed: np.ndarray) -> None:
        np.bitwise_or.at(self.words, self.at(mixed), masks(mixed))

    def folded(self, most_words: int, most_fill: float = 0.125) -> Bloom:
        """Halved while it has more than ``most_words`` words, or would stay sparse."""
        w = self.words
        while len(w) > 1:
            half = w[: len(w) // 2] | w[len(w) // 2 :]
            if len(w) <= most_words and np.bitwise_count(half).sum() > most_fill * 64 * len(half):
                break
            w = half
        return Bloom(w)
