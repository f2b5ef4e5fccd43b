"""The perfect binary Golay code (23, 12, 7): every word of 23 bits lies within 3 bits of exactly one codeword."""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np

BITS = 23
#: Fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for b in range(BITS - 1, 10, -1):
        if word >> b & 1:
            word ^= GENERATOR << (b - 11)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 12 information bits, and the error of at most 3 bits that belongs to each syndrome."""
    high = np.array([_remainder(i << 11) for i in range(4096)], np.int32)
    error = np.zeros(2048, np.int32)
    for w in range(4):
        for places in itertools.combinations(range(BITS), w):
            e = sum(1 << p for p in places)
            error[_remainder(e)] = e
    return high, error


def encode(index: np.ndarray) -> np.ndarray:
    """The codewords of 12-bit indices."""
    high, _ = _tables()
    index = np.asarray(index, np.int32)
    return (index << 11) | high[index]


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each word of 23 bits."""
    high, error = _tables()
    words = np.asarray(words, np.int32)
    return (words ^ error[high[words >> 11] ^ (words & 2047)]) >> 11
