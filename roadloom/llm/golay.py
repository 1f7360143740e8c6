"""The binary Golay code of length 23: 4,096 codewords, and every 23-bit word within 3 bits of exactly one."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, CHECKS = 23, 11
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of each word by the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - CHECKS)), rest)
    return rest


@lru_cache
def neighbour_patterns() -> np.ndarray:
    """For each syndrome the error patterns that lead to near codewords, at most 6, filled up with -1.

    The first is the only one of 3 bits or fewer. A word 3 bits from its codeword also gets the five codewords 4 bits
    away: then two words that differ in one bit always share a codeword.
    """
    table = np.full((2**CHECKS, 6), -1, np.int64)
    weight, used = np.zeros(2**CHECKS, int), np.zeros(2**CHECKS, int)
    for size in range(5):
        patterns = np.array([sum(1 << b for b in c) for c in combinations(range(LENGTH), size)])
        for pattern, s in zip(patterns, syndrome(patterns), strict=True):
            if size < 4 or weight[s] == 3:
                table[s, used[s]] = pattern
                used[s] += 1
                weight[s] = min(size, 3)
    assert used.min() == 1 and used.max() == 6
    return table


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """The indices (12 bits) of the codewords near each word, 6 columns, -1 where there are fewer."""
    patterns = neighbour_patterns()[syndrome(words)]
    return np.where(patterns < 0, -1, (words.astype(np.int64)[:, None] ^ patterns) >> CHECKS)
