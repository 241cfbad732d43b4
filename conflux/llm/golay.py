"""Nearby codewords of the binary Golay code (23, 12, 7), as keys under which words one bit apart meet.

Every 23-bit word is within three bits of exactly one codeword. The keys of a word are the codewords within four bits:
one or six. Of two words one bit apart, either both have the same nearest codeword, or each has the other's nearest
codeword among those at distance four; so they share a key. Shorter words are padded with zeros.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

# Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH, CHECKS, MOST_KEYS = 23, 11, 6


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of the words, as polynomials, by the generator; codewords have 0."""
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - CHECKS)), rest)
    return rest


@cache
def error_patterns() -> np.ndarray:
    """By syndrome, the up to six patterns of at most four bits that have it; the rest are -1."""
    patterns = np.array([sum(1 << b for b in bits) for n in range(5) for bits in combinations(range(LENGTH), n)])
    table = np.full((1 << CHECKS, MOST_KEYS), -1, dtype=np.int64)
    used = np.zeros(1 << CHECKS, dtype=np.int64)
    for pattern, syndrome in zip(patterns, syndromes(patterns), strict=True):
        table[syndrome, used[syndrome]] = pattern
        used[syndrome] += 1
    return table


@cache
def keys_of_short_words(bits: int = 16) -> np.ndarray:
    """For each word of ``bits`` bits, the 12-bit message indices of its nearby codewords; the rest are -1."""
    words = np.arange(1 << bits, dtype=np.int64)
    patterns = error_patterns()[syndromes(words)]
    return np.where(patterns < 0, -1, (words[:, None] ^ patterns) >> CHECKS)
