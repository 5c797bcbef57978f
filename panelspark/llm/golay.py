"""Fuzzy keys of 23-bit words from the perfect Golay code [23, 12, 7].

Every word lies within three bits of exactly one codeword. The keys of a word are the indices of all codewords within four bits: one
key if the word is within two bits of its codeword, else six. Two words that differ in at most two bits share a key: a word between
them lies within one bit of both, and the codeword nearest to it within three bits of that one.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Generator polynomial of the code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
BITS, CHECKS = 23, 11
#: Bits within which codewords become keys, and the most keys that a word can have.
RADIUS, MOST = 4, 6


def _remainder(word: int) -> int:
    for bit in range(BITS - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of all values of the low 12 and the high 11 bits; error patterns by remainder, -1 where there are fewer."""
    bits = [_remainder(1 << i) for i in range(BITS)]
    halves = np.zeros((2, 1 << 12), dtype=np.int32)
    for i in range(12):
        for half in (0, 1):
            if half * 12 + i < BITS:
                halves[half, 1 << i:2 << i] = halves[half, :1 << i] ^ bits[half * 12 + i]
    found: list[list[int]] = [[] for _ in range(1 << CHECKS)]
    for weight in range(RADIUS + 1):
        for places in combinations(range(BITS), weight):
            remainder = 0
            for p in places:
                remainder ^= bits[p]
            found[remainder].append(sum(1 << p for p in places))
    patterns = np.full((1 << CHECKS, MOST), -1, dtype=np.int32)
    for remainder, all_of in enumerate(found):
        patterns[remainder, :len(all_of)] = all_of
    return halves, patterns


def keys(words: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices of 23-bit words, -1 where a word has fewer."""
    halves, patterns = _tables()
    words = words.astype(np.int32)
    errors = patterns[halves[0, words & 0xFFF] ^ halves[1, words >> 12]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECKS)
