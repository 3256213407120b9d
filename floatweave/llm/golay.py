"""The perfect binary Golay code of length 23, as a fuzzy hash of 23-bit words.

Every word lies within 3 bits of exactly one codeword. A word at distance 3
has five more codewords at distance 4; a word nearer than 3 has none. With
those keys, words that differ in at most one bit meet when one side gives its
nearest codeword and the other side all its keys, and words that differ in at
most two bits meet when both sides give all their keys.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, CHECKS = 23, 11
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101


def _syndromes() -> np.ndarray:
    """The remainder of each single bit."""
    out = []
    for bit in range(LENGTH):
        x = 1 << bit
        for k in range(LENGTH - 1, CHECKS - 1, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - CHECKS)
        out.append(x)
    return np.array(out, np.int64)


_BIT = _syndromes()


def syndrome(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for bit in range(LENGTH):
        out ^= np.where(words >> bit & 1, _BIT[bit], 0)
    return out


def _leaders() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns of its keys, nearest first, and their number."""
    leader, n = np.zeros((1 << CHECKS, 6), np.int64), np.ones(1 << CHECKS, np.int64)
    three = np.zeros(1 << CHECKS, bool)
    for weight in (1, 2, 3, 4):
        for bits in combinations(range(LENGTH), weight):
            s = int(np.bitwise_xor.reduce(_BIT[list(bits)]))
            error = sum(1 << b for b in bits)
            if weight < 4:
                leader[s, 0], three[s] = error, weight == 3
            elif three[s]:
                leader[s, n[s]] = error
                n[s] += 1
    return leader, n


LEADERS, N_KEYS = _leaders()


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """12-bit indices of the codewords near each word, six columns, nearest first; and how many count."""
    s = syndrome(words)
    return (words[:, None] ^ LEADERS[s]) >> CHECKS, N_KEYS[s]
