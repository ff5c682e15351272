"""The binary Golay code [23,12,7] as a fuzzy hash.

The code is perfect: every 23-bit word lies within 3 bits of exactly one codeword, so decoding hashes the 2^23 words to
4096 indices. A word and all its one-bit neighbours decode to 1 or 6 indices. Two words that differ in

* at most 2 bits have a common neighbour, so their sets of indices meet;
* at most 1 bit: the index of either is in the set of the other.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the code.
GENERATOR = 0xC75
BITS, DATA = 23, 12


def remainder(words: np.ndarray) -> np.ndarray:
    """Words modulo the generator polynomial: their 11-bit syndromes."""
    rest = words.astype(np.uint32)
    for bit in range(BITS - 1, BITS - DATA - 1, -1):
        rest = np.where(rest >> np.uint32(bit) & 1, rest ^ np.uint32(GENERATOR << (bit - (BITS - DATA))), rest)
    return rest


@lru_cache(maxsize=1)
def corrections() -> np.ndarray:
    """By syndrome, the one error pattern of at most 3 bits."""
    one = 1 << np.arange(BITS, dtype=np.uint32)
    pairs = [a | b for i, a in enumerate(one) for b in one[:i]]
    triples = [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
    patterns = np.array([0, *one, *pairs, *triples], dtype=np.uint32)
    table = np.zeros(1 << (BITS - DATA), dtype=np.uint32)
    table[remainder(patterns)] = patterns
    return table


@lru_cache(maxsize=1)
def syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits; the code is linear, so they add up."""
    return remainder(np.arange(1 << 12)), remainder(np.arange(1 << 11, dtype=np.uint32) << np.uint32(12))


def decode(words: np.ndarray) -> np.ndarray:
    """Index 0..4095 of the codeword next to each word."""
    low, high = syndromes()
    words = words.astype(np.uint32)
    syndrome = low[words & np.uint32(0xFFF)] ^ high[words >> np.uint32(12)]
    return ((words ^ corrections()[syndrome]) >> np.uint32(BITS - DATA)).astype(np.int64)


def neighbours(words: np.ndarray, bits: range, itself: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indices of each word's one-bit neighbours at `bits` (and its own): an array of indices, a row to
    each word, and the mask of those that count."""
    flips = [1 << b for b in bits] + [0] * itself
    found = np.sort(np.stack([decode(words ^ np.uint32(f)) for f in flips], axis=1), axis=1)
    first = np.ones(found.shape, dtype=bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    return found, first
