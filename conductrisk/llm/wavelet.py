"""A wavelet matrix over small numbers: rank of a symbol in a prefix, answered for many prefixes at once.

The sequence is stored as one bit vector per level, stably sorted by the bits of the levels above. A rank walks down
the levels with one bit count each, so it takes `bits` steps whatever the length. Bit vectors are packed, with one
count per 64 bits.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class BitVector:
    """Bits with rank: the number of ones before each of some places."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:], dtype=np.int64)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """`symbols` are numbers below 2^bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        rest = symbols
        for level in range(bits - 1, -1, -1):
            set_ = (rest >> level & 1).astype(bool)
            self.levels.append(BitVector(set_))
            self.zeros.append(len(set_) - int(np.count_nonzero(set_)))
            rest = np.concatenate([rest[~set_], rest[set_]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often `symbol` occurs before each place of `at` (0 to the length)."""
        first, last = np.zeros_like(at), at
        for i, (vector, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = vector.ones(np.stack([first, last]))
            if symbol >> (self.bits - 1 - i) & 1:
                first, last = zeros + ones[0], zeros + ones[1]
            else:
                first, last = first - ones[0], last - ones[1]
        return last - first
