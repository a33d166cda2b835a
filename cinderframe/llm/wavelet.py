"""A wavelet matrix over small symbols, with vectorised rank queries."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with the number of ones in front of every 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, ends: np.ndarray) -> np.ndarray:
        """Ones among the first `ends` bits."""
        word = ends >> 6
        below = (np.uint64(1) << (ends & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Symbols below 2 ** bits, one bit vector a bit, the highest first; zeros of a level stand before its ones in the next.

    Takes about two bits of memory for each bit of a symbol, whatever the symbols are.
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for shift in range(bits - 1, -1, -1):
            ones = (symbols >> shift) & 1 == 1
            self.levels.append(Bits(ones))
            self.zeros.append(len(ones) - int(np.count_nonzero(ones)))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        none = np.zeros(1, np.int64)
        self.first = [int(self._follow(symbol, none)[0]) for symbol in range(1 << bits)]

    def _follow(self, symbol: int, places: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.ones(places)
            places = zeros + ones if symbol >> (self.bits - 1 - level) & 1 else places - ones
        return places

    def rank(self, symbol: int, ends: np.ndarray) -> np.ndarray:
        """How often `symbol` is among the first `ends` symbols."""
        return self._follow(symbol, ends) - self.first[symbol]
