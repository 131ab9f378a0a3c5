"""A wavelet matrix over character classes, in numpy: ranks and selects of many places at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_ONE = np.uint64(1)


class BitVector:
    """Bits with the number of ones before every 64-bit word."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype="<u8")
        self.words.view(np.uint8)[:len(packed)] = packed
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.ones = int(counts.sum())

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = places >> 6
        below = (_ONE << (places & 63).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)

    def select(self, numbers: np.ndarray, bit: int) -> np.ndarray:
        """Place of the one (or zero) with each number, counted from 0; all of them must be there."""
        before = self.before if bit else np.arange(len(self.words)) * 64 - self.before
        word = np.searchsorted(before, numbers, side="right") - 1
        left = numbers - before[word]
        bits = self.words[word] if bit else ~self.words[word]
        at = np.zeros(len(numbers), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            inside = np.bitwise_count((bits >> at.astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)
            on = left >= inside
            left, at = np.where(on, left - inside, left), np.where(on, at + width, at)
        return word * 64 + at


class WaveletMatrix:
    """Codes of ``bits`` bits each, stored by bit from the highest, each level sorted stably by the bit above."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.size = len(codes)
        self.levels: list[tuple[int, BitVector]] = []
        for shift in range(bits - 1, -1, -1):
            ones = ((codes >> shift) & 1).astype(bool)
            self.levels.append((shift, BitVector(ones)))
            codes = np.concatenate([codes[~ones], codes[ones]])

    def _down(self, code: int, places: np.ndarray) -> np.ndarray:
        for shift, level in self.levels:
            ones = level.rank(places)
            places = level.size - level.ones + ones if code >> shift & 1 else places - ones
        return places

    def rank(self, code: int, places: np.ndarray) -> np.ndarray:
        """How often ``code`` stands before each place."""
        return self._down(code, places) - self._down(code, np.zeros(1, dtype=np.int64))[0]

    def ranks(self, codes: Sequence[int], places: np.ndarray) -> np.ndarray:
        """How often any of ``codes`` stands before each place."""
        return sum((self.rank(code, places) for code in codes), np.zeros(len(places), dtype=np.int64))

    def select(self, code: int, numbers: np.ndarray) -> np.ndarray:
        """Place of the ``code`` with each number, counted from 0; all of them must be there."""
        places = numbers + self._down(code, np.zeros(1, dtype=np.int64))[0]
        for shift, level in reversed(self.levels):
            one = code >> shift & 1
            places = level.select(places - (level.size - level.ones) if one else places, one)
        return places

    def bisect(self, codes: Sequence[int], numbers: np.ndarray) -> np.ndarray:
        """Place of the character with each number among those of any of ``codes``, by bisection on the sum of their ranks."""
        low, high = np.zeros(len(numbers), dtype=np.int64), np.full(len(numbers), self.size, dtype=np.int64)
        while (low < high).any():
            middle = (low + high) >> 1
            enough = self.ranks(codes, middle) > numbers
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        return low - 1
