"""Elias-Fano coded monotone sequences in flat arrays, searched in bulk with numpy.

A value splits into low bits, packed one after the other, and a high part,
coded in unary in a bit vector: its i-th one stands at (high part of value i) + i.
A directory of the zeros before each 64-bit word makes the values of one high
part a range found by two selects, and a binary search of their low bits ends
the successor search.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
ONE, SIX, LOW6 = U(1), U(6), U(63)

#: Position of the k-th one in each byte, 8 where there is none.
_SELECT8 = np.full((256, 8), 8, np.uint8)
for _byte in range(256):
    for _k, _at in enumerate(i for i in range(8) if _byte >> i & 1):
        _SELECT8[_byte, _k] = _at


def select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th one (from 0) of each word; no meaning where there is none."""
    k, at = k.astype(np.int64), np.zeros(len(words), np.int64)
    for half in (32, 16, 8):
        ones = np.bitwise_count(words & U((1 << half) - 1)).astype(np.int64)
        beyond = k >= ones
        k = k - ones * beyond
        at += beyond * half
        words = words >> (beyond * half).astype(U)
    return at + _SELECT8[(words & U(0xFF)).astype(np.int64), np.clip(k, 0, 7)]


def _ones_from(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many ones stand in a row from bit `at` of each word on, up to the word's end."""
    rest = ~(words >> at.astype(U))
    return np.minimum(np.bitwise_count((rest & (U(0) - rest)) - ONE).astype(np.int64), 64 - at)


class EliasFano:
    """A non-decreasing sequence of integers in [0, universe)."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros
        self._ones: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, U)
        n = len(values)
        bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, U)
        if bits:
            part = values & U((1 << bits) - 1)
            at = np.arange(n, dtype=U) * U(bits)
            word, shift = (at >> SIX).astype(np.int64), at & LOW6
            starts = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0] if n else word
            if n:
                low[word[starts]] = np.bitwise_or.reduceat(part << shift, starts)
            over = shift + U(bits) > U(64)  # one entry at most runs on into each word
            low[word[over] + 1] |= part[over] >> (U(64) - shift[over])
        tops = (values >> U(bits)).astype(np.int64) if bits < 64 else np.zeros(n, np.int64)
        length = n + ((universe - 1) >> bits if universe else 0) + 2
        marks = np.zeros(-(-length // 64) * 64, np.uint8)
        marks[tops + np.arange(n)] = 1
        high = np.packbits(marks, bitorder="little").view(U)
        ones = np.bitwise_count(high).astype(np.int64)
        zeros = np.concatenate([[0], np.cumsum(64 - ones)])
        return cls(n, bits, low, high, zeros)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits, len(self.low), len(self.high)], np.int64), self.low, self.high, self.zeros]

    @classmethod
    def opened(cls, raw: np.ndarray) -> tuple[EliasFano, np.ndarray]:
        """The sequence at the start of 8-byte aligned bytes, and the bytes behind it."""
        n, bits, a, b = (int(x) for x in raw[:32].view(np.int64))
        ends = np.cumsum([32, 8 * a, 8 * b, 8 * (b + 1)])
        low, high, zeros = (raw[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True))
        return cls(n, bits, low.view(U), high.view(U), zeros.view(np.int64)), raw[ends[-1] :]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        at = i.astype(U) * U(self.bits)
        word, shift = (at >> SIX).astype(np.int64), at & LOW6
        first = self.low[word] >> shift
        rest = np.where(shift > 0, self.low[word + 1] << ((U(64) - shift) & LOW6), U(0))
        return (first | rest) & U((1 << self.bits) - 1)

    def _bucket(self, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions [start, end) of the values with each high part: the ones between two zeros."""
        k = np.maximum(top - 1, 0)  # the zero that ends the high part before
        word = np.clip(np.searchsorted(self.zeros, k, "right") - 1, 0, len(self.high) - 1)
        bit = select_in_word(~self.high[word], k - self.zeros[word]) + 1
        word, bit = np.where(top > 0, word, 0), np.where(top > 0, bit, 0)
        start = word * 64 + bit - top
        word, bit = word + (bit >> 6), bit & 63
        run = np.where(word < len(self.high), _ones_from(self.high[np.minimum(word, len(self.high) - 1)], bit), 0)
        end = start + run
        on = np.nonzero((bit + run == 64) & (word < len(self.high) - 1))[0]  # the ones run on into the next word
        while len(on):
            word[on] += 1
            run = _ones_from(self.high[word[on]], np.zeros(len(on), np.int64))
            end[on] += run
            on = on[(run == 64) & (word[on] < len(self.high) - 1)]
        return np.minimum(start, self.n), np.minimum(end, self.n)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions i."""
        i = np.asarray(i, np.int64)
        if self._ones is None:
            self._ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        word = np.searchsorted(self._ones, i, "right") - 1
        at = word * 64 + select_in_word(self.high[word], i - self._ones[word])
        return ((at - i).astype(U) << U(self.bits)) | self._low(i)

    def _search(self, values: np.ndarray, lo: np.ndarray | None, hi: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the first entries >= the values, ends of the values' buckets, and the values' low bits."""
        tops = (values >> U(self.bits)).astype(np.int64)
        last = int(self.zeros[-1]) - 1
        start, end = self._bucket(np.minimum(tops, last))
        beyond = tops >= last
        start, end = np.where(beyond, self.n, start), np.where(beyond, self.n, end)
        if lo is not None:
            start, end = np.clip(start, lo, hi), np.clip(end, lo, hi)
        part, stop = values & U((1 << self.bits) - 1), end.copy()
        active = np.nonzero(start < end)[0]
        while len(active):
            mid = (start[active] + end[active]) >> 1
            less = self._low(mid) < part[active]
            start[active[less]] = mid[less] + 1
            end[active[~less]] = mid[~less]
            active = active[start[active] < end[active]]
        return start, stop, part

    def successor(self, values: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Position of the first entry >= each value, looked for within [lo, hi) if given."""
        values = np.asarray(values, U)
        return self._search(values, lo, hi)[0] if len(values) else np.zeros(0, np.int64)

    def find(self, values: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Position of each value, -1 where it is not in the sequence: the successor if it lies in the value's bucket and has its low bits."""
        values = np.asarray(values, U)
        if not len(values) or not self.n:
            return np.full(len(values), -1, np.int64)
        at, stop, part = self._search(values, lo, hi)
        found = np.nonzero(at < stop)[0]
        same = self._low(at[found]) == part[found]
        out = np.full(len(values), -1, np.int64)
        out[found[same]] = at[found[same]]
        return out
