"""Elias-Fano sequences over numpy words: compact monotone integers with vectorised access and successor search.

A sequence of n values below u keeps the low ``floor(log2(u/n))`` bits of each value packed, and the high bits as a bit
vector in which value i sets bit ``high + i``. Directories of the ones and zeros before each 64-bit word answer select.
Arrays are taken as they are, so a memory-mapped file is read only where a query touches it.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_ALL = U64(0xFFFFFFFFFFFFFFFF)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` low bits of each value one after another in 64-bit words (one spare word at the end)."""
    n = len(values)
    words = np.zeros(n * width // 64 + 2, U64)
    if not width or not n:
        return words
    values = values.astype(U64) & (_ALL >> U64(64 - width))
    at = np.arange(n, dtype=np.int64) * width
    word, shift = at >> 6, (at & 63).astype(U64)
    np.bitwise_or.at(words, word, values << shift)
    over = np.flatnonzero(shift.astype(np.int64) + width > 64)
    np.bitwise_or.at(words, word[over] + 1, values[over] >> (U64(64) - shift[over]))
    return words


def unpack_bits(words: np.ndarray, width: int, index: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(index), U64)
    at = index.astype(np.int64) * width
    word, shift = at >> 6, (at & 63).astype(U64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
    return (low | high) & (_ALL >> U64(64 - width))


_ONES = U64(0x0101010101010101)
_TOPS = U64(0x8080808080808080)
#: Place of the one with k ones before it in byte v, at 8 v + k.
_IN_BYTE = np.zeros(2048, np.uint8)
for _v in range(256):
    for _k, _place in enumerate(k for k in range(8) if _v >> k & 1):
        _IN_BYTE[8 * _v + _k] = _place


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the one with ``rank`` ones before it: the byte by running sums of all bytes at once, then a table."""
    rank = rank.astype(U64)
    sums = words - ((words >> U64(1)) & U64(0x5555555555555555))
    sums = (sums & U64(0x3333333333333333)) + ((sums >> U64(2)) & U64(0x3333333333333333))
    sums = ((sums + (sums >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * _ONES
    shift = np.bitwise_count(((rank * _ONES | _TOPS) - sums) & _TOPS).astype(U64) << U64(3)
    rank -= ((sums << U64(8)) >> shift) & U64(0xFF)
    byte = (words >> shift) & U64(0xFF)
    return (shift + _IN_BYTE[(byte << U64(3)) + rank]).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence. ``parts`` and ``from_parts`` give and take its arrays, for files."""

    NAMES = ("head", "low", "high", "ones", "zeros")

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits = int(head[0]), int(head[1])
        self.low, self.high, self.ones, self.zeros = low, high, ones, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, U64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, ((top + 1) // max(1, n)).bit_length() - 1)
        high_values = (values >> U64(low_bits)).astype(np.int64)
        size = n + (top >> low_bits) + 2
        high = np.zeros(size // 64 + 1, U64)
        at = high_values + np.arange(n, dtype=np.int64)
        np.bitwise_or.at(high, at >> 6, U64(1) << (at & 63).astype(U64))
        kind = np.int32 if len(high) < 1 << 24 else np.int64
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        zeros = np.arange(len(ones)) * 64 - ones
        return cls(np.array([n, low_bits], U64), pack_bits(values, low_bits), high, ones.astype(kind), zeros.astype(kind))

    def parts(self, name: str) -> dict[str, np.ndarray]:
        arrays = (np.array([self.n, self.low_bits], U64), self.low, self.high, self.ones, self.zeros)
        return {f"{name}.{part}": array for part, array in zip(self.NAMES, arrays)}

    @classmethod
    def from_parts(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        return cls(*[arrays[f"{name}.{part}"] for part in cls.NAMES])

    def _select1(self, rank: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, rank.astype(self.ones.dtype), side="right") - 1
        return word * 64 + _select_in_word(self.high[word], rank - self.ones[word])

    def _select0(self, rank: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, rank.astype(self.zeros.dtype), side="right") - 1
        return word * 64 + _select_in_word(~self.high[word], rank - self.zeros[word])

    def _after(self, place: np.ndarray, rank: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the one (or zero) of ``rank``, the next after ``place``; mostly in the same word."""
        at = place + 1
        word = at >> 6
        bits = self.high[word]
        bits = (bits if ones else ~bits) >> (at & 63).astype(U64)
        out = at + np.bitwise_count((bits & (~bits + U64(1))) - U64(1))
        far = np.flatnonzero(bits == 0)
        if len(far):
            out[far] = (self._select1 if ones else self._select0)(rank[far])
        return out

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        index = np.asarray(index, np.int64)
        high = (self._select1(index) - index).astype(U64)
        return (high << U64(self.low_bits)) | unpack_bits(self.low, self.low_bits, index)

    def ranges(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at ``index`` and at the places after."""
        index = np.asarray(index, np.int64)
        place = self._select1(index)
        after = self._after(place, index + 1, True)
        low = U64(self.low_bits)
        first = ((place - index).astype(U64) << low) | unpack_bits(self.low, self.low_bits, index)
        second = ((after - index - 1).astype(U64) << low) | unpack_bits(self.low, self.low_bits, index + 1)
        return first.astype(np.int64), second.astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of the first element equal to each value, or -1."""
        values = np.asarray(values, U64)
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        high = (values >> U64(self.low_bits)).astype(np.int64)
        inside = np.flatnonzero((high >= 0) & (high < self.zeros[-1]))
        if not len(inside):
            return out
        high = high[inside]
        low = values[inside] & ((U64(1) << U64(self.low_bits)) - U64(1))
        before = np.where(high > 0, self._select0(np.maximum(high - 1, 0)), -1)
        begin = before - high + 1
        end = self._after(before, high, False) - high
        stop = end.copy()
        live = np.flatnonzero(begin < end)
        while len(live):  # halve the runs of equal high bits
            middle = (begin[live] + end[live]) >> 1
            less = unpack_bits(self.low, self.low_bits, middle) < low[live]
            begin[live] = np.where(less, middle + 1, begin[live])
            end[live] = np.where(less, end[live], middle)
            live = live[begin[live] < end[live]]
        some = np.flatnonzero(begin < stop)  # the high bits are equal within a run
        some = some[unpack_bits(self.low, self.low_bits, begin[some]) == low[some]]
        out[inside[some]] = begin[some]
        return out


def quantise(values: np.ndarray, bins: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """One-byte codes and the mean value of each code, by equal counts over the distinct values."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(bins, np.float32)
    distinct = np.unique(values)
    edges = distinct[np.linspace(0, len(distinct), min(bins, len(distinct)), endpoint=False).astype(np.int64)]
    codes = np.searchsorted(edges, values, side="right") - 1
    totals, counts = np.bincount(codes, values, bins), np.bincount(codes, minlength=bins)
    return codes.astype(np.uint8), (totals / np.maximum(counts, 1)).astype(np.float32)
