"""Elias-Fano sequences: ascending numbers in about two bits each beside their low bits, with access and successor search over arrays of queries."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def _select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th one (from 0) in each 64-bit word, by halving."""
    at, left, k = np.zeros(len(words), np.uint64), words.copy(), k.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = left & np.uint64((1 << width) - 1)
        inside = np.bitwise_count(low).astype(np.int64)
        over = k >= inside
        k -= np.where(over, inside, 0)
        at += np.where(over, np.uint64(width), np.uint64(0))
        left = np.where(over, left >> np.uint64(width), low)
    return at.astype(np.int64)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of `width` bits (under 64), one after the other in 64-bit words."""
    out = np.zeros((len(values) * width + 63) // 64 + 1, np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        values = values.astype(np.uint64)
        np.bitwise_or.at(out, word, values << shift)
        over = np.flatnonzero(shift + np.uint64(width) > np.uint64(64))
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


def read_bits(words: np.ndarray, width: int, index: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(index), np.uint64)
    at = index * width
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    value = words[word] >> shift
    over = np.flatnonzero(shift + np.uint64(width) > np.uint64(64))
    value[over] |= words[word[over] + 1] << (np.uint64(64) - shift[over])
    return value & np.uint64((1 << width) - 1)


class EliasFano:
    """High parts as unary steps in a bitset (a one for each number, a zero after each high part), low bits packed; all in four arrays."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.width, self.low, self.high, self.before = n, width, low, high, before

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """Of ascending unsigned numbers."""
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        steps = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        marks = np.zeros(((top >> width) + n + 2 + 63) // 64 * 64, bool)
        marks[steps] = True
        high = np.packbits(marks, bitorder="little").view("<u8")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.uint32)]).astype(np.uint32)
        return cls(n, width, pack_bits(values & np.uint64((1 << width) - 1), width), high, before)

    def access(self, index: np.ndarray) -> np.ndarray:
        """The numbers at these indices."""
        word = np.searchsorted(self.before, index.astype(np.uint32), side="right") - 1
        at = (word << 6) + _select_in_word(self.high[word], index - self.before[word])
        return ((at - index).astype(np.uint64) << np.uint64(self.width)) | read_bits(self.low, self.width, index)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero (from 0)."""
        zeros = np.arange(len(self.before), dtype=np.int64) * 64 - self.before
        word = np.searchsorted(zeros, k, side="right") - 1
        return (word << 6) + _select_in_word(~self.high[word], k - zeros[word])

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each number, or -1: the successor search within the numbers of the same high part."""
        wanted = wanted.astype(np.uint64)
        out = np.full(len(wanted), -1, np.int64)
        part = (wanted >> np.uint64(self.width)).astype(np.int64)
        last = int(len(self.high) * 64 - int(self.before[-1])) - 1
        ask = np.flatnonzero(part < last) if self.n else np.zeros(0, np.int64)
        if not len(ask):
            return out
        part, rest = part[ask], wanted[ask] & np.uint64((1 << self.width) - 1)
        index = np.where(part > 0, self._zero(np.maximum(part - 1, 0)) - (part - 1), 0)
        end = self._zero(part) - part
        while len(ask):
            open_ = index < end
            ask, index, end, rest = ask[open_], index[open_], end[open_], rest[open_]
            low = read_bits(self.low, self.width, index)
            hit = low == rest
            out[ask[hit]] = index[hit]
            on = low < rest
            ask, index, end, rest = ask[on], index[on] + 1, end[on], rest[on]
        return out

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], np.int64), self.low, self.high, self.before]

    @classmethod
    def from_arrays(cls, head: np.ndarray, low: np.ndarray, high: np.ndarray, before: np.ndarray) -> EliasFano:
        return cls(int(head[0]), int(head[1]), low, high, before)
