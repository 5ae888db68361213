"""Elias-Fano sequences over numpy words, made to be read from a memory map.

A monotone sequence of n values below u keeps the low l = log2(u / n) bits of each in packed form and the rest in unary: a 1 for each
value after as many 0s as its high part. Lookups take arrays of queries at once.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_ONE = U(1)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of so many bits each, one after the other, in 64-bit words."""
    words = np.zeros((len(values) * bits >> 6) + 2, U)
    if bits and len(values):
        at = np.arange(len(values), dtype=U) * U(bits)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        np.bitwise_or.at(words, word, values << shift)
        over = shift + U(bits) > U(64)
        np.bitwise_or.at(words, word[over] + 1, values[over] >> (U(64) - shift[over]))
    return words


def _unpack(words: np.ndarray, bits: int, i: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(i), U)
    at = i.astype(U) * U(bits)
    word, shift = (at >> U(6)).astype(np.int64), at & U(63)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((U(64) - shift) & U(63)), U(0))
    return (low | high) & U((1 << bits) - 1)


def _select(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each word."""
    k, at, word = k.astype(np.int64), np.zeros(len(word), np.int64), word.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(word & U((1 << step) - 1)).astype(np.int64)
        up = k >= low
        k = np.where(up, k - low, k)
        at += up * step
        word = np.where(up, word >> U(step), word)
    return at


class Sequence:
    """n values, of low bits each; ones and zeros before each word of the unary part make the directory."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray, upper: int) -> Sequence:
        """upper: an exclusive bound of the values, which must not fall."""
        values, n = values.astype(U), len(values)
        bits = max(0, (max(1, int(upper)) // max(1, n)).bit_length() - 1)
        tops = (values >> U(bits)).astype(np.int64)
        places = tops + np.arange(n)
        high = np.zeros((((int(upper) >> bits) + n) >> 6) + 2, U)
        np.bitwise_or.at(high, places >> 6, _ONE << (places & 63).astype(U))
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))
        ones = ones.astype(np.uint32 if len(high) < 1 << 26 else np.int64)  # places in the unary part of up to 2^32 bits
        return cls(n, bits, _pack(values & U((1 << bits) - 1), bits), high, ones)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], np.int64), self.low, self.high, self.ones]

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        if not len(i):
            return np.zeros(0, U)
        word = np.searchsorted(self.ones, i.astype(self.ones.dtype), "right") - 1
        at = (word << 6) + _select(self.high[word], i - self.ones[word].astype(np.int64))
        return ((at - i).astype(U) << U(self.bits)) | _unpack(self.low, self.bits, i)

    def successor(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value not below x, whether it is x) among the places from lo to before hi, or among all; hi where there is none.

        The unary part leads to the run of values that share x's high part; their low parts are searched by halves.
        """
        x = x.astype(U)
        top, low = (x >> U(self.bits)).astype(np.int64), x & U((1 << self.bits) - 1)
        start = np.where(top > 0, self._zeros(np.maximum(top - 1, 0)) + 1 - top, 0)  # values before the top-th 0
        end = self._zeros(top) - top
        if lo is not None:
            start, end = np.clip(start, lo, hi), np.clip(end, lo, hi)
        stop = end.copy()
        while len(live := np.flatnonzero(start < stop)):
            mid = (start[live] + stop[live]) >> 1
            less = _unpack(self.low, self.bits, mid) < low[live]
            start[live[less]] = mid[less] + 1
            stop[live[~less]] = mid[~less]
        found = start < end
        found[found] = _unpack(self.low, self.bits, start[found]) == low[found]
        return start, found

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of x, or -1. Most values are settled by the first value with their high part; the others are searched for."""
        x = x.astype(U)
        top, low = (x >> U(self.bits)).astype(np.int64), x & U((1 << self.bits) - 1)
        at = np.where(top > 0, self._zeros(np.maximum(top - 1, 0)) + 1, 0)
        bits = self._two(at)
        place = at - top
        out = np.full(len(x), -1)
        some = np.flatnonzero(bits & U(1))
        value = _unpack(self.low, self.bits, place[some])
        out[some[value == low[some]]] = place[some[value == low[some]]]
        more = some[(value < low[some]) & (bits[some] == U(3))]
        if len(more):
            i, ok = self.successor(x[more])
            out[more[ok]] = i[ok]
        return out

    def _two(self, at: np.ndarray) -> np.ndarray:
        """The bits at a place of the unary part and the next."""
        word, shift = at >> 6, (at & 63).astype(U)
        return ((self.high[word] >> shift) | np.where(shift == 63, self.high[np.minimum(word + 1, len(self.high) - 1)] << U(1), U(0))) & U(3)

    def _zeros(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) 0 of the unary part."""
        before = self._before
        word = np.minimum(np.searchsorted(before, k, "right") - 1, len(self.high) - 1)
        return (word << 6) + _select(~self.high[word], k - before[word])

    @property
    def _before(self) -> np.ndarray:
        if not hasattr(self, "_zeros_before"):
            self._zeros_before = (np.arange(len(self.ones), dtype=np.int64) << 6) - self.ones.astype(np.int64)
        return self._zeros_before


def dump(parts: list[np.ndarray]) -> bytes:
    """Arrays one after the other, each on an 8-byte edge, after a table of their types and places."""
    head, body, at = [], [], 0
    for p in parts:
        raw = np.ascontiguousarray(p).tobytes()
        head.append((ord(p.dtype.kind), p.dtype.itemsize, len(p), at))
        raw += bytes(-len(raw) % 8)
        body.append(raw)
        at += len(raw)
    return np.array([len(parts)], "<i8").tobytes() + np.array(head, "<i8").tobytes() + b"".join(body)


def load(raw: np.ndarray) -> list[np.ndarray]:
    """The arrays of a dump, as views of its bytes (a memory map, say)."""
    n = int(raw[:8].view("<i8")[0])
    head, start = raw[8 : 8 + 32 * n].view("<i8").reshape(n, 4), 8 + 32 * n
    return [raw[start + at : start + at + size * count].view(np.dtype(f"{chr(kind)}{size}")) for kind, size, count, at in head.tolist()]
