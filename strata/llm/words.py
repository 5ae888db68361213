"""Words of many texts at once: their places and 64-bit hashes, by array operations on the bytes of an Arrow column.

A word's hash is a polynomial over table values of its bytes, taken as a difference of running sums, and mixed. A-Z count as a-z.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20_240_601)
_VALUE = _RANDOM.integers(1, 2**64, 256, U)
_VALUE[65:91] = _VALUE[97:123]
_VALUE[_BLANK] = 0
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 18
END, START = (int(x) for x in _RANDOM.integers(1 << 63, 2**64, 2, U))  # no word's hash but by chance


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U)
    p[0] = 1
    return np.multiply.accumulate(p)


_UP, _DOWN = _powers(_BASE, _BLOCK + 1), _powers(pow(_BASE, -1, 2**64), _BLOCK + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words at these places, in blocks of bounded size; a longer word is a block of its own."""
    out, first = np.empty(len(starts), U), 0
    while first < len(starts):
        at = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, at + _BLOCK, "right")))
        n = int(ends[last - 1]) - at
        up, down = (_UP, _DOWN) if n <= _BLOCK else (_powers(_BASE, n + 1), _powers(pow(_BASE, -1, 2**64), n + 1))
        sums = np.zeros(n + 1, U)
        np.cumsum(_VALUE[data[at : at + n]] * up[:n], out=sums[1:])
        s, e = starts[first:last] - at, ends[first:last] - at
        out[first:last] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(U) * U(0xD1B54A32D192ED03))
        first = last
    return out


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of START, words, END of each text, one text after the other; how many words each has). A null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, 8 * column.offset)
    raw = column.buffers()[2]
    data = (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
    edge = offsets[:-1][offsets[1:] > offsets[:-1]] - offsets[0]  # where texts that aren't empty begin
    full = ~_BLANK[data]
    first, last = full.copy(), full.copy()
    first[1:] &= ~full[:-1]
    last[:-1] &= ~full[1:]
    first[edge] = full[edge]
    last[edge[1:] - 1] = full[edge[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    count = np.diff(np.searchsorted(starts, offsets - offsets[0]))
    out = np.empty(len(starts) + 2 * n, U)
    at = np.cumsum(count + 2) - count - 2
    word = np.ones(len(out), bool)
    word[at] = word[at + count + 1] = False
    out[at], out[at + count + 1] = U(START), U(END)
    out[word] = _hashes(data, starts, ends)
    return out, count


def runs(column: pa.Array, limit: int):
    """(first row, slice) of a column in runs of at most limit bytes, or one text."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    done, first = np.cumsum(size), 0
    while first < len(size):
        before = done[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(done, before + limit, "right")))
        yield first, column.slice(first, stop - first)
        first = stop
