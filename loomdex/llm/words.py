"""Words of a group of texts as arrays: one pass over the bytes, no string per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of a word: ASCII letters and digits, and every byte of a longer code point.
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
#: Bytes that are not ASCII white space.
VISIBLE = np.ones(256, bool)
VISIBLE[[32, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of Latin-1 (two bytes in UTF-8) in lower case."""
    low = LOWER[raw]
    capital = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
    low[capital] += 32
    return low


def spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and row numbers of the runs of `inside` bytes; runs end with their row.

    `raw` holds the rows end to end, `offsets` their bounds in it.
    """
    m = inside[raw]
    if not len(m):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = offsets[offsets < len(m)]
    first = m.copy()
    first[1:] &= ~m[:-1]
    first[edge] = m[edge]
    last = m.copy()
    last[:-1] &= ~m[1:]
    edge = offsets[offsets > 0] - 1
    last[edge] = m[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(offsets, starts, side="right") - 1


_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_CODE = np.array([(k * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % (1 << 64) for k in range(1, 257)], np.uint64)
_CODE = (_CODE ^ (_CODE >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
_CODE = (_CODE ^ (_CODE >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def hashed(low: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each whole run, whatever its length: differences of running sums of a polynomial."""
    if not len(starts):
        return np.zeros(0, np.int64)
    power = np.full(len(low), _BASE, np.uint64)
    power[0] = 1
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_CODE[low] * np.cumprod(power), out=sums[1:])
    power[1:] = _UNBASE
    h = (sums[starts + size] - sums[starts]) * np.cumprod(power)[starts] + size.astype(np.uint64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ (h >> np.uint64(33))).view(np.int64)


def strings(low: np.ndarray, starts: np.ndarray, size: np.ndarray) -> pa.Array:
    """The runs as a binary Arrow column."""
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], size)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(low[at])])


def packed(low: np.ndarray, starts: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """The first n <= 6 bytes of each run as one integer; shorter runs end in zeros."""
    padded = np.concatenate([low, np.zeros(n, np.uint8)])
    out = np.zeros(len(starts), np.int64)
    for j in range(n):
        b = padded[starts + j].astype(np.int64)
        b[size <= j] = 0
        out = (out << 8) | b
    return out
