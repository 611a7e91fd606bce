"""Tokens of Arrow text columns, counted within each row.

A row's tokens are those of `functions.text.tokens`.  Rows of ASCII words are counted
over the bytes of many rows at once; rows with CJK characters take the expressions.
Words are told apart by 64 bits of a polynomial over their bytes, within one row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..errors import LimitExceeded
from .text import CJK_RANGES, LOWER, MAX_TERM_BYTES, UPPER

#: Bytes of the rows that are counted together, and of the words that are hashed together.
GROUP, BLOCK = 1 << 18, 1 << 16
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True
#: First bytes of the three-byte characters that may be CJK.
_LEAD = np.zeros(256, bool)
_LEAD[[0xE1, *range(0xE3, 0xEE), 0xEF]] = True
_CJK = "[" + "".join(rf"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES) + "]"
_PIECES = re.compile(_CJK + "+|[a-z0-9]{2,}")
_TO_LOWER = str.maketrans(UPPER, LOWER)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_CODE = np.random.default_rng(60325).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> list[str]:
    """Tokens of one text, in order."""
    out = []
    for piece in _PIECES.findall(text.translate(_TO_LOWER)):
        if piece[0].isascii() or len(piece) == 1:
            out.append(piece)
        else:
            out += [piece[i : i + 2] for i in range(len(piece) - 1)]
    return out


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row ends of a string column, read where they lie; only a column with nulls is copied."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), ends.astype(np.int64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_BASE, BLOCK), _powers(_UNBASE, BLOCK)


def _hashes(low: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of words in ascending order, over blocks of about BLOCK bytes or one longer word."""
    h = np.zeros(len(starts), np.uint64)
    stop = starts + size
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(stop, starts[a] + BLOCK, side="right")))
        lo, n = starts[a], int(stop[b - 1] - starts[a])
        up, down = (_UP, _DOWN) if n <= BLOCK else (_powers(_BASE, n), _DOWN)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[low[lo : lo + n]] * up[:n], out=sums[1:])
        at = starts[a:b] - lo
        h[a:b] = (sums[at + size[a:b]] - sums[at]) * down[at]
        a = b
    h += size.astype(np.uint64)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def hash_of(word: str) -> int:
    """The hash that `counted` gives an ASCII word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0])


class Counted:
    """Words of a run of rows: `row`, `hash` and `tf` of each row's distinct ASCII words, by row;
    `lengths`, the number of tokens of each row; `wide`, the token counts of rows with CJK characters."""

    def __init__(self, column: pa.Array, raw: np.ndarray, ends: np.ndarray, first: int, last: int):
        part = raw[ends[first] : ends[last]]
        off = ends[first : last + 1] - ends[first]
        n = last - first
        cjk = np.unique(np.searchsorted(off, np.flatnonzero(_LEAD[part]), side="right") - 1)
        self.wide = {int(i): Counter(words_of(column[first + int(i)].as_py())) for i in cjk}
        self.low = _LOW[part]
        inside = _WORD[self.low]
        if len(inside):
            start, stop = inside.copy(), inside.copy()
            start[1:] &= ~inside[:-1]
            stop[:-1] &= ~inside[1:]
            edge = off[(off > 0) & (off < len(inside))]
            start[edge] = inside[edge]
            stop[edge - 1] = inside[edge - 1]
            starts = np.flatnonzero(start)
            size = np.flatnonzero(stop) + 1 - starts
        else:
            starts = size = np.zeros(0, np.int64)
        row = np.searchsorted(off, starts, side="right") - 1
        keep = size >= 2
        if len(cjk):
            keep &= ~np.isin(row, cjk)
        starts, size, row = starts[keep], size[keep], row[keep]
        if len(size) and size.max() > MAX_TERM_BYTES:
            raise LimitExceeded("a term passes the size limit")
        self.lengths = np.bincount(row, minlength=n)
        for i, c in self.wide.items():
            self.lengths[i] = c.total()
        h = _hashes(self.low, starts, size) if len(starts) else np.zeros(0, np.uint64)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        at = np.flatnonzero(new)
        self.row, self.hash = row[at], h[at]
        self.tf = np.diff(np.append(at, len(row)))
        self.starts, self.size = starts[order][at], size[order][at]

    def strings(self) -> pa.Array:
        """The words as a string column."""
        ends = np.concatenate([[0], np.cumsum(self.size)])
        at = np.arange(ends[-1]) + np.repeat(self.starts - ends[:-1], self.size)
        data = pa.py_buffer(np.ascontiguousarray(self.low[at]))
        return pa.LargeStringArray.from_buffers(len(self.size), pa.py_buffer(ends.astype(np.int64)), data).cast(pa.string())


def counted(column: pa.Array) -> Iterator[tuple[int, int, Counted]]:
    """First row, row after the last, and words of runs of about GROUP bytes of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw, ends = _buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = min(max(int(np.searchsorted(ends, ends[i] + GROUP, side="right")) - 1, i + 1), n)
        yield i, j, Counted(column, raw, ends, i, j)
        i = j
