"""Whole texts as flat byte arrays: words, and 64-bit hashes of any run of bytes or words, in numpy.

A polynomial over a random byte table gives the hash of ``data[s:e]`` from two prefix sums, so that
words, shingles and fixed windows all cost a few array operations over the bytes of a slice of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE, UNBASE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=U)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32  # A-Z to lower case; bytes of other letters stay


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


SPACES = separators((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


@lru_cache(maxsize=4)
def _powers(n: int, inverse: bool) -> np.ndarray:
    out = np.full(n, UNBASE if inverse else BASE, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    return _powers(1 << max(16, int(n).bit_length()), inverse)[:n]


def slices(lengths: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes together; one long row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def parts(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of a column."""
    data, ends = texts(column)
    for a, b in slices(np.diff(ends), limit):
        yield a, b, data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]


def prefix(data: np.ndarray) -> np.ndarray:
    out = np.empty(len(data) + 1, U)
    out[0] = 0
    np.cumsum(TABLE[data] * powers(len(data)), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each ``data[start:end]``; its length counts too."""
    return mixed((sums[end] - sums[start]) * powers(len(sums), True)[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, ends: np.ndarray, seps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word of the rows; no word crosses rows."""
    n = len(data)
    inside = ~seps[data]
    left = np.zeros(n + 1, bool)  # a word may start or must have ended here
    left[ends] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | left[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | left[1:])) + 1
    return start, end, np.searchsorted(ends, start, side="right") - 1


def fold_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    factor = 1
    for k in range(width):
        factor = factor * 0xD1342543DE82EF95 % (1 << 64)
        out += values[k : k + n] * U(factor)
    return mixed(out)
