"""Vectorised kernels over Arrow string columns.

All kernels work on the UTF-8 bytes of many texts at once.  A column is cut
into runs of whole texts of about ``CHUNK`` bytes, so that temporary arrays
stay small and bounded by the longest single text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (SplitMix64)."""
    x = x ^ (x >> _S30)
    x *= _M1
    x ^= x >> _S27
    x *= _M2
    x ^= x >> _S31
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    base = (seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(base))


BYTE_VALUE, OTHER_VALUE = randoms(256, 11), randoms(256, 14)
_P = int(randoms(1, 12)[0]) | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**k and P**-k modulo 2**64 for k below n at least."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)

        def table(p: int) -> np.ndarray:
            out = np.full(size, p, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        _powers = (table(_P), table(_PINV))
    return _powers


class RangeHash:
    """64-bit hash of any byte range of one buffer, by prefix sums."""

    def __init__(self, data: np.ndarray, values: np.ndarray | None = None):
        n = len(data)
        up, self.down = powers(n + 1)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum((BYTE_VALUE if values is None else values)[data] * up[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def as_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n, buffers = len(column), column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def byte_class(inside) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[b for b in range(256) if inside(b)]] = True
    return table


#: What the contracts call words.
PLAIN_WORD = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
ALNUM_WORD = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, per-row offsets) of the maximal runs of bytes in ``table``; runs end with their text."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


_WINDOW = randoms(64, 13) | np.uint64(1)


def windows(word_hash: np.ndarray, row_offsets: np.ndarray, size: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every ``size`` consecutive words of a row, per-row offsets).

    With ``short``, a row of fewer words but not none has its whole sequence as one window.
    """
    counts = np.diff(row_offsets)
    n = len(word_hash)
    full = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        full += word_hash[k : k + len(full)] * _WINDOW[k]
    per_row = np.maximum(counts - size + 1, 0)
    keep = np.zeros(n + 1, np.int32)
    has = per_row > 0
    np.add.at(keep, row_offsets[:-1][has], 1)
    np.add.at(keep, row_offsets[:-1][has] + per_row[has], -1)
    hashes = mix(full[np.cumsum(keep)[: len(full)] > 0])
    if not short:
        return hashes, np.concatenate(([0], np.cumsum(per_row)))
    few = np.flatnonzero((counts > 0) & (counts < size))
    out_rows = per_row.copy()
    out_rows[few] = 1
    offsets = np.concatenate(([0], np.cumsum(out_rows)))
    if not len(few):
        return hashes, offsets
    out = np.empty(offsets[-1], np.uint64)
    is_short = np.zeros(len(out), bool)
    is_short[offsets[few]] = True
    out[~is_short] = hashes
    for i in few:
        a, b = row_offsets[i], row_offsets[i + 1]
        own = (word_hash[a:b] * _WINDOW[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
        out[offsets[i]] = mix(np.array([own ^ np.uint64(0x5DEECE66D)], np.uint64))[0]
    return out, offsets


def code_points(data: np.ndarray) -> np.ndarray:
    """True where a code point starts."""
    return (data & 0xC0) != 0x80


def batch_of(schema_names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=schema_names)


def fixed_width(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) bytes of a binary column of values of one length, without nulls."""
    column = column.cast(pa.binary(width))
    return np.frombuffer(column.buffers()[1], np.uint8, len(column) * width, column.offset * width).reshape(-1, width)


def released(run):
    """A function over Arrow batches that gives its worker's freed memory back to the system when a task ends: workers stay, and would keep the most that they ever used."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped
