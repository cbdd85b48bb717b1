"""Vectorised text access: Arrow string buffers as numpy arrays, words as spans and hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):
    _trim = None  # another C library

CHUNK_BYTES = 2 << 20
#: Where a worker's temporaries are many times the text.
FEW_BYTES = 1 << 19

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 12, 13, 32]] = True
IS_INK = ~IS_SPACE
IS_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    IS_WORD[_a:_b] = True
IS_WORD[95] = True

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_pow = _inv = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n at least."""
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << (n - 1).bit_length()
        out = []
        for base in (_P, _PINV):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(a))
        _pow, _inv = out
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def give_back() -> None:
    """Memory that is free goes back to the system: workers live on, and would keep the most that any task took."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as one large-offset-free Arrow array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.string()) if not pa.types.is_string(column.type) else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null and empty texts have length 0."""
    column = text_array(column)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together stay near ``most`` bytes (one row at least)."""
    n = len(column)
    if n == 0:
        return
    _, offsets = buffers(column)
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(n, max(start + 1, end))
        yield start, end
        start = end


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of table bytes within each text: starts, ends, text of each."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    m = table[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = m[:-1]
    starts = np.flatnonzero(m & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = m[1:]
    ends = np.flatnonzero(m & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span lies."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    powers, inverse = _tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def run_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` successive values (len - width + 1 of them)."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    powers, inverse = _tables(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * powers[:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * inverse[: n - width + 1])


def per_text(text_of: np.ndarray, n_texts: int) -> np.ndarray:
    """Where each text's spans begin in a span array (n_texts + 1 entries)."""
    return np.searchsorted(text_of, np.arange(n_texts + 1))


def sums_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]] for each i, 0 where that is empty."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
