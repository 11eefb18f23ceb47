"""Words of an Arrow text column as 64-bit hashes, in whole-column numpy steps.

A word is a run of bytes other than space and \\t to \\r. Hashes are position-weighted sums over
random byte codes modulo 2**64, mixed; two different words agree with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (a bijection)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@lru_cache(None)
def _codes() -> np.ndarray:
    return np.random.default_rng(20240501).integers(0, 2**63, 256, dtype=U) * U(2) + U(1)


_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 2**64)
        full = np.full(max(n, _SEGMENT + 65536), base, dtype=U)
        full[0] = 1
        have = np.cumprod(full)
        if n <= _SEGMENT + 65536:
            _powers[kind] = have
    return have[:n]


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 bounds of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, np.int64, n + 1 + column.offset)[column.offset :] if bounds is not None and n else np.zeros(n + 1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; other bytes stay."""
    return data + ((data >= 65) & (data <= 90)).view(np.uint8) * np.uint8(32)


def spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; no word crosses a row's bound."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    start, end = ink.copy(), ink.copy()
    start[1:] &= ~ink[:-1] | first[1:-1]
    end[:-1] &= ~ink[1:] | first[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span (spans in order, without overlap), in segments of bounded memory."""
    out = np.empty(len(start), U)
    codes, i = _codes(), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _SEGMENT, side="right")))
        low, high = int(start[i]), int(end[j - 1])
        n = high - low
        total = np.zeros(n + 1, U)
        np.cumsum(codes[data[low:high]] * _power("up", n), out=total[1:])
        s, e = start[i:j] - low, end[i:j] - low
        out[i:j] = (total[e] - total[s]) * _power("down", n)[s] + (e - s).astype(U)
        i = j
    return mix(out)


def hashed(column, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a column, and the n + 1 bounds of the rows' words."""
    data, at = raw(column)
    if lower:
        data = lower_ascii(data)
    start, end = spans(data, at)
    return hash_spans(data, start, end), np.searchsorted(start, at)


def pieces(column, most: int = 8 << 20):
    """Slices (first row, column part) of at most ``most`` bytes of text, but a row at least."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    size = np.concatenate(([0], np.cumsum(_lengths(column))))
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(size, size[i] + most, side="right")) - 1)
        j = min(j, i + 65535)
        yield i, column.slice(i, j - i)
        i = j


def _lengths(column) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


@lru_cache(None)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Hand memory that is free, but still held by the allocators of Arrow and the C library, back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def releasing(run):
    """``run``, a function of Arrow batches or of one Arrow table, that leaves no free memory with its idle worker."""

    @wraps(run)
    def wrapped(given):
        if not isinstance(given, pa.Table):
            return _then_release(run(given))
        out = run(given)
        release()
        return out

    return wrapped


def _then_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    try:
        yield from batches
    finally:
        release()


class WordRows:
    """Row numbers for the word hashes seen so far by this worker, in sorted arrays of bounded size.

    Only a store of results that are the same for a word wherever it stands; ``most`` bounds memory, not work.
    """

    def __init__(self, most: int = 2_000_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows, self.count = np.zeros(0, U), np.zeros(0, np.int64), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        if not self.count:
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), self.count - 1)
        return np.where(self.keys[at] == keys, self.rows[at], -1)

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Rows for sorted distinct keys that aren't there yet."""
        rows = np.arange(self.count, self.count + len(keys))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, at, keys), np.insert(self.rows, at, rows)
        self.count += len(keys)
        return rows
