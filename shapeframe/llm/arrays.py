"""Words, lines and their hashes over whole Arrow batches, in numpy: no Python step per word.

Texts stay UTF-8 bytes as Arrow delivers them. A hash is multilinear in the bytes (a random odd number for each place,
so the hash of a segment doesn't depend on where it lies), then mixed; it is the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are processed at once, unless one text is longer. Bounds a worker's memory.
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACES = np.random.Generator(np.random.PCG64(20240601)).integers(0, 1 << 64, 4096, dtype=np.uint64) | np.uint64(1)
_SHIFTS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 16, dtype=np.uint64) | np.uint64(1)


def places(n: int) -> np.ndarray:
    """The multipliers of at least n places; always the same ones."""
    global _PLACES
    while len(_PLACES) < n:
        more = np.random.Generator(np.random.PCG64(20240601 + len(_PLACES))).integers(0, 1 << 64, len(_PLACES), dtype=np.uint64)
        _PLACES = np.concatenate([_PLACES, more | np.uint64(1)])
    return _PLACES


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and each row's start (one more at the end). Null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts within the bytes) of consecutive rows of at most CHUNK bytes, or of one longer row."""
    data, at = text_buffer(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, which also break at the rows' starts."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = at[(at > 0) & (at < n)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty segment; segments are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    chosen = values if len(inside) == len(values) else values[inside + np.repeat(starts, lengths)]
    products = (chosen.astype(np.uint64) + np.uint64(1)) * places(int(lengths.max()))[inside]
    return mix(np.add.reduceat(products, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))


class Words:
    """The words of some rows: starts, ends, row of each, hash of each."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False):
        self.data, self.at = (_LOWER[data] if lower else data), at
        self.inside = ~_SPACE[data]
        self.starts, self.ends = runs(self.inside, at)
        self.row = np.searchsorted(at, self.starts, "right") - 1
        self.hash = segment_hashes(self.data, self.starts, self.ends)
        self.count = np.bincount(self.row, minlength=len(at) - 1)
        self.first = np.cumsum(self.count) - self.count

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word windows, and the index of each one's first word."""
        k = len(self.hash) - n + 1
        if k <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(k, np.uint64)
        for i in range(n):
            h += self.hash[i : i + k] * _SHIFTS[i]
        whole = np.flatnonzero(self.row[:k] == self.row[n - 1 :])
        return mix(h[whole]), whole
