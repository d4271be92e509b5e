"""Words and word n-grams of Arrow string batches as 64-bit hashes, computed on the bytes of the batch with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)

#: Bytes that are worked on at once; one longer text is a piece of its own.
PIECE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about PIECE_BYTES in all; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int64, count=n + 1, offset=column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + PIECE_BYTES, "right")) - 1)
        last = min(last, n)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each word of a piece."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are not empty and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    picked = data[within + np.repeat(starts, lengths)]
    terms = (picked.astype(np.uint64) + np.uint64(1)) * powers(_BASE, int(lengths.max()))[within]
    return mix(np.add.reduceat(terms, first))


def words(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word."""
    starts, ends, row = word_spans(data, at)
    return span_hashes(_LOWER[data] if lower else data, starts, ends), row


def grams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of ``n`` words of one row."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = len(hashes) - n + 1
    total = np.zeros(count, np.uint64)
    for k in range(n):
        total = total * _STEP + hashes[k : k + count]
    first = np.flatnonzero(row[:count] == row[n - 1 :])
    return mix(total[first]), first


def shingles(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each shingle, in row order; a row with fewer than ``n`` words has one shingle of all its words."""
    long_hash, first = grams(hashes, row, n)
    long_row = row[first]
    rows, start, count = np.unique(row, return_index=True, return_counts=True)
    short = count < n
    if not short.any():
        return long_hash, long_row
    extra = np.array(
        [np.bitwise_xor.reduce(mix(hashes[s : s + c] + powers(_STEP, c))) for s, c in zip(start[short], count[short])], np.uint64
    )
    every, where = np.concatenate((long_hash, extra)), np.concatenate((long_row, rows[short]))
    order = np.argsort(where, kind="stable")
    return every[order], where[order]


def counted(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, row) with its count, sorted by row and hash."""
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return hashes[first], row[first], np.diff(np.append(first, len(hashes)))
