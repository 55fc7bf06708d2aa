"""Vectorised text kernels: word and shingle hashes of Arrow string columns, in blocks of bounded size.

A block holds whole texts of about ``BLOCK_BYTES`` together, so that the working arrays of a task stay small
whatever the size of the Arrow batch is. Hashes are 64 bits wide and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

DELIMITER = np.zeros(256, bool)
DELIMITER[[9, 10, 11, 12, 13, 32]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = np.random.default_rng(20240608).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2**64."""
    if len(_tables[0]) < n:
        size = max(n, BLOCK_BYTES * 2)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _tables[k] = np.cumprod(table, dtype=np.uint64)
    return _tables[0][:n], _tables[1][:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[s:e] for every pair (s, e), by prefix sums of base powers; values: uint64 per position."""
    up, down = _powers(len(values) + 1)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string (or large binary) column and the n+1 offsets of its values; nulls are empty."""
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), where


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets into them) of runs of whole texts of about limit bytes."""
    data, where = string_bytes(column)
    row, n = 0, len(where) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(where, where[row] + limit, "right")) - 1)
        yield row, end, data[where[row] : where[end]], where[row : end + 1] - where[row]
        row = end


def words(data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z in lower case, split at ASCII white space) and the n+1 offsets of each text's words."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(where), np.int64)
    low = ASCII_LOWER[data]
    inside = ~DELIMITER[low]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[where[:-1][where[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    cuts = where[1:-1] - 1
    after[cuts[cuts >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return range_hashes(_BYTE_VALUE[low], starts, ends), np.searchsorted(starts, where)


def shingles(word: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of each text and their offsets; a text of 1 to k-1 words is one shingle."""
    counts = np.diff(at)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_at = np.concatenate(([0], np.cumsum(sizes)))
    whole = np.zeros(len(word), np.uint64)
    if len(word) >= k:
        for j in range(k):
            whole[: len(word) - k + 1] += word[j : len(word) - k + 1 + j] * _PLACE[j]
    # position of each shingle's first word: text start + 0, 1, ...
    first = np.repeat(at[:-1] - out_at[:-1], sizes) + np.arange(out_at[-1])
    out = whole[first]
    for t in np.flatnonzero((counts > 0) & (counts < k)):
        few = word[at[t] : at[t + 1]]
        out[out_at[t]] = np.sum(few * _PLACE[: len(few)], dtype=np.uint64) + np.uint64(len(few))
    return mix(out), out_at


def sorted_sets(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order, and offsets."""
    values = values.copy()
    for s, e in zip(at[:-1], at[1:], strict=True):
        values[s:e].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[at[:-1][at[:-1] < len(values)]] = True
    total = np.concatenate(([0], np.cumsum(fresh)))
    return values[fresh], total[at]


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i+1]] for each i, 0 for empty ranges."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    return total[at[1:]] - total[at[:-1]]


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return values.view(np.int64)
