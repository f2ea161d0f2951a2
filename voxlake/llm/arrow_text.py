"""Vectorised word hashing over Arrow string arrays.

A word is a maximal run of bytes above 0x20, so ASCII white space and control bytes
separate words and every other character belongs to one. Hashes are 64-bit and depend on
the word's bytes alone, never on the batch or on the row that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: Rows are cut into slices of about this many text bytes, which bounds a task's memory.
SLICE_BYTES = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64; kept and grown between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * len(have) if have is not None else 4096)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        _powers[base] = have = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits of the result are usable."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length + 1) of a string array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


class Words(NamedTuple):
    hashes: np.ndarray  # one a word
    first: np.ndarray  # index of each row's first word, and the total at the end
    row: np.ndarray  # the row of each word
    start: np.ndarray  # byte positions in body
    end: np.ndarray
    body: np.ndarray


#: 0 separates words; of the others, punctuation differs from what words are made of.
_KIND = np.array([0 if b <= 32 else 2 if b < 128 and not chr(b).isalnum() else 1 for b in range(256)], np.uint8)


def words(column: pa.Array, punctuation: bool = False) -> Words:
    """The words of each row; with punctuation, runs of ASCII punctuation are words of their own."""
    body, at = raw(column)
    n = len(body)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(at), np.int64), empty, empty, empty, body)
    kind = _KIND[body] if punctuation else (body > 32).view(np.uint8)
    edge = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[at] = True
    solid = kind > 0
    start, end = solid & edge[:-1], solid & edge[1:]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=total[1:])
    hashes = mix((total[end] - total[start]) * powers(_INV, n)[start])
    first = np.searchsorted(start, at)
    return Words(hashes, first, np.repeat(np.arange(len(at) - 1), np.diff(first)), start, end, body)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n words within a row, and the index of each run's first word."""
    count = len(w.hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(count, np.uint64)
    for k in range(n):
        total *= np.uint64(_BASE)
        total += w.hashes[k : k + count]
    where = np.flatnonzero(w.row[:count] == w.row[n - 1 : n - 1 + count])
    return mix(total[where] + np.uint64(n)), where


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about limit bytes of text each; a longer row is alone."""
    texts = batch.column(batch.schema.get_field_index(column))
    _, at = raw(texts)
    low = 0
    while low < batch.num_rows:
        high = int(np.searchsorted(at, at[low] + limit, "right")) - 1
        high = min(max(high, low + 1), batch.num_rows)
        yield batch.slice(low, high - low)
        low = high


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list array of rows with so many values each."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values))
