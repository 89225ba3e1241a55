"""Vectorised word shingles: whole columns of text as one byte stream, hashed without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestone.llm.hashing import mix, span_hashes

#: Bytes that part words: space, and tab to carriage return.
GAPS = np.zeros(256, bool)
GAPS[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that are handled at a time; a longer text is handled alone.
STREAM = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the column's UTF-8 bytes, offsets of its rows); null rows are empty."""
    texts = pc.fill_null(column, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_utf8())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0]


def runs(batches: Iterator[pa.RecordBatch], column: int, most: int = STREAM) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``most`` bytes of text in ``column``."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size, dtype=np.int64)
        a = 0
        while a < len(total):
            e = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
            yield b.slice(a, e - a)
            a = e


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of every word, in order, and the words of each row."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    inside = ~GAPS[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    rows = at[:-1][np.diff(at) > 0]
    begin[rows] = inside[rows]
    a = np.flatnonzero(begin)
    stop = np.zeros(n + 1, bool)
    stop[:n] = ~inside
    stop[at[1:]] = True  # a row's end also ends its last word
    stops = np.flatnonzero(stop)
    b = stops[np.searchsorted(stops, a, "right")] if len(a) else a
    row = np.searchsorted(at, a, "right") - 1
    return row, span_hashes(LOWER[raw], a, b), np.bincount(row, minlength=len(at) - 1)


def shingle_sets(column: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each row's distinct k-word shingles in ascending order of hash.

    A row of fewer than k words has its whole sequence as one; a row without words has none.
    """
    raw, at = text_bytes(column)
    row, h, n = words(raw, at)
    first = np.cumsum(n) - n
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), count)
    start = first[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    end = np.where(n[owner] >= k, start + k, first[owner] + n[owner])
    # word hashes are the characters of a second stream, so any run of words hashes alike
    g = span_hashes(h, start, end)
    o = np.lexsort((g, owner))
    g, owner = g[o], owner[o]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[new], owner[new]
    return g, np.searchsorted(owner, np.arange(len(n) + 1))


def set_prints(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each row's set."""
    total = np.zeros(len(g) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(g ^ np.uint64(0x9E3779B97F4A7C15)), out=total[1:])
        return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))
