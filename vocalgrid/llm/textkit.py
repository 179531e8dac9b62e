"""Words of whole Arrow batches as numpy arrays: where they stand, whose they are, 64-bit hashes.

Texts are worked on in slices of bounded size (``slices``), so memory follows the slice and the longest
single text, never the batch. Word hashes are polynomials over the bytes modulo 2^64, mixed; equal words
have equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

# Space, tab, newline, vertical tab, form feed, carriage return.
ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept for slices of the usual size."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        steps = np.full(max(n, SLICE_BYTES * 2), base, dtype=np.uint64)
        steps[0] = 1
        kept = np.cumprod(steps, dtype=np.uint64)
        if len(kept) <= SLICE_BYTES * 8:
            _powers[base] = kept
    return kept[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """Words of consecutive texts: byte ``start``/``end`` in ``data``, ``text`` index, ``hash``; ``first[i]:first[i+1]`` are text i's."""

    data: np.ndarray
    ends: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, text ends within the bytes); nulls are empty texts."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    buffer = array.buffers()[2]
    flat = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(array):
        j = max(int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1, i + 1)
        yield i, j, flat[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]
        i = j


def words_of(data: np.ndarray, ends: np.ndarray, separators: np.ndarray = ASCII_SPACE) -> Words:
    """Maximal runs of bytes that are no separators, never across two texts."""
    n = len(data)
    inside = ~separators[data]
    starts_text = np.zeros(n + 1, dtype=bool)
    starts_text[0] = True
    starts_text[ends] = True
    before = np.concatenate([[False], inside[:-1]]) if n else inside
    after = np.concatenate([inside[1:], [False]]) if n else inside
    start = np.flatnonzero(inside & (~before | starts_text[:n]))
    end = np.flatnonzero(inside & (~after | starts_text[1:])) + 1
    text = np.searchsorted(ends, start, side="right")
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), dtype=np.uint64)])
    raw = (sums[end] - sums[start]) * powers(_INVERSE, n)[start] if n else np.zeros(0, dtype=np.uint64)
    first = np.searchsorted(text, np.arange(len(ends) + 1))
    return Words(data, ends, start, end, text, mix(raw), first)


def windows_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window of ``size`` words inside one text, and the window's hash."""
    n = len(words.hash)
    if n < size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.flatnonzero(words.text[: n - size + 1] == words.text[size - 1 :])
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        total = mix(total * np.uint64(BASE) + words.hash[at + k])
    return at, total


def per_text(values: np.ndarray, at: np.ndarray, texts: int) -> np.ndarray:
    """Sum of ``values`` per text index ``at``."""
    return np.bincount(at, weights=values, minlength=texts).astype(np.int64)
