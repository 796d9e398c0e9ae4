"""Numpy views of Arrow text columns: words, hashes of words and shingles, in bounded pieces.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20  # bytes of text handled at once, more only for one longer text
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_RNG = np.random.default_rng(0x5EED)
BYTE_VALUE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
ODD = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * PIECE:
            _POWERS[base] = have
    return have[:n]


def pieces(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets within the bytes) for runs of rows of about PIECE bytes. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        to = min(to, n)
        yield at, raw[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


@dataclass
class Words:
    """Words of a piece: byte ranges, row of each word, and the first word of each row (one more than rows)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range: equal bytes, equal hash."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(BASE, n), out=sums[1:])
    h = (sums[end] - sums[start]) * powers(BASE_INVERSE, n + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * ODD[63])


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words of a row, and the first window of each row (one more than rows)."""
    n = np.diff(first)
    count = np.maximum(n - k + 1, 0)
    if len(hashes) < k:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    total = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        total += hashes[i:len(hashes) - k + 1 + i] * ODD[i]
    edge = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(edge[-1]) + np.repeat(first[:-1] - edge[:-1], count)
    return mix(total[at]), edge


def shingle_sets(column, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles: lower case, a shorter text as one shingle."""
    for _, data, offsets in pieces(column):
        w = words(data, offsets, lower=True)
        h = range_hashes(w.data, w.start, w.end)
        win, edge = windows(h, w.first, k)
        for r in range(len(offsets) - 1):
            a, b = edge[r], edge[r + 1]
            if b > a:
                yield np.unique(win[a:b])
            elif w.first[r + 1] > w.first[r]:
                own = h[w.first[r]:w.first[r + 1]]
                yield mix((own * ODD[:len(own)]).sum(keepdims=True) + np.uint64(len(own)))
            else:
                yield np.zeros(0, np.uint64)
