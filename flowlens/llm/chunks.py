"""Encoding by parts: texts whose ids are those of their parts in order need each different part encoded only once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

MOST = 200_000  # parts a cache holds before those used once are forgotten: some 40 MB


class ChunkCache:
    """encode(parts) gives the ids of each part, and whether it passed its own check.

    Once it holds more than `most` parts, it keeps those that were looked up again since the last time (half of `most`
    of them, the most used ones) and forgets the rest.
    """

    def __init__(self, encode: Callable[[list], tuple[list[list[int]], list[bool]]], most: int = MOST):
        self.encode_parts = encode
        self.most = most
        self.place: dict = {}
        self.flat, self.edge, self.good, self.uses = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keep the parts that are in use, and count anew."""
        order = np.argsort(-self.uses, kind="stable")[:self.most // 2]
        stay = np.sort(order[self.uses[order] > 1])
        sizes = np.diff(self.edge)[stay]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        self.flat = self.flat[np.arange(total) + np.repeat(self.edge[stay] - (ends - sizes), sizes)]
        self.edge = np.concatenate([[0], ends]).astype(np.int64)
        self.good, self.uses = self.good[stay], np.ones(len(stay), np.int64)
        new = np.full(len(self.place), -1, np.int64)
        new[stay] = np.arange(len(stay))
        self.place = {p: n for p, n in zip(self.place, new.tolist(), strict=True) if n >= 0}

    def add(self, parts: list) -> None:
        ids, good = self.encode_parts(parts)
        n = len(self.place)
        self.place.update(zip(parts, range(n, n + len(parts)), strict=True))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))])
        self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum(sizes)])
        self.good = np.concatenate([self.good, np.array(good, bool)])
        self.uses = np.concatenate([self.uses, np.zeros(len(parts), np.int64)])

    def encode(self, parts: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of texts, whether all parts of a text passed) for the parts of all texts in order

        and the first part of each text, with one more for the end. Equal parts of a batch are looked up once.
        """
        if len(self.place) > self.most:
            self.forget()
        coded = parts.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = coded.dictionary.to_pylist()
        at = np.fromiter(map(self.place.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            n = len(self.place)
            self.add([names[i] for i in missing.tolist()])
            at[missing] = np.arange(n, n + len(missing))
        self.uses[at] += 1 + (np.bincount(which, minlength=len(names)) > 1)
        at = at[which]
        size = self.edge[at + 1] - self.edge[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.edge[at] - (ends - size), size)]
        offsets = np.concatenate([[0], ends])[first]
        bad = np.concatenate([[0], np.cumsum(~self.good[at])])[first]
        return ids, offsets, np.diff(bad) == 0


def fresh(column: pa.Array, table: np.ndarray | None = None) -> pa.Array:
    """The texts in an array of their own that begins at 0 (some Arrow kernels misread slices), nulls empty, bytes mapped by table."""
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    raw = raw.copy() if table is None else table[raw]
    return pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer((offsets - offsets[0]).copy()), pa.py_buffer(raw)])
