"""Quality rules by repetition coverage: characters inside repeated n-grams of words and repeated lines, in numpy.

All n-grams of a piece of the batch are hashed at once from hashes of words; within a text equal hashes are found by one
sort. An n-gram is repeated if it occurs twice or more in its text; a character counts once however many repeated
n-grams cover it, the first occurrence included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm import spans
from flowlens.llm.tables import arrow

# Largest share of a text's characters inside repeated n-grams of words, and inside repeated lines: fixed values, as
# published by Rae et al. (2021), table A1.
MOST = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MOST_LINES = 0.20
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
NEWLINE = 0x0A


def per_row(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[edge[1:]] - total[edge[:-1]]


def repeated(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more in their row, and which follow an equal one."""
    order = np.lexsort((key, row))
    same = (row[order][1:] == row[order][:-1]) & (key[order][1:] == key[order][:-1])
    later, any_ = np.zeros(len(row), bool), np.zeros(len(row), bool)
    later[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, later


def covered(hits: np.ndarray, at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Words 0..n that lie in one of the windows of k words that begin at `at` and are hits."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at[hits], 1)
    np.add.at(change, at[hits] + k, -1)
    return np.cumsum(change[:-1]) > 0


def measure(column, lengths: tuple[int, ...] = tuple(MOST)) -> dict[str, np.ndarray]:
    out: dict[str, list] = {}
    for _, data, offsets in spans.pieces(column):
        w = spans.words(data, offsets)
        row = w.row
        head = (data & 0xC0) != 0x80
        chars = np.concatenate([[0], np.cumsum(head & ~spans.SPACE[data], dtype=np.int64)])
        size = chars[w.end] - chars[w.start]
        found = {"n_words": np.diff(w.first), "word_chars": per_row(size, w.first), "n_symbols": per_row(SYMBOLS[data], offsets)}
        h = spans.range_hashes(data, w.start, w.end)
        for k in lengths:
            win, edge = spans.windows(h, w.first, k)
            count = np.diff(edge)
            at = np.arange(len(win)) + np.repeat(w.first[:-1] - edge[:-1], count)
            hits, _ = repeated(row[at], win)
            inside = covered(hits, at, k, len(h))
            if k == 5:
                found["n_repeat_words"] = per_row(inside, w.first)
            found[f"chars_{k}"] = per_row(np.where(inside, size, 0), w.first)
        # lines: from each row start or newline to the next newline or row end
        breaks = np.flatnonzero(data == NEWLINE)
        full = np.flatnonzero(np.diff(offsets) > 0)
        start = np.sort(np.concatenate([offsets[full], breaks + 1]))
        end = np.sort(np.concatenate([offsets[full + 1], breaks]))
        line_row = np.searchsorted(offsets, np.minimum(start, end), "right") - 1
        letters = chars[end] - chars[start]
        keep = letters > 0
        start, end, line_row, letters = start[keep], end[keep], line_row[keep], letters[keep]
        any_, later = repeated(line_row, spans.range_hashes(data, start, end))
        rows = len(offsets) - 1
        found["n_dup_lines"] = np.bincount(line_row, later, minlength=rows).astype(np.int64)
        found["chars_lines"] = np.bincount(line_row, np.where(any_, letters, 0), minlength=rows).astype(np.int64)
        for name, values in found.items():
            out.setdefault(name, []).append(values)
    return {name: np.concatenate(values).astype(np.int64) for name, values in out.items()}


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[f"chars_{k}" for k in MOST], "chars_lines"]


def coverage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts, base_failed, kept, covered characters) of each row. A null or empty text has zeros and fails.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated windows of 5. kept: not so, and no
    coverage above its share in MOST or MOST_LINES.
    """

    def run(batch):
        found = measure(batch.column(1)) if batch.num_rows else {n: [] for n in NAMES}
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[n], pa.int64()) for n in NAMES]], ["doc_id", *NAMES])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    got = arrow(rows, run, ", ".join(["doc_id long", *[f"{n} long" for n in NAMES]]))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    high = F.lit(False)
    for name, most in [*((f"chars_{k}", m) for k, m in MOST.items()), ("chars_lines", MOST_LINES)]:
        high = high | (100 * F.col(name) > round(100 * most) * F.col("word_chars"))
    more = [n for n in NAMES if n.startswith("chars_")]
    return got.select("doc_id", *[n for n in NAMES if n not in more], failed.alias("base_failed"), (~failed & ~high).alias("kept"), *more)
