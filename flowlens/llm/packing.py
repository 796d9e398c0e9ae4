"""Best-fit packing of token pieces into sequences of one size, by exact complements of lengths.

Which lengths go together is decided on how many pieces there are of each length: `size` numbers, whatever the corpus.
Lengths and the sums of two and of three lengths are indexed by sum. From the longest piece down, combinations of one,
two or three other lengths that fill the gap exactly are consumed, as often as there are pieces of all of them. What is
left is packed with a new index: the longest piece, then the longest that fits (the best fit), until the gap is filled
exactly by a combination or nothing fits. A combination is a pattern; every step uses it up, so the plan holds some
thousand patterns at most. Pieces are then numbered within their length, and the number says which sequence they go to.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from flowlens.llm.tables import keep
from flowlens.llm.token_files import run_encoder

SIZE = 2048
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
Pattern = tuple[list[tuple[int, int]], int]  # (length, times) by falling length, and the number of sequences of this kind


class Sums:
    """Lengths that are there, alone and as sums of two and three, by sum. Counts only fall, so entries only go."""

    def __init__(self, left: np.ndarray):
        self.left = left
        size = len(left)
        there = left > 0
        self.pairs: list[np.ndarray] = []  # by sum: the longer of two, ascending
        for total in range(size):
            longer = np.arange((total + 1) // 2, total)
            self.pairs.append(longer[there[longer] & there[total - longer]])
        least = np.array([p[0] if len(p) else size for p in self.pairs])
        self.triples: list[np.ndarray] = []  # by sum: the longest of three, ascending
        for total in range(size):
            longest = np.arange((total + 2) // 3, total - 1)
            self.triples.append(longest[there[longest] & (least[total - longest] <= longest)])
        self.pair_ends = [len(p) for p in self.pairs]
        self.triple_ends = [len(t) for t in self.triples]

    def enough(self, lengths: tuple[int, ...], used: Counter) -> bool:
        need = Counter(lengths)
        return all(self.left[x] >= n + used[x] for x, n in need.items())

    def pair(self, total: int, used: Counter, most: int, also: tuple[int, ...] = ()) -> tuple[int, int] | None:
        """Two lengths of this sum, the longer one as long as possible but at most `most`."""
        own = self.pairs[total]
        while self.pair_ends[total] and not (self.left[own[self.pair_ends[total] - 1]] and self.left[total - own[self.pair_ends[total] - 1]]):
            self.pair_ends[total] -= 1
        for i in range(min(self.pair_ends[total], int(np.searchsorted(own, most, "right"))) - 1, -1, -1):
            found = int(own[i]), int(total - own[i])
            if self.left[found[0]] and self.left[found[1]] and self.enough(found + also, used):
                return found
        return None

    def exact(self, gap: int, used: Counter, most: int = 3) -> tuple[int, ...] | None:
        """One, two or three lengths (at most `most`) of this sum beside the used ones."""
        if most and self.enough((gap,), used):
            return (gap,)
        if most > 1 and (two := self.pair(gap, used, gap)) is not None:
            return two
        if most < 3:
            return None
        own = self.triples[gap]
        while self.triple_ends[gap] and not self.left[own[self.triple_ends[gap] - 1]]:
            self.triple_ends[gap] -= 1
        for i in range(self.triple_ends[gap] - 1, -1, -1):
            longest = int(own[i])
            if self.left[longest] and (two := self.pair(gap - longest, used, longest, (longest,))) is not None:
                return longest, *two
        return None


def plan(counts: np.ndarray) -> list[Pattern]:
    """Patterns for counts[n] pieces of n tokens, n up to the size of a sequence: of combinations of up to three, two, one

    or no lengths those that give the fewest sequences. Where few pieces are short, filling every gap with three of them
    would leave none for the wider gaps.
    """
    return min((plan_with(counts, most) for most in (3, 2, 1, 0)), key=lambda p: sum(times for _, times in p))


def plan_with(counts: np.ndarray, most: int) -> list[Pattern]:
    size = len(counts) - 1
    left = counts.astype(np.int64).copy()
    patterns: list[Pattern] = []

    def consume(own: Counter) -> None:
        times = min(int(left[x]) // n for x, n in own.items())
        for x, n in own.items():
            left[x] -= times * n
        patterns.append((sorted(own.items(), reverse=True), times))

    if left[size]:
        consume(Counter([size]))
    sums, rest = Sums(left), np.zeros_like(left)
    for n in range(size - 1, 0, -1):
        while left[n] and 2 * n > size and (others := sums.exact(size - n, Counter([n]), most)) is not None:
            consume(Counter([n, *others]))
        if 2 * n > size:
            rest[n], left[n] = left[n], 0  # nothing fills its gap; no shorter piece can have it beside it either
    left += rest
    sums = Sums(left)
    for n in range(size - 1, 0, -1):
        while left[n]:
            own, gap = Counter([n]), size - n
            while gap:
                if (others := sums.exact(gap, own, most)) is not None:
                    own.update(others)
                    break
                x = min(gap, n)
                while x and left[x] <= own[x]:
                    x -= 1
                if not x:
                    break
                own[x] += 1
                gap -= x
            consume(own)
    return patterns


class Slots:
    """The plan by length: the k-th piece of a length goes to a sequence and an offset."""

    def __init__(self, patterns: list[Pattern]):
        used, rows, first = Counter(), [], 0
        for lengths, times in patterns:
            offset = 0
            for x, n in lengths:
                rows.append((x << 44 | used[x], first, n, offset))
                used[x] += n * times
                offset += n * x
            first += times
        self.sequences = first
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.key, self.first, self.times, self.offset = table.T.copy()

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """number: from 0 within the length, below 2^44."""
        key = length << 44 | number
        at = np.searchsorted(self.key, key, "right") - 1
        k = key - self.key[at]
        return self.first[at] + k // self.times[at], self.offset[at] + k % self.times[at] * length


def cut(batches: Iterator[pa.RecordBatch], tokenizer: str, size: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of (id, text) batches."""
    encoder = run_encoder(tokenizer)
    for batch in batches:
        flat, off = encoder.encode(batch.column(1))
        flat = np.insert(flat, off[1:], end_id).astype("<u4")
        off = off + np.arange(len(off))
        n = np.diff(off)
        each = -(-n // size)
        row = np.repeat(np.arange(len(n)), each)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        start = piece * size
        length = np.minimum(size, n[row] - start)
        begin = off[:-1][row] + start
        crc = [zlib.crc32(flat[a:a + k]) for a, k in zip(begin.tolist(), length.tolist(), strict=True)]
        out = [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:  # pieces stand in order and without gaps
            out.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(flat)).astype(np.int32)), pa.array(flat.astype(np.int32))))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(out, names)


def number(batches: Iterator[pa.RecordBatch], length_col: str, size: int) -> Iterator[pa.RecordBatch]:
    """Rows with the task's number and their own number among the task's rows of their length."""
    seen, part = np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
    for batch in batches:
        length = batch.column(batch.schema.get_field_index(length_col)).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(length) and not (1 <= length.min() and length.max() <= size):
            raise ValueError(f"lengths must be from 1 to {size}")
        order = np.argsort(length, kind="stable")
        times = np.bincount(length, minlength=size + 1)
        nth = np.empty(len(length), np.int64)
        nth[order] = np.arange(len(length)) - np.repeat(np.cumsum(times) - times, times)
        nth += seen[length]
        seen += times
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int64)), pa.array(nth)], [*batch.schema.names, "__part", "__nth"])


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def placed(numbered: DataFrame, length_col: str, size: int) -> DataFrame:
    """The rows of a written table of `number`, with sequence_id and offset instead of __part and __nth.

    A length's rows of one task follow those of the tasks before; the counts by task and length are a table of their own.
    """
    counts = keep(numbered.groupBy("__part", F.col(length_col).alias("__length")).agg(F.count("*").alias("n")), "piece-counts")
    total = np.zeros(size + 1, np.int64)
    for row in counts.groupBy("__length").agg(F.sum("n").alias("n")).collect():  # one row a length: size at most
        total[row["__length"]] = row["n"]
    slots = Slots(plan(total))
    before = Window.partitionBy("__length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__part", "__length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    rows = numbered.withColumn("__length", F.col(length_col)).join(base, ["__part", "__length"]).withColumn("__nth", F.col("__before") + F.col("__nth"))
    rows = rows.drop("__part", "__length", "__before")

    def run(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index(length_col)).to_numpy(zero_copy_only=False).astype(np.int64)
            at = batch.schema.get_field_index("__nth")
            sequence, offset = slots.place(length, batch.column(at).to_numpy())
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(sequence), pa.array(offset)],
                                             [*(c for i, c in enumerate(batch.schema.names) if i != at), "sequence_id", "offset"])

    return rows.mapInArrow(run, f"{schema_of(rows.drop('__nth'))}, sequence_id long, offset long")


def pack(pieces: DataFrame, size: int = SIZE, length_col: str = "length") -> DataFrame:
    """pieces (any columns) with the sequence and the offset of each: sequences of at most `size`, without gaps from 0.

    Lengths are integers from 1 to size; others, null too, are an error. Equal rows are pieces of their own. Columns
    named sequence_id or offset are replaced. An empty table gives an empty one.
    """
    rows = pieces.drop("sequence_id", "offset")
    numbered = rows.mapInArrow(lambda batches: number(batches, length_col, size), f"{schema_of(rows)}, __part long, __nth long")
    return placed(keep(numbered, "numbered-pieces"), length_col, size)


def packed(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of every piece of every row of docs.

    A document is the ids of its text and end_id; longer ones than size are cut into pieces of it, the last as it comes.
    A null text is empty, one token; a null id stays null; rows that repeat are documents of their own; other columns
    are left out. No document is too long: it has as many pieces as it needs.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    numbered = rows.mapInArrow(lambda batches: number(cut(batches, tokenizer, size, end_id, with_ids), "length", size),
                               f"{PIECE}{', ids array<int>' if with_ids else ''}, __part long, __nth long")
    return placed(keep(numbered, "numbered-pieces"), "length", size)


def sequences(rows: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets) of packed rows with ids: one row a sequence, of at most `size` tokens."""
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return rows.groupBy("sequence_id").agg(own.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))
