"""Line deduplication by a segment-partition edit join.

A line of n bytes is cut into `edits + 1` segments. Whoever is within `edits` edits of it holds one of the segments
unchanged, at a place that its length allows; so each line is indexed under (length, segment number, segment) and probes
the few substrings that can match, for its own and the shorter lengths. Matches are confirmed by a banded bit-parallel
edit distance. Edits are counted over UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm import spans
from flowlens.llm.tables import arrow, keep, with_ids

EDITS = 2
MIN_BYTES = 20  # shorter lines are too common in clean prose to be told apart by two edits; they are left alone
RUN = 512  # lines under one signature that are paired at once
WORD = r"[^\x20\x09-\x0D]"
SEEN = 1 << 20  # hashes of lines a task remembers, so as not to emit a common line again and again


def segments(n: np.ndarray, edits: int = EDITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, length) of each segment of lines of n bytes: nearly equal ones, the longer ones last."""
    short = n // (edits + 1)
    longer = n - short * (edits + 1)
    out = []
    for i in range(edits + 1):
        first_longer = edits + 1 - longer
        out.append((i * short + np.maximum(i - first_longer, 0), short + (i >= first_longer)))
    return out


def probes(n: np.ndarray, edits: int = EDITS):
    """(segment number, indexed length, start, length) of each substring of lines of n bytes that may equal a segment."""
    for delta in range(edits + 1):
        shorter = n - delta
        for i, (start, size) in enumerate(segments(shorter, edits)):
            # edits left and right of the segment are limited: multi-match-aware bounds on the shift
            low = max(-i, delta - (edits - i))
            high = min(i, delta + (edits - i))
            for shift in range(low, high + 1):
                yield i, shorter, start + shift, size


def edit_distance(a: bytes, b: bytes, most: int = EDITS) -> int:
    """Edit distance of two byte strings, or most + 1 if it is larger.

    Equal ends are cut off first. The rest is walked along its diagonal with a bit vector of 2 * most + 1 rows, after
    Hyyro: vertical differences are bits, and the band moves down one row a column.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    if len(a) > len(b):
        a, b = b, a
    end = len(a)
    if end > 64:
        x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        diff = np.flatnonzero(x != y[:end])
        at = int(diff[0]) if len(diff) else end
        diff = np.flatnonzero(x[at:][::-1] != y[len(b) - (end - at):][::-1])
        tail = int(diff[0]) if len(diff) else end - at
    else:
        at = 0
        while at < end and a[at] == b[at]:
            at += 1
        tail = 0
        while tail < end - at and a[end - 1 - tail] == b[len(b) - 1 - tail]:
            tail += 1
    a, b = a[at:end - tail], b[at:len(b) - tail]
    if not a:
        return len(b)
    width = 2 * most + 1
    mask = (1 << width) - 1
    # bit r of column j is row j - most + r; rows above the first one match nothing
    vp, vn, score, rows = mask ^ ((1 << most) - 1), 0, min(most, len(a)), len(a)
    for j, char in enumerate(b):
        eq, low = 0, j - most
        for row in range(max(low, 0), min(j + most + 1, rows)):
            if a[row] == char:
                eq |= 1 << (row - low)
        d0 = ((((eq & vp) + vp) & mask) ^ vp) | eq | vn
        hp = vn | (mask & ~(d0 | vp))
        hn = d0 & vp
        down = d0 >> 1
        vp = hn | (mask & ~(down | hp))
        vn = down & hp
        if j + most < rows:  # the lowest cell of the band moves along its diagonal
            score += not d0 >> (width - 1) & 1
            if score > 3 * most:
                return most + 1
        else:  # it has reached the last row and moves along that
            bit = width - 2 - (j + most - rows)
            score += (hp >> bit & 1) - (hn >> bit & 1)
    return min(score, most + 1)


def line_columns(text_col: str = "text"):
    """Lines of a text, each with its number, and the 62 + 64 bits that name it."""
    return F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")


def lines_of(docs: DataFrame, id_col: str, text_col: str, short: bool = False) -> DataFrame:
    """(doc_id, line_no, line, h1, h2) of every line of MIN_BYTES or more, with short of shorter ones with a word too, of rows with an id."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), line_columns(text_col))
    wanted = F.octet_length("line") >= MIN_BYTES
    return rows.where(wanted | F.col("line").rlike(WORD) if short else wanted).select("doc_id", "line_no", "line", *names("line"))


def first_short_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fresh): numbers of the lines under MIN_BYTES with a word that stand nowhere before, of documents that have any."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), line_columns(text_col))
    rows = rows.where((F.octet_length("line") < MIN_BYTES) & F.col("line").rlike(WORD)).select("doc_id", "line_no", *names("line"))
    places = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("at"))
    return places.groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.collect_set("at.line_no").alias("fresh"))


def names(col: str):
    return F.xxhash64(col).bitwiseAND(F.lit(-4)).alias("h1"), F.xxhash64(F.lit(1), F.col(col)).alias("h2")


def signatures(lines: DataFrame, edits: int) -> DataFrame:
    """(sig, who, odd): under which segments and substrings a line is indexed and probes.

    who is the line's h1 with 1 (indexed), 2 (probes) or 3 in its low bits; odd is the parity of its byte pairs on 64
    bits, of which one edit changes four at most.
    """

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            h1 = batch.column(0).to_numpy()
            fresh = np.zeros(len(h1), bool)
            fresh[np.unique(h1, return_index=True)[1]] = True
            for at in np.flatnonzero(fresh):
                fresh[at] = int(h1[at]) not in seen
            if len(seen) > SEEN:
                seen.clear()
            seen.update(h1[fresh].tolist())
            batch = batch.filter(pa.array(fresh))
            names_ = batch.column(0).to_numpy().view(np.uint64)
            for at, data, offsets in spans.pieces(batch.column(1)):
                yield one(names_[at:at + len(offsets) - 1], data, offsets)

    def one(who, data, offsets):
        begin, n = offsets[:-1], np.diff(offsets)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(spans.BYTE_VALUE[data] * spans.powers(spans.BASE, len(data)), out=sums[1:])
        inverse = spans.powers(spans.BASE_INVERSE, len(data) + 1)
        two = data.astype(np.uint64) * spans.ODD[1]
        two[:-1] += data[1:].astype(np.uint64) * spans.ODD[2]
        pair = np.uint64(1) << (spans.mix(two) >> np.uint64(58))
        pair[offsets[1:] - 1] = 0
        odd = np.bitwise_xor.reduceat(pair, begin)
        sig, side, line = [], [], []

        def add(i, length, start, size, kind):
            ok = np.flatnonzero((start >= 0) & (start + size <= n) & (size > 0))
            s = (begin + start)[ok]
            h = (sums[s + size[ok]] - sums[s]) * inverse[s]
            sig.append(spans.mix(h + length[ok].astype(np.uint64) * spans.ODD[3] + np.uint64([i]) * spans.ODD[4]))
            side.append(np.full(len(ok), kind, np.uint64))
            line.append(ok)

        for i, (start, size) in enumerate(segments(n, edits)):
            add(i, n, start, size, 3)
        own = [start for start, _ in segments(n, edits)]
        for i, length, start, size in probes(n, edits):
            if length is not n and not (length == n).all() or not (start == own[i]).all():
                add(i, length, start, size, 2)
        at = np.concatenate(line)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array((who[at] | np.concatenate(side)).view(np.int64)),
                                           pa.array(odd[at].view(np.int64))], ["sig", "who", "odd"])

    return lines.select("h1", "line").mapInArrow(run, "sig long, who long, odd long")


def meetings(rows: DataFrame, keys: list[str], edits: int) -> DataFrame:
    """Pairs (a, b) of lines under one signature, of which one is indexed and the other probes.

    Runs of equal keys stream past in bounded pieces. A run of more than RUN lines is handed on as (sig, who, odd).
    """
    most = 4 * edits

    def pairs(key, who, odd):
        """Pairs within runs: each row with those 1, 2, ... places on, as long as any run goes on."""
        edge = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0), [True]])
        starts = np.flatnonzero(edge)
        run_end = np.repeat(starts[1:], np.diff(starts))
        at = np.arange(len(who))
        side, name = who & 3, who & ~np.int64(3)
        a, b = [], []
        step = 1
        while len(at := at[at + step < run_end[at]]):
            x, y = at, at + step
            ok = (name[x] != name[y]) & ((side[x] | side[y]) == 3) & (np.bitwise_count((odd[x] ^ odd[y]).view(np.uint64)) <= most)
            a.append(np.minimum(name[x], name[y])[ok])
            b.append(np.maximum(name[x], name[y])[ok])
            step += 1
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def result(a, b, over=None):
        n, m = len(a), 0 if over is None else len(over[0])
        nothing = pa.nulls(n, pa.int64())
        cols = [pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(m, pa.int64())]) for x in (a, b)]
        cols += [pa.concat_arrays([nothing, pa.array(over[i], pa.int64())]) if m else nothing for i in range(3)]
        return pa.RecordBatch.from_arrays(cols, ["a", "b", "sig", "who", "odd"])

    tiled = len(keys) > 1

    def run(batches):
        rest = None
        large = None  # the key of a run that is being handed on
        for batch in batches:
            rows_ = np.stack([c.to_numpy() for c in batch.columns])
            rows_ = rows_ if rest is None else np.concatenate([rest, rows_], axis=1)
            key = rows_[:len(keys)]
            if large is not None:
                n = int((key == large[:, None]).all(0).argmin()) if not (key == large[:, None]).all() else key.shape[1]
                if n:
                    yield result([], [], rows_[-3:, :n])
                rest = rows_[:, n:]
                if not rest.shape[1]:
                    continue
                rows_, large = rest, None
                key = rows_[:len(keys)]
            edge = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            done = int(edge[-1]) if len(edge) else 0
            if done:
                yield from finish(rows_[:, :done])
            rest = rows_[:, done:]
            if rest.shape[1] > RUN and not tiled:
                large = rest[:len(keys), 0].copy()
                yield result([], [], rest[-3:])
                rest = rest[:, :0]
        if rest is not None and rest.shape[1]:
            yield from finish(rest)

    def finish(rows_):
        key = rows_[:len(keys)]
        if not tiled:
            starts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1])
            size = np.diff(np.append(starts, rows_.shape[1]))
            if size.max() > RUN:
                over = np.repeat(size > RUN, size)
                yield result([], [], rows_[-3:, over])
                rows_ = rows_[:, ~over]
                if not rows_.shape[1]:
                    return
        yield result(*pairs(rows_[:len(keys)], rows_[-2], rows_[-1]))

    dealt = rows.select(*keys, "sig", "who", "odd") if tiled else rows.select("sig", "who", "odd")
    if tiled:
        schema_rows = dealt.select(*keys, "who", "odd")
        return schema_rows.repartition(*keys).sortWithinPartitions(*keys, "who").mapInArrow(run, "a long, b long, sig long, who long, odd long").select("a", "b")
    return dealt.repartition("sig").sortWithinPartitions("sig", "who").mapInArrow(run, "a long, b long, sig long, who long, odd long")


def tiles(over: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) within large runs: each is dealt into blocks, and every pair of blocks is one bounded piece of work."""
    sizes = over.groupBy("sig").agg(F.ceil(F.count("*") / (RUN // 2)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("who"), F.col("blocks")).cast("int")
    rows = (over.join(sizes, "sig").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("sig", F.least("block", "other").cast("long").alias("i"), F.greatest("block", "other").cast("long").alias("j"), "who", "odd"))
    return meetings(rows, ["sig", "i", "j"], edits)


def links(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(h1, h2, g1, g2): every two different lines within `edits` edits, both ways round."""
    met = keep(meetings(signatures(lines, edits), ["sig"], edits), "line-pairs", 10000)
    pairs = met.where("a IS NOT NULL").select("a", "b").union(tiles(met.where("sig IS NOT NULL").select("sig", "who", "odd").distinct(), edits))
    pairs = keep(pairs.distinct(), "line-candidates", 10000)
    ids = pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).distinct()
    texts = keep(with_ids(lines.select("h1", "h2", "line"), ids, "h1").groupBy("h1", "h2").agg(F.first("line").alias("line")), "line-texts")

    def run(batch):
        good = [i for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True))
                if edit_distance(x.as_buffer().to_pybytes(), y.as_buffer().to_pybytes(), edits) <= edits]
        return batch.select([0, 1, 2, 3]).take(pa.array(good, pa.int64()))

    left = texts.select(F.col("h1").alias("a"), F.col("h2").alias("a2"), F.col("line").alias("la"))
    right = texts.select(F.col("h1").alias("b"), F.col("h2").alias("b2"), F.col("line").alias("lb"))
    near = F.abs(F.octet_length("la") - F.octet_length("lb")) <= edits
    full = pairs.join(left, "a").join(right, "b").where(near).select("a", "a2", "b", "b2", "la", "lb")
    good = arrow(full, run, "h1 long, h2 long, g1 long, g2 long")
    return keep(good.union(good.select("g1", "g2", "h1", "h2")).distinct(), "line-links", 10000)


def line_verdicts(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """(doc_id, line_no, h1, h2, class_doc_id, class_line_no, n_links, kept) of every line of MIN_BYTES or more.

    short: shorter lines with a word have rows too: classes of equal lines, never linked.

    Equal lines are one class, named by its first place (smallest doc_id, then line number). Two classes are linked if
    their lines differ by `edits` edits at most. A line stays if it stands at its class's first place and no linked
    class begins earlier. Rows without id or text have no lines; rows that repeat an id keep or lose a line together.
    """
    lines = lines_of(docs, id_col, text_col)
    narrow = keep(lines_of(docs, id_col, text_col, short).select("doc_id", "line_no", "h1", "h2"), "lines", 10000)
    classes = keep(narrow.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("at")), "line-classes", 10000)
    linked = links(lines, edits).join(classes.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("at").alias("other")), ["g1", "g2"])
    linked = linked.groupBy("h1", "h2").agg(F.count("*").alias("n_links"), F.min("other").alias("earliest"))
    classes = keep(classes.join(linked, ["h1", "h2"], "left"), "line-linked", 10000)
    place = F.struct("doc_id", "line_no")
    return narrow.join(classes, ["h1", "h2"]).select(
        "doc_id", "line_no", "h1", "h2", F.col("at.doc_id").alias("class_doc_id"), F.col("at.line_no").alias("class_line_no"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), ((place == F.col("at")) & (F.col("earliest").isNull() | (F.col("earliest") > F.col("at")))).alias("kept"))


def drop_repeated_lines(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text", drop_empty: bool = True,
                        length_col: str | None = None) -> DataFrame:
    """docs with repeated lines cut from the texts, other columns unchanged.

    A document that lost lines goes if drop_empty holds and nothing new is left of it: only white space and lines under
    MIN_BYTES that stand at an earlier place already. One that lost no line always stays, with its short lines.
    length_col: a column that is set to the code points of texts that were cut.
    """
    gone = line_verdicts(docs, edits, id_col, text_col).where("NOT kept").groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    gone_col, fresh_col, key = "__gone_lines", "__fresh_lines", "__gone_id"
    if drop_empty:
        gone = gone.join(first_short_lines(docs, id_col, text_col), "doc_id", "left")
    else:
        gone = gone.withColumn("fresh", F.lit(None).cast("array<int>"))
    gone = gone.select(F.col("doc_id").alias(key), F.col("gone").alias(gone_col), F.col("fresh").alias(fresh_col))
    lines = F.split(text_col, "\\n")
    rest = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone_col, i)), "\n")
    new = F.filter(lines, lambda x, i: ~F.array_contains(gone_col, i) & x.rlike(WORD) & ((F.octet_length(x) >= MIN_BYTES) | F.coalesce(F.array_contains(fresh_col, i), F.lit(False))))
    out = docs.join(gone, docs[id_col] == gone[key], "left")
    if drop_empty:
        out = out.where(F.col(gone_col).isNull() | (F.size(new) > 0))
    out = out.withColumn(text_col, F.when(F.col(gone_col).isNull(), F.col(text_col)).otherwise(rest))
    if length_col:
        out = out.withColumn(length_col, F.when(F.col(gone_col).isNull(), F.col(length_col)).otherwise(F.length(text_col).cast("long")))
    return out.select(*docs.columns)
