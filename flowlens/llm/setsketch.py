"""SetSketch registers for near-duplicate search: sketches, bands, joint likelihood estimate, exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm import spans
from flowlens.llm.tables import arrow, components, keep, with_ids

B = 1.02  # ratio of neighbouring register levels
RATE = 20.0  # rate of the exponential variates: keeps levels above zero for any set
LEVELS = 65534
ROWS, BANDS = 5, 30  # registers in a band, bands
M = ROWS * BANDS
PARITY = 1024  # bits of the parity sketch
TILE = 1024  # documents of a bucket that are compared with so many others at a time: under 1 MB a side
_RNG = np.random.default_rng(0xB0B)
MULTIPLY = (_RNG.integers(0, 1 << 31, M, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
ADD = _RNG.integers(0, 1 << 32, M, dtype=np.uint32)


def levels(minima: np.ndarray) -> np.ndarray:
    """Registers of uniform minima: the exponential variate of each, on a scale of powers of B, truncated."""
    u = (minima.astype(np.float64) + 0.5) / 2.0**32
    h = -np.log1p(-u) / RATE
    return np.clip(np.floor(1.0 - np.log(h) / np.log(B)), 0, LEVELS + 1).astype(np.uint16)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set of 64-bit hashes; the sketch of a union is the larger of each register."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(M, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        part = x[None, at:at + 2048] * MULTIPLY[:, None]
        part += ADD[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return levels(low)


def parity(hashes: np.ndarray) -> np.ndarray:
    """Bit i tells whether an odd number of hashes falls on i. Two sets differ in at least as many elements as bits."""
    return np.packbits((np.bincount((hashes & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)).view(np.uint64)


def may_reach(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """False where the parity sketches or the sizes prove 100 * intersection < percent * union. Never false for a link."""
    apart = np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)
    apart = np.maximum(apart, np.abs(na - nb))
    return apart * (100 + percent) <= (100 - percent) * (na + nb)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row of registers."""
    parts = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * spans.ODD[40]
    for i in range(ROWS):
        key = spans.mix(key + parts[:, :, i] * spans.ODD[i])
    return key.view(np.int64)


def likelihood_jaccard(greater: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray, m: int = M) -> np.ndarray:
    """Most likely Jaccard similarity of sets of known sizes, from how many registers of a are greater and less than b's."""
    u, v = na / (na + nb), nb / (na + nb)
    equal = m - greater - less

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    def score(j):
        up, down = p(u - v * j), p(v - u * j)
        return greater * np.log(np.maximum(up, 1e-300)) + less * np.log(np.maximum(down, 1e-300)) + equal * np.log(np.maximum(1 - up - down, 1e-300))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = score(a) > score(b)
        high, low = np.where(left, b, high), np.where(left, low, a)
    return (low + high) / 2


def least_estimate(threshold: float) -> float:
    """Estimates below this belong to pairs at the threshold less than once in 100,000 times (4.5 deviations)."""
    return threshold - 4.5 * float(np.sqrt(threshold * (1 - threshold) / M))


def registers_of(column: pa.Array, kind=np.uint16, width: int = M) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def parities_of(column: pa.Array) -> np.ndarray:
    return registers_of(column, np.uint64, PARITY // 64)


def sketches(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, k1, k2, registers, odd) of each row: set size, 128 bits that name the set, its registers and parity sketch."""

    def run(batch):
        n, k1, k2, reg, odd = [], [], [], [], []
        for s in spans.shingle_sets(batch.column(1), k):
            n.append(len(s))
            k1.append(int(s.sum().astype(np.uint64).view(np.int64)) if len(s) else 0)
            k2.append(int(spans.mix(s * spans.ODD[50]).sum().astype(np.uint64).view(np.int64)) if len(s) else 0)
            reg.append(sketch(s).tobytes() if len(s) else b"")
            odd.append(parity(s).tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                                           pa.array(reg, pa.binary()), pa.array(odd, pa.binary())], ["id", "n", "k1", "k2", "registers", "odd"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return arrow(rows, run, "id long, n long, k1 long, k2 long, registers binary, odd binary")


def estimated(pairs: DataFrame, regs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may still reach the threshold, with the likelihood estimate."""
    least = least_estimate(percent / 100)

    def run(batch):
        if not batch.num_rows:
            return None
        na, nb = batch.column(3).to_numpy(), batch.column(6).to_numpy()
        at = pa.array(np.flatnonzero(may_reach(parities_of(batch.column(4)), parities_of(batch.column(7)), na, nb, percent)))
        batch = batch.take(at)
        ra, rb = registers_of(batch.column(2)), registers_of(batch.column(5))
        est = likelihood_jaccard((ra > rb).sum(1), (ra < rb).sum(1), na[at].astype(float), nb[at].astype(float))
        at = np.flatnonzero(est >= least)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(est[at])], ["a", "b", "estimate"])

    def side(name):
        return regs.select(F.col("id").alias(name), F.col("registers").alias("r" + name), F.col("n").alias("n" + name), F.col("odd").alias("o" + name))

    full = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "na", "oa", "rb", "nb", "ob")
    return arrow(full, run, "a long, b long, estimate double")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, name: str) -> DataFrame:
    """Pairs (a, b) of which 100 * intersection >= percent * union holds on the full shingle sets."""
    pairs = keep(pairs.select("a", "b"), f"{name}-pairs", 10000)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()

    def sets(batch):
        out = [s.tobytes() for s in spans.shingle_sets(batch.column(1), k)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "s"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = keep(arrow(with_ids(rows, ids, "id"), sets, "id long, s binary"), f"{name}-sets")

    def run(batch):
        good = []
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            both = np.concatenate([x, y])
            both.sort()
            same = int((both[1:] == both[:-1]).sum())
            if same and 100 * same >= percent * (len(x) + len(y) - same):
                good.append(i)
        return batch.select([0, 1]).take(pa.array(good, pa.int64()))

    full = pairs.join(own.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(own.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return arrow(full.select("a", "b", "sa", "sb"), run, "a long, b long").distinct()


def cross_pairs(hot: DataFrame, regs: DataFrame, percent: int) -> DataFrame:
    """Pairs of documents that share a bucket but no component, and whose estimate may reach the threshold.

    hot: (key, band, id, component). A bucket is cut into blocks of about TILE documents, and each pair of blocks is
    one bounded piece of work; a pair of documents is reported from the first band in which it meets.
    """
    open_keys = (hot.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
                 .where("lo <> hi").select("key", F.ceil(F.col("size") / TILE).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    tiles = (hot.join(open_keys, "key").withColumn("block", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "band", "id", "component")
             .join(regs.select("id", "registers", "n", "odd"), "id"))
    tiles = tiles.select("key", "i", "j", "block", "band", "id", "component", "registers", "n", "odd").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    least = least_estimate(percent / 100)

    def compare(rows: pa.Table):
        """All pairs of one tile."""
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        regs_, odd, block_ = registers_of(rows.column("registers").combine_chunks()), parities_of(rows.column("odd").combine_chunks()), rows.column("block").to_numpy()
        ids, comp, n = (rows.column(c).to_numpy() for c in ("id", "component", "n"))
        band = rows.column("band")[0].as_py()
        for at in range(0, len(ids), 64):
            some = slice(at, at + 64)
            fits = (comp != comp[some, None]) & (ids > ids[some, None]) & may_reach(odd, odd[some, None], n, n[some, None], percent)
            if i != j:
                fits &= block_ != block_[some, None]
            x, y = np.nonzero(fits)
            x += at
            same = (regs_[x].reshape(-1, BANDS, ROWS) == regs_[y].reshape(-1, BANDS, ROWS)).all(2)
            first = same.argmax(1) == band
            x, y = x[first], y[first]
            est = likelihood_jaccard((regs_[x] > regs_[y]).sum(1), (regs_[x] < regs_[y]).sum(1), n[x].astype(float), n[y].astype(float))
            good = est >= least
            yield from zip(ids[x[good]].tolist(), ids[y[good]].tolist(), strict=True)

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            key = np.stack([rest.column(c).to_numpy() for c in ("key", "i", "j")])
            edge = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            if not len(edge):
                continue
            starts = [0, *edge.tolist()]
            found = [p for a, b in zip(starts, starts[1:], strict=False) if b - a > 1 for p in compare(rest.slice(a, b - a))]
            rest = rest.slice(starts[-1])
            if found:
                yield out(found)
        if rest is not None and rest.num_rows > 1:
            yield out(list(compare(rest)))

    def out(found):
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return tiles.mapInArrow(run, "a long, b long")


def near_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, component) of each row: distinct k-word shingles, and the smallest id among near-duplicates, itself included.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets. Equal sets form one class.
    Class representatives meet in bands of SetSketch registers: a link at the threshold is missed with a chance of
    (1 - t ** ROWS) ** BANDS, 2e-8 at 0.85. Each meets its bucket's smallest id first and is linked with the likeliest
    one; what then still lies in different components is compared in bounded blocks. All links are confirmed on full
    sets. Rows without words have n = 0 and stay alone; rows without id have component null; rows that repeat an id
    are one document with the links of all its texts.
    """
    sk = keep(sketches(docs, k, id_col, text_col), "sketches")
    full = sk.where("n > 0 AND id IS NOT NULL")
    classes = keep(full.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep")), "classes", 10000)
    members = keep(full.select("id", "k1", "k2", "n").join(classes, ["k1", "k2", "n"]).select("id", "rep"), "members", 10000)
    regs = keep(full.join(classes, ["k1", "k2", "n"]).where("id = rep").dropDuplicates(["id", "n"]).select("id", "n", "registers", "odd"), "registers")

    def bands(batch):
        if not batch.num_rows:
            return None
        keys = band_keys(registers_of(batch.column(1)))
        ids = np.repeat(batch.column(0).to_numpy(), BANDS)
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int16), len(keys))), pa.array(ids)], ["key", "band", "id"])

    banded = arrow(regs.select("id", "registers"), bands, "key long, band short, id long")
    pivots = banded.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("top")).where("pivot <> top").select("key", "pivot")
    hot = keep(banded.join(pivots, "key"), "buckets", 10000)
    star = hot.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    best = estimated(star, regs, percent).groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a"))
    first = keep(verified(best, docs, k, percent, id_col, text_col, "star"), "links", 10000)
    again = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("id", "a")
    repeated = members.join(again, "id").select("a", F.col("rep").alias("b"))
    label = components(first.union(repeated))
    labelled = hot.join(label, "id", "left").select("key", "band", "id", F.coalesce("component", "id").alias("component"))
    second = verified(cross_pairs(labelled, regs, percent), docs, k, percent, id_col, text_col, "cross")
    relabelled = components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).union(second))
    found = members.join(relabelled.select(F.col("id").alias("rep"), "component"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    return sk.select("id", "n").join(found, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that are near-duplicates of one with a smaller id; columns and other rows unchanged."""
    gone = near_components(docs, k, percent, id_col, text_col).where("component < id").select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
