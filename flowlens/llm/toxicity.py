"""Toxicity by non-negative positive-unlabelled learning of a linear model in numpy.

Features are hashed: every word, and its first 4 and first 6 bytes (for words of more), lower case; a feature's value is
the root of its share of the text's features, so every vector has length 1. The risk is that of Kiryo et al. (2017):
with class prior p, p * R+(positive) + max(0, R-(unlabelled) - p * R-(positive)); where the second part is negative, the
step goes up it instead. Of each kind of row a fifth is kept from training; the score of 0.5 is put where the same
risk, with errors counted, is least on it. Features are weighted by their rarity in training.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from flowlens.llm import spans
from flowlens.llm.tables import arrow, small_batches

BITS = 18
PREFIXES = (4, 6)
POSITIVES, UNLABELLED = 2000, 6000  # training rows at most of each kind: the bound of the sample
STEPS, RATE, DECAY = 200, 0.1, 1e-3
LEAST = 5  # toxic training texts that must hold a feature for it to count; fewer where there are under 200


Sample = tuple[np.ndarray, np.ndarray, np.ndarray]  # features and their values of all rows, offsets of rows


def features(column) -> Sample:
    flat, values, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], [np.zeros(0, np.int64)]
    for _, data, offsets in spans.pieces(column):
        w = spans.words(data, offsets, lower=True)
        size = w.end - w.start
        hashes, rows = [spans.range_hashes(w.data, w.start, w.end)], [w.row]
        for k in PREFIXES:
            some = size > k
            hashes.append(spans.range_hashes(w.data, w.start[some], w.start[some] + k) + spans.ODD[k])
            rows.append(w.row[some])
        at = (np.concatenate(rows) << BITS) | (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
        at, times = np.unique(at, return_counts=True)
        row = at >> BITS
        total = np.bincount(row, times, minlength=len(offsets) - 1)
        flat.append((at & ((1 << BITS) - 1)).astype(np.int32))
        values.append(np.sqrt(times / total[row]).astype(np.float32))
        counts.append(np.bincount(row, minlength=len(offsets) - 1))
    return np.concatenate(flat), np.concatenate(values), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


def margins(weights: np.ndarray, bias: float, sample: Sample) -> np.ndarray:
    flat, values, offsets = sample
    total = np.concatenate([[0.0], np.cumsum(weights[flat] * values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]] + bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(positive: Sample, unlabelled: Sample, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the whole sample; logistic loss."""
    weights, bias = np.zeros(1 << BITS), 0.0
    scale = rarity(positive, unlabelled)
    positive, unlabelled = ((f, v * scale[f], o) for f, v, o in (positive, unlabelled))
    first, second = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)

    def gradient(sample, slope):
        flat, values, offsets = sample
        each = slope / len(slope)
        return np.append(np.bincount(flat, np.repeat(each, np.diff(offsets)) * values, minlength=len(weights)), each.sum())

    for t in range(1, steps + 1):
        fp, fu = margins(weights, bias, positive), margins(weights, bias, unlabelled)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        down = gradient(unlabelled, sigmoid(fu)) - prior * gradient(positive, sigmoid(fp))
        g = prior * gradient(positive, sigmoid(fp) - 1) + down if negative >= 0 else -down
        g[:-1] += DECAY * weights
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        weights -= step[:-1]
        bias -= step[-1]
    return (weights * scale).astype(np.float32), float(bias)


def rarity(positive: Sample, unlabelled: Sample) -> np.ndarray:
    """Weight of each feature: the log of how rare it is in unlabelled texts, 0 if too few toxic ones hold it."""
    toxic, any_ = (np.bincount(s[0], minlength=1 << BITS) for s in (positive, unlabelled))
    least = min(LEAST, 1 + len(positive[2]) // 50)
    return np.where(toxic >= least, np.log(len(unlabelled[2]) / (any_ + 1)), 0.0).clip(0)


def threshold(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """Margin at which the risk in errors is least; the middle one of the best."""
    at = np.unique(np.concatenate([positive, unlabelled]))
    found = 1 - np.searchsorted(np.sort(positive), at) / len(positive)
    alarms = 1 - np.searchsorted(np.sort(unlabelled), at) / len(unlabelled)
    risk = prior * (1 - found) + np.maximum(0, alarms - prior * found)
    return float(np.median(at[risk <= risk.min() + 1e-9]))


def part(sample: Sample, rows: np.ndarray) -> Sample:
    flat, values, offsets = sample
    n = np.diff(offsets)
    keep = np.repeat(rows, n)
    return flat[keep], values[keep], np.concatenate([[0], np.cumsum(n[rows])])


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> tuple[np.ndarray, float, float]:
    """(weights, bias, prior) from rows that are not held out.

    Positives are confirmed toxic rows, unlabelled ones are any rows, both the first of them by a hash of their id up to
    the bound. The prior is the share of toxic rows among all labelled ones. Without toxic rows the model scores 0.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    total, toxic = marks.agg(F.count("*"), F.sum("y")).first()
    if not toxic:
        return np.zeros(1 << BITS, np.float32), -20.0, 0.0
    prior = min(max(toxic / total, 1e-4), 1 - 1e-4)
    rows = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"))
    order = F.xxhash64("id")
    some = [marks.where("y = 1").select("id").orderBy(order, "id").limit(positives).withColumn("kind", F.lit(1)),
            rows.distinct().orderBy(order, "id").limit(unlabelled).withColumn("kind", F.lit(0))]
    picked = F.broadcast(some[0].union(some[1]))  # positives + unlabelled rows at most

    def run(batch):
        flat, values, off = features(batch.column(2))
        off = pa.array(off.astype(np.int32))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(off, pa.array(flat)), pa.ListArray.from_arrays(off, pa.array(values))], ["kind", "id", "f", "v"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id").select("kind", "id", "text")
    with small_batches(docs.sparkSession):
        got = arrow(own, run, "kind int, id long, f array<int>, v array<float>").toArrow().combine_chunks().sort_by([("kind", "ascending"), ("id", "ascending")])
    sides = []
    for kind in (1, 0):
        own = got.filter(pc.equal(got.column("kind"), kind))
        size = pc.list_value_length(own.column("f")).to_numpy()
        sides.append((pc.list_flatten(own.column("f")).to_numpy(), pc.list_flatten(own.column("v")).to_numpy(), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)))
    rows = [len(side[2]) - 1 for side in sides]
    if not all(rows):
        return np.zeros(1 << BITS, np.float32), -20.0, prior
    back = [np.arange(n) % 5 == 4 if min(rows) >= 20 else np.zeros(n, bool) for n in rows]
    weights, bias = fit(part(sides[0], ~back[0]), part(sides[1], ~back[1]), prior)
    if min(rows) >= 20:
        bias -= threshold(*[margins(weights, bias, part(side, b)) for side, b in zip(sides, back, strict=True)], prior)
    return weights, bias, prior


def scored(docs: DataFrame, model: tuple[np.ndarray, float, float], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score of each row: 0 to 1; a text without words (null too) gets that of an empty one."""
    weights, bias, _ = model

    def run(batch):
        sample = features(batch.column(batch.schema.get_field_index(text_col)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(margins(weights, bias, sample)))], [*batch.schema.names, score_col])

    rows = docs.drop(score_col)
    return arrow(rows, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"{score_col} double"]))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that score 0.5 or more; columns and other rows unchanged."""
    name = "__toxic_score"
    return scored(docs, train(docs, labels, id_col=id_col, text_col=text_col), text_col, name).where(F.col(name) < 0.5).drop(name)
