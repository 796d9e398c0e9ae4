"""Spark helpers shared by the operators: written intermediates, size-checked joins, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.session import cut

BROADCAST_IDS = 1_000_000  # ids at most in a broadcast join: 8 MB of keys, a few dozen MB as a hash table


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of so many rows while a plan runs; for columns of whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def keep(df: DataFrame, name: str, rows: int = 1000) -> DataFrame:
    """Write below the shared folder and read back: a lost executor costs only what it had not written."""
    with small_batches(df.sparkSession, rows):
        return cut(df, name)


def arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int | None = None) -> DataFrame:
    """mapInArrow of a function on single batches, or on slices of so many rows where it needs much memory a row."""

    def run(batches):
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), rows or max(batch.num_rows, 1)):
                out = fn(batch.slice(at, rows) if rows else batch)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def by_bytes(batch: pa.RecordBatch, text_col: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many bytes of text, more only for one longer text; an empty batch as it is."""
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text_col))).fill_null(0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < batch.num_rows or at == 0:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def with_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose key is among ids (one column `on`, distinct): broadcast up to BROADCAST_IDS of them, else shuffled."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, on, "left_semi")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id in edges (a, b: long), component being the smallest id reachable.

    Alternating stars: each round points neighbours at the smallest one known; about log(n) rounds. Minima are combined
    before the shuffle, and the joins back are plain equality joins that adaptive execution splits, so a node with very
    many edges is no single task. Every round is a written table.
    """
    edges = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    last = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).where("u <> v").distinct()
        edges = keep(edges, name)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
