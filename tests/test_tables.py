"""Exact quantiles, merged moments, upserts by parts, progress rows."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens import values as V
from flowlens.operators import aggregates, quantiles, segments, windows
from flowlens.session import scratch_path
from flowlens.sources import sinks
from flowlens.streaming import flow
from flowlens.streaming.progress import ProgressLog

QS = [0, 0.25, 0.5, 0.95, 0.99, 1]


def test_exact_quantiles_equal_sorted_values(spark):
    rng = random.Random(2)
    rows = [(rng.gauss(0, 1), rng.choice([1.0, 2.0, 2.0, 5.0]), rng.lognormvariate(0, 8), None if i % 3 else 1e308 * rng.choice([-1, 1]), 7, float("nan") if i % 2 else 1e9 + rng.choice([-1, 0, 1e-6]))
            for i in range(3000)]
    table = spark.createDataFrame(rows, "a double, b double, c double, `d.d` double, e int, f double").withColumn("none", F.lit(None).cast("double"))
    names = ["a", "b", "c", "d.d", "e", "f"]
    got, lower = quantiles.exact_quantiles(table, [*names, "none"], QS), quantiles.exact_quantiles(table, names, QS, interpolate=False)
    for i, name in enumerate(names):
        own = np.array([r[i] for r in rows if r[i] is not None and not np.isnan(r[i])])
        assert got[name] == pytest.approx(np.quantile(own, QS).tolist(), rel=1e-12), name
        assert lower[name] == [float(x) for x in np.quantile(own, QS, method="inverted_cdf")], name
    assert got["none"] == [None] * len(QS)
    assert quantiles.exact_quantiles(table.limit(0), ["a"], [0.5]) == {"a": [None]}
    with pytest.raises(ValueError, match="infinite"):
        quantiles.exact_quantiles(spark.createDataFrame([(float("inf"),)], "a double"), ["a"], [0.5])


def test_sketches_merge(spark):
    values = spark.range(20_000).select((F.col("id") % 7).alias("part"), F.col("id").cast("double").alias("x"))
    sketches = quantiles.quantile_sketches(values, ["part"], "x")
    row = quantiles.sketched_quantiles(sketches, [], {"p50": 0.5, "p95": 0.95}).first()
    assert row.n == 20_000 and row.max == 19_999 and row.mean == pytest.approx(9_999.5)
    assert abs(row.p50 - 10_000) < 600 and abs(row.p95 - 19_000) < 600
    near = aggregates.agg_latency_percentiles(values, column="x", k=400).first()
    exact = aggregates.agg_latency_percentiles(values, column="x").first()
    assert exact.p50 == 9_999.5 and abs(near.p99 - exact.p99) < 400 and near.max == exact.max == 19_999


def test_scan_of_moments_equals_numpy():
    rng = np.random.default_rng(1)
    key = np.sort(rng.integers(0, 6, 60))
    n, mean = rng.integers(1, 5, 60), 1e9 + rng.normal(0, 1, (60, 2))
    got = segments.scan_moments(key, n, mean, np.zeros((60, 2)))
    for i in range(60):
        own = np.repeat(mean[:i + 1][key[:i + 1] == key[i]], n[:i + 1][key[:i + 1] == key[i]], axis=0)
        assert got[0][i] == len(own)
        assert got[2][i] == pytest.approx(((own - own.mean(axis=0)) ** 2).sum(axis=0), rel=1e-5, abs=1e-6)
    assert segments.scan_moments(key[:0], n[:0], mean[:0], mean[:0])[0].tolist() == []


def test_moments_of_large_values_keep_a_small_spread(spark):
    rng = random.Random(3)
    rows = [(i, i * 7_000_000, f"s{i % 3}", "IT", *[1e9 + rng.choice([-1.0, 1.0]) for _ in V.UEBA_METRICS]) for i in range(400)]
    table = spark.createDataFrame(rows, ["flow_id", "t_us", "src_ip", "department", *V.UEBA_METRICS]).repartition(5)
    got = {r.flow_id: r for r in windows.ueba_running_z(table).collect()}
    seen, before = {}, []
    for row in rows:
        i, src, x = row[0], row[2], np.array(row[4:])
        if src not in seen:
            seen[src] = list(before) if len(before) >= V.UEBA_MIN_SAMPLES else []
        seen[src].append(x)
        before.append(x)
        own = np.array(seen[src] if len(seen[src]) >= V.UEBA_MIN_SAMPLES else before)
        if len(own) >= V.UEBA_MIN_SAMPLES:
            z = (x - own.mean(axis=0)) / own.std(axis=0, ddof=1)
            assert abs(got[i].max_z) == pytest.approx(np.abs(z).max(), abs=1e-4) and got[i].score_n == len(own)
        else:
            assert got[i].max_z is None


def test_merged_snapshots_of_large_values(spark):
    parts = [spark.createDataFrame([("device", "a", "m", n, mean, m2, 0, 1)], "entity_type string, entity string, metric string, n long, mean double, m2 double, first_us long, last_us long")
             for n, mean, m2 in ((2, 1e9 + 1, 2.0), (3, 1e9 - 1, 0.5), (1, 1e9 + 4, 0.0))]
    row = aggregates.merge_welford(*parts).first()
    mean = (2 * 1 - 3 + 4) / 6
    assert row.n == 6 and row.mean - 1e9 == pytest.approx(mean, abs=1e-6)
    assert row.m2 == pytest.approx(2.5 + 2 * (1 - mean) ** 2 + 3 * (1 + mean) ** 2 + (4 - mean) ** 2, abs=1e-5)


def names(path):
    local = path.removeprefix("file:").replace("//", "/")
    return {os.path.relpath(os.path.join(d, f), local) for d, _, own in os.walk(local) for f in own if f.endswith(".parquet")}


def test_upsert_rewrites_touched_parts_only(spark, monkeypatch):
    path = scratch_path(spark, "upserted")
    table = spark.range(200).select("id", F.lit("old").alias("v"), F.lit(1).alias("at"))
    sinks.snk_upsert(table, path, key="id", order="at", parts=16)
    before = names(path)
    change = spark.createDataFrame([(5, "new", 2), (5, "older", 0), (6, "stale", 0), (900, "added", 1)], "id long, v string, at int")
    touched = {r[0] for r in change.select(F.pmod(F.xxhash64("id"), F.lit(16))).collect()}
    sinks.snk_upsert(change, path, key="id", order="at", parts=16)
    got = {r.id: r.v for r in sinks.read_upserted(spark, path).collect()}
    assert got == {**dict.fromkeys(range(200), "old"), 5: "new", 900: "added"}
    kept = {f for f in before if int(f.split("part=")[1].split("/")[0]) not in touched}
    assert kept and kept <= names(path) and not (before - kept) & names(path)

    def killed(rows, path):
        raise KeyboardInterrupt

    monkeypatch.setattr(sinks, "_overwrite_parts", killed)  # decided, but no part written yet
    with pytest.raises(KeyboardInterrupt):
        sinks.snk_upsert(spark.createDataFrame([(7, "last", 9)], "id long, v string, at int"), path, key="id", order="at", parts=16)
    monkeypatch.undo()
    assert {r.v for r in spark.read.parquet(path).filter("id = 7").collect()} == {"old"}
    assert {r.v for r in sinks.read_upserted(spark, path).filter("id = 7").collect()} == {"last"}
    assert sinks.read_upserted(spark, path).count() == 201


def test_progress_rows(spark):
    path, out = scratch_path(spark, "in"), scratch_path(spark, "progress")
    for i in range(3):
        spark.range(10 * (i + 1)).select("id", F.timestamp_seconds(F.col("id") + 1_700_000_000 + i * 100).alias("ts")).coalesce(1).write.parquet(f"{path}/slot={i}")
    stream = flow.parquet_stream(spark, path, spark.read.parquet(f"{path}/slot=0").schema).withWatermark("ts", "10 seconds").groupBy(F.window("ts", "10 seconds")).count()
    with ProgressLog(spark) as log:
        flow.run_available(stream, mode="append")
    log.write(out)
    got = spark.read.parquet(out).filter("input_rows > 0").orderBy("batch_id").collect()
    assert [(r.batch_id, r.input_rows) for r in got] == [(0, 10), (1, 20), (2, 30)]
    assert got[0].watermark is None and got[2].watermark_lag_sec > 0 and all(r.batch_ms >= r.add_batch_ms for r in got)
    assert log.rows().count() == 0


def test_rows_of_one_partition_are_dealt_to_all_tasks(spark):
    from flowlens.session import dealt
    rows = spark.range(0, 4000, 1, 1).selectExpr("id", "id % 7 AS k")
    got = dealt(rows, "dealt")
    sizes = [r.n for r in got.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) <= 2 * min(sizes)
    assert got.exceptAll(rows).isEmpty() and got.count() == 4000


def test_few_values_of_a_feed_do_not_deal_out_the_flows(spark):
    from flowlens.plans import cascade, q_detect
    made, plans = cascade.cut, {}

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()
        return made(df, name)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    cascade.cut = seen
    try:
        got = q_detect.cascade_alerts(spark, "/root/testdata/sf0.001")
        assert got.count() > 0
    finally:
        cascade.cut = made
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" in plans["gated"][0] and "SortMergeJoin" not in plans["gated"][1]


def test_first_of_the_largest_scores_and_equal_ids(spark):
    rows = [(7, 1_000_000 * i, "s", "IT", *[float(i % 5)] * len(V.UEBA_METRICS)) for i in range(60)] + [(7, 1_000, "t", "IT", *[1.0] * len(V.UEBA_METRICS))]
    table = spark.createDataFrame(rows, ["flow_id", "t_us", "src_ip", "department", *V.UEBA_METRICS]).repartition(3)
    got = [r for r in windows.ueba_running_z(table).collect() if r.max_z is not None]
    assert got and {r.max_metric for r in got} <= {V.UEBA_METRICS[0], ""} and all((r.max_metric == "") == (r.max_z == 0) for r in got)
