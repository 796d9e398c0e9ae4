"""Values that a window holds, the running hour, and the protocol and specialist checks."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import aggregates, windows

START = 1704067200000000


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out, t = [], 0
    for i in range(600):
        t += rng.choice([0, 1_000_000, 20_000_000, 59_999_999, 60_000_000, 200_000_000])
        out.append((i, t, rng.choice("aab"), rng.choice([0, None, 22, 443, 443]), rng.choice([6, 17])))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("bucket", [60_000_000, 77_000_000, 3_600_000_000])
def test_window_values_equal_brute_force(spark, rows, bucket):
    df = spark.createDataFrame(rows, "flow_id long, t_us long, src_ip string, dst_port int, protocol int").repartition(4)
    samples = df.filter("flow_id % 7 = 0")
    got = sorted(map(tuple, windows.window_values(df, samples, "dst_port", bucket_us=bucket).collect()))
    want = {(i, p) for i, t, s, *_ in rows if i % 7 == 0 for j, u, r, p, _ in rows if p and r == s and u > t - 60_000_000 and (u, j) <= (t, i)}
    assert got == sorted(want)


def test_norms_count_samples(spark):
    samples = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "flow_id long, department string")
    values = spark.createDataFrame([(1, 22), (2, 22), (2, 80), (3, 80), (3, 443)], "flow_id long, value int")
    got = {(r.department, r.value): (r.n, r.rank) for r in aggregates.agg_group_norms(samples, values, top=1).collect()}
    assert got == {("x", 22): (2, 1), ("y", 80): (1, 1)}


def test_hour_so_far(spark):
    rows = [(i, i * 600_000_000, "a", 10.0 + i, float(i), 100 * i, 50) for i in range(12)]
    df = spark.createDataFrame(rows, "flow_id long, t_us long, src_ip string, w_fpm double, w_unique_dst double, fwd_bytes long, bwd_bytes long")
    df = df.withColumn("ts", F.timestamp_micros(F.col("t_us") + F.lit(START)))
    got = {r.flow_id: r for r in windows.hour_buffer(df, warmup=2).collect()}
    assert [got[i].hour_n for i in range(12)] == [0, 0, 1, 2, 3, 4, 0, 1, 2, 3, 4, 5]
    assert got[2].hour_mean_fpm == 11 and got[2].hour_std_fpm == pytest.approx(2.2) and got[2].hour_std_unique_dst == 1.0
    assert got[4].hour_mean_fpm == 12 and got[4].hour_std_fpm == pytest.approx((2 / 3) ** 0.5) and got[0].hour_mean_fpm is None
    keys = windows.hour_buffer(df, warmup=2).select("flow_id", "src_ip", F.lit(0).alias("dow"), F.lit(0).alias("hour"), *[f"hour_{x}" for x in ("n", *(f"{k}_{m}" for k in ("mean", "std") for m in windows.SNAP))])
    slots = spark.createDataFrame([], "src_ip string, dow int, hour int, n long, " + ", ".join(f"{k}_{m} double" for k in ("mean", "std") for m in windows.SNAP))
    got = {r.flow_id: (r.source, r.mean_fpm) for r in windows.expected_fallback(keys, slots).collect()}
    assert got[0] == ("none", 1.0) and got[4] == ("hour", 12.0)
