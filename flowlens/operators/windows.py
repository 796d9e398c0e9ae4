"""Per-source windows: rolling host aggregates, behaviour metrics, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from flowlens import values as V
from flowlens.operators.segments import (SECOND, bucket_of, gap_stats, last_rows, merged, row_index,
                                         running_moments, running_totals, sliding)
from flowlens.session import cut

MINUTE = 60 * SECOND
HOUR = 3600 * SECOND
DAY = 86400 * SECOND


def host_rolling_60s(df: DataFrame, *, window_us: int = MINUTE, cold_start: dict | None = None,
                     bucket_us: int | None = None) -> DataFrame:
    """Append the 8 host aggregates over strictly earlier flows of the last 60 s.

    A flow exactly 60 s old still counts; flows without history get zeros or `cold_start`.
    """
    w = sliding(df, horizon_us=window_us, closed=True, include_current=False, gaps=True, bucket_us=bucket_us,
                sums={"_syn": F.when((F.col("syn_flag") == 1) & (F.col("ack_flag") == 0), 1).otherwise(0),
                      "_bytes": F.col("total_bytes")},
                distinct={"_dst": "dst_ip", "_prt": "dst_port"})
    # a step from a flow that has left the window is not in it: n flows have n-1 steps
    mean, std = gap_stats("gap_n", "gap_sum", "gap_sq")
    vals = dict(zip(V.HOST_AGGREGATES, [
        F.col("win_n").cast("double"), F.col("_dst").cast("double"), F.col("_prt").cast("double"),
        F.col("_syn").cast("double"), F.col("win_n") / F.lit(window_us / SECOND), F.col("_bytes").cast("double"),
        mean, std]))
    cold = cold_start or {}
    out = w.withColumns({n: F.when(F.col("win_n") > 0, e).otherwise(F.lit(float(cold.get(n, 0.0))))
                         for n, e in vals.items()})
    return out.drop("win_n", "_syn", "_bytes", "_dst", "_prt", "gap_n", "gap_sum", "gap_sq")


def asym_capture_1h(df: DataFrame, *, window_us: int = HOUR, threshold: float = 0.80, min_rows: int = 20) -> DataFrame:
    """Append `asymmetric`: over `threshold` of the source's last hour has no reply bytes."""
    w = sliding(df, horizon_us=window_us, sums={"_zero": F.when(F.col("bwd_bytes") == 0, 1).otherwise(0)})
    return w.withColumn("asymmetric", (F.col("win_n") >= min_rows)
                        & (F.col("_zero") / F.greatest("win_n", F.lit(1)) > threshold)).drop("win_n", "_zero")


def entity_metrics_60s(df: DataFrame, *, window_us: int = MINUTE, min_flows: int = 5) -> DataFrame:
    """Append fpm, unique_dst, bytes_per_flow, send_ratio; null below `min_flows`."""
    df = df.withColumn("_dnn", F.when(F.col("dst_ip") != "", F.col("dst_ip")))
    w = sliding(df, horizon_us=window_us, distinct={"_ud": "_dnn"},
                sums={"_tb": F.col("total_bytes"), "_fb": F.col("fwd_bytes")})
    ok = F.col("win_n") >= min_flows
    return w.withColumns({
        "fpm": F.when(ok, F.col("win_n") / F.lit(window_us / SECOND) * 60.0),
        "unique_dst": F.when(ok, F.col("_ud").cast("double")),
        "bytes_per_flow": F.when(ok, F.col("_tb") / F.greatest("win_n", F.lit(1))),
        "send_ratio": F.when(ok, F.coalesce(F.when(F.col("_tb") > 0, F.try_divide(F.col("_fb"), F.col("_tb"))), F.lit(0.5))),
    }).drop("_dnn", "_ud", "_tb", "_fb", "win_n")


def peer_push(df: DataFrame, *, every: int = 100) -> DataFrame:
    """Keep every `every`-th flow with metrics of each source: the peer-group samples."""
    d = row_index(df.filter(F.col("fpm").isNotNull()), keys="src_ip", name="push_idx")
    return d.filter(F.col("push_idx") % every == 0)


def window_values(df: DataFrame, samples: DataFrame, column: str, *, window_us: int = MINUTE, bucket_us: int = 10 * MINUTE) -> DataFrame:
    """(flow_id, value) of every different value above 0 that the source's window holds at each sample, the sample included.

    samples: rows of df (src_ip, t_us, flow_id). Flows of a source and a value that follow each other within the window
    make one interval of presence; a sample meets the intervals of its source and time bucket, and those it lies in
    count. Null values are none; repeated samples count each.
    """
    order = F.struct("t_us", "flow_id")
    v = df.filter(F.col(column) > 0).select("src_ip", F.col(column).alias("value"), "t_us", "flow_id")
    # gaps are looked for within buckets, which repeat what can still reach into the next one
    own = bucket_of("t_us", bucket_us)
    near = F.pmod(F.col("t_us"), F.lit(bucket_us)) + window_us > bucket_us
    v = v.withColumn("b", F.explode(F.when(near, F.array(own, own + 1)).otherwise(F.array(own))))
    by = W.partitionBy("src_ip", "value", "b").orderBy("t_us", "flow_id")
    opens = F.coalesce(F.col("t_us") - F.lag("t_us").over(by) >= window_us, F.lit(True))
    runs = v.withColumn("run", F.sum(F.when(opens, 1).otherwise(0)).over(by.rowsBetween(W.unboundedPreceding, 0)))
    spans = runs.groupBy("src_ip", "b", "value", "run").agg(F.min(order).alias("first"), (F.max("t_us") + window_us).alias("until"))
    at = samples.select("src_ip", "t_us", "flow_id", own.alias("b"))
    return at.join(spans, ["src_ip", "b"]).filter((order >= F.col("first")) & (F.col("t_us") < F.col("until"))).select("flow_id", "value")


def ueba_60s_features(df: DataFrame, *, window_us: int = MINUTE) -> DataFrame:
    """Append 60-second rate, distinct destinations, failed ratio, send ratio and bytes."""
    df = df.withColumn("_dnn", F.when(F.col("dst_ip") != "", F.col("dst_ip")))
    syn_only = (F.col("syn_flag") > 0) & (F.col("ack_flag") == 0) & (F.col("fin_flag") == 0)
    w = sliding(df, horizon_us=window_us, distinct={"_ud": "_dnn"},
                sums={"_fail": F.when(F.col("rst_flag") > 0, 1).otherwise(0) + F.when(syn_only, 1).otherwise(0),
                      "_fb": F.col("fwd_bytes"), "_bb": F.col("bwd_bytes")})
    total = F.col("_fb") + F.col("_bb")
    return w.withColumns({
        "w_fpm": F.col("win_n").cast("double"), "w_unique_dst": F.col("_ud").cast("double"),
        "w_failed_ratio": F.when(F.col("win_n") >= 3, F.col("_fail") / F.greatest("win_n", F.lit(1))).otherwise(0.0),
        "w_send_ratio": F.when(total > 100, F.col("_fb") / F.greatest(total, F.lit(1))).otherwise(0.5),
        "w_bytes": total.cast("double")}).drop("_dnn", "_ud", "_fail", "_fb", "_bb", "win_n")


def beacon_cv(df: DataFrame, *, last: int = 50, need: int = 10, bucket_us: int = MINUTE) -> DataFrame:
    """Append beacon_n, beacon_mean and beacon_cv of the last 50 gaps (0 < gap <= 60 s)."""
    own = bucket_of("t_us", bucket_us)
    reach = F.pmod(F.col("t_us"), F.lit(bucket_us)) + MINUTE >= bucket_us
    both = F.array(F.struct(own.alias("b"), F.lit(True).alias("o")), F.struct((own + 1).alias("b"), F.lit(False).alias("o")))
    one = F.array(F.struct(own.alias("b"), F.lit(True).alias("o")))
    d = df.withColumn("_c", F.explode(F.when(reach, both).otherwise(one))).withColumn("_b", F.col("_c.b"))
    prev = F.lag("t_us").over(W.partitionBy("src_ip", "_b").orderBy("t_us", "flow_id"))
    gap = F.col("t_us") - prev
    d = d.withColumn("_gap", F.when((gap > 0) & (gap <= MINUTE), gap)).filter(F.col("_c.o")).drop("_c", "_b")
    # number the valid gaps; a row sees the gaps numbered up to its own count
    d = running_totals(d, keys="src_ip", sums={"gap_idx": F.when(F.col("_gap").isNotNull(), 1).otherwise(0).cast("long")})
    g = (F.col("_gap") / F.lit(SECOND)).cast("double")
    stats = last_rows(d.filter(F.col("_gap").isNotNull()).select("src_ip", "gap_idx", "_gap"), keys="src_ip",
                      idx="gap_idx", n=last, aggs={"_n": F.count("_gap"), "_m": F.avg(g), "_s": F.stddev_pop(g)})
    out = d.join(stats.drop("_gap"), ["src_ip", "gap_idx"], "left")
    ready = (F.col("gap_idx") >= need) & (F.col("_m") >= 0.1)
    return out.select(*df.columns, F.coalesce(F.col("gap_idx"), F.lit(0)).alias("beacon_n"),
                      F.when(F.col("gap_idx") >= need, F.col("_m")).otherwise(0.0).alias("beacon_mean"),
                      F.when(ready, F.try_divide(F.col("_s"), F.col("_m"))).otherwise(1.0).alias("beacon_cv"))


def hour_profile(df: DataFrame, *, ts="ts", need: int = 200) -> DataFrame:
    """Append hour_dev: how unusual the hour is among the source's flows so far."""
    one = F.lit(1).cast("long")
    d = df.withColumn("_h", F.hour(ts))
    d = running_totals(d, specs=[("src_ip", {"_all": one}), (["src_ip", "_h"], {"_hr": one})])
    share = F.col("_hr") / F.col("_all")
    return d.withColumn("hour_dev", F.when(F.col("_all") < need, 0.0).when(share < 0.01, 1.0)
                        .when(share < 0.03, 0.5).otherwise(0.0)).drop("_h", "_all", "_hr")


SNAP = ["fpm", "unique_dst", "bytes_pf", "send_ratio"]


def hourly_snapshot(df: DataFrame, *, ts="ts", warmup: int = 20) -> DataFrame:
    """One row per source, date and hour: mean metrics from the source's 20th flow on.

    Needs the columns of `ueba_60s_features`.
    """
    d = row_index(df, keys="src_ip", name="_idx").filter(F.col("_idx") >= warmup)
    total = F.col("fwd_bytes") + F.col("bwd_bytes")
    return d.groupBy("src_ip", F.to_date(ts).alias("date"), F.hour(ts).alias("hour")).agg(
        F.weekday(F.min(ts)).alias("dow"), F.avg("w_fpm").alias("fpm"), F.avg("w_unique_dst").alias("unique_dst"),
        F.avg(total).alias("bytes_pf"), F.avg(F.col("fwd_bytes") / F.greatest(total, F.lit(1))).alias("send_ratio"),
        F.count(F.lit(1)).alias("n_flows"), F.max("t_us").alias("last_us"),
        *[F.count_if(F.col("protocol") == p).alias(f"proto_{p}") for p in (6, 17, 1)],
        F.array_sort(F.collect_set(F.when(F.col("dst_port") > 0, F.col("dst_port")))).alias("ports"))  # 65,535 of them at most


def hour_buffer(df: DataFrame, *, ts="ts", warmup: int = 20) -> DataFrame:
    """Append hour_n and hour_{mean,std}_<metric>: the source's rows of the current hour before this one.

    They are what `hourly_snapshot` will make of the hour, as far as it has come; they start anew with every hour and
    hold rows from the source's 20th flow on. One row has a deviation of a fifth of its value, at least 1. Needs the
    columns of `ueba_60s_features`.
    """
    total = F.col("fwd_bytes") + F.col("bwd_bytes")
    d = row_index(df.select("flow_id", "t_us", "src_ip", F.date_trunc("hour", F.col(ts)).alias("_hour"), F.col("w_fpm").alias("fpm"), F.col("w_unique_dst").alias("unique_dst"),
                            total.cast("double").alias("bytes_pf"), (F.col("fwd_bytes") / F.greatest(total, F.lit(1))).alias("send_ratio")), keys="src_ip", name="_idx")
    d = running_moments(d.filter(F.col("_idx") >= warmup), specs=[(["src_ip", "_hour"], "_h")], metrics=SNAP, bucket_us=10 * MINUTE)
    n = F.col("_hn")
    cols = [c for m in SNAP for mean in [F.col(f"_ha_{m}")] for c in (
        mean.alias(f"hour_mean_{m}"), F.when(n < 2, F.greatest(mean * 0.20, F.lit(1.0))).otherwise(F.greatest(F.sqrt(F.col(f"_hv_{m}") / n), F.lit(0.01))).alias(f"hour_std_{m}"))]
    return df.join(d.filter(n > 0).select("flow_id", n.alias("hour_n"), *cols), "flow_id", "left").withColumn("hour_n", F.coalesce("hour_n", F.lit(0)))


def _std(n, mean, sq_mean):
    """Weighted deviation: 20 % of the mean (at least 1) for one sample, never below 0.01."""
    return F.when(n < 2, F.greatest(mean * 0.20, F.lit(1.0))).otherwise(
        F.greatest(F.sqrt(F.greatest(sq_mean - mean * mean, F.lit(0.0))), F.lit(0.01)))


def slot_baseline(snap: DataFrame, *, as_of_us) -> DataFrame:
    """Per source, weekday and hour: recency-weighted mean and deviation over 14 days."""
    age = (as_of_us - F.col("last_us")) / F.lit(float(DAY))
    w = F.when(age <= 3, 0.50).when(age <= 7, 0.30).otherwise(0.20)
    d = snap.withColumn("_w", w).filter((age <= 14) & (age >= 0))
    g = d.groupBy("src_ip", "dow", "hour").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_w").alias("_sw"),
        *[F.sum(F.col("_w") * F.col(m)).alias(f"_s_{m}") for m in SNAP],
        *[F.sum(F.col("_w") * F.col(m) * F.col(m)).alias(f"_q_{m}") for m in SNAP])
    for m in SNAP:
        g = g.withColumn(f"mean_{m}", F.col(f"_s_{m}") / F.col("_sw"))
    return g.select("src_ip", "dow", "hour", "n", *[f"mean_{m}" for m in SNAP],
                    *[_std(F.col("n"), F.col(f"mean_{m}"), F.col(f"_q_{m}") / F.col("_sw")).alias(f"std_{m}") for m in SNAP])


def _mean_of_slots(slots: DataFrame, keys, prefix: str) -> DataFrame:
    agg = [F.count(F.lit(1)).alias(f"{prefix}_n")]
    for m in SNAP:
        agg += [F.avg(f"mean_{m}").alias(f"{prefix}_mean_{m}"),
                F.greatest(F.stddev_pop(f"mean_{m}"), F.lit(0.01)).alias(f"{prefix}_std_{m}")]
    return slots.groupBy(*keys).agg(*agg)


def expected_fallback(keys: DataFrame, slots: DataFrame) -> DataFrame:
    """Expected metrics of each (src_ip, dow, hour) row: slot, else weekday, else global, else the current hour, else constants.

    The current hour counts where keys have the columns of `hour_buffer`.
    """
    s = slots.withColumnsRenamed({"n": "s_n", **{f"{k}_{m}": f"s_{k}_{m}" for k in ("mean", "std") for m in SNAP}})
    d = (keys.join(s, ["src_ip", "dow", "hour"], "left")
         .join(_mean_of_slots(slots, ["src_ip", "dow"], "d"), ["src_ip", "dow"], "left")
         .join(_mean_of_slots(slots, ["src_ip"], "g"), ["src_ip"], "left"))
    use = (F.when(F.col("s_n") >= 2, "slot").when(F.col("d_n") >= 2, "weekday")
           .when(F.col("g_n") >= 1, "global").when(F.col("hour_n") > 0 if "hour_n" in keys.columns else F.lit(False), "hour").otherwise("none"))
    const = {"mean": {"fpm": 1.0, "unique_dst": 1.0, "bytes_pf": 1.0, "send_ratio": 0.5},
             "std": {"fpm": 1.0, "unique_dst": 1.0, "bytes_pf": 1.0, "send_ratio": 0.1}}
    d = d.withColumn("source", use)
    pick = {f"{k}_{m}": F.when(F.col("source") == "slot", F.col(f"s_{k}_{m}"))
            .when(F.col("source") == "weekday", F.col(f"d_{k}_{m}"))
            .when(F.col("source") == "global", F.col(f"g_{k}_{m}"))
            .when(F.col("source") == "hour", F.col(f"hour_{k}_{m}") if "hour_n" in keys.columns else F.lit(None)).otherwise(F.lit(const[k][m]))
            for k in ("mean", "std") for m in SNAP}
    kept = [c for c in keys.columns if not c.startswith("hour_")]
    return d.select(*kept, "source", *[e.alias(n) for n, e in pick.items()])


def zscore_slot(df: DataFrame, *, current: dict[str, str]) -> DataFrame:
    """Append z_<metric> of current values against expected ones."""
    return df.withColumns({f"z_{m}": F.abs(F.col(c) - F.col(f"mean_{m}"))
                           / F.greatest(F.col(f"std_{m}"), F.lit(0.001 if m == "send_ratio" else 0.01))
                           for m, c in current.items()})


def anchor_capture(snap: DataFrame, *, min_days: float = 14, min_slots: float = 0.80 * 168) -> DataFrame:
    """First snapshot per source with 14 days of history and 80 % of the week covered,
    with the mean over slots of that moment frozen."""
    # snapshots are one row per source and hour, so a source's history is small
    w = W.partitionBy("src_ip").orderBy("last_us").rowsBetween(W.unboundedPreceding, W.currentRow)
    first_in_slot = F.row_number().over(W.partitionBy("src_ip", "dow", "hour").orderBy("last_us")) == 1
    d = snap.withColumn("_new", F.when(first_in_slot, 1).otherwise(0))
    d = d.withColumn("slots", F.sum("_new").over(w)).withColumn("first_us", F.min("last_us").over(w))
    ready = ((F.col("last_us") - F.col("first_us")) / F.lit(float(DAY)) >= min_days) & (F.col("slots") >= min_slots)
    at = d.filter(ready).groupBy("src_ip").agg(F.min("last_us").alias("anchor_us"))
    per_slot = snap.join(at, "src_ip").filter(F.col("last_us") <= F.col("anchor_us")).groupBy(
        "src_ip", "anchor_us", "dow", "hour").agg(*[F.avg(m).alias(m) for m in SNAP])
    return per_slot.groupBy("src_ip", "anchor_us").agg(*[F.avg(m).alias(f"anchor_{m}") for m in SNAP])


def anchor_drift(df: DataFrame, *, current: dict[str, str]) -> DataFrame:
    """Append the largest ratio of current to anchored metrics, and its reasons."""
    limits = {"fpm": (0.1, 3.0), "unique_dst": (0.1, 5.0), "bytes_pf": (1.0, 10.0)}
    ratios = {m: F.when(F.col(f"anchor_{m}") > lo, F.col(current[m]) / F.col(f"anchor_{m}")).otherwise(0.0)
              for m, (lo, _) in limits.items()}
    reasons = [F.when(r >= limits[m][1], F.lit(m)) for m, r in ratios.items()]
    return df.withColumns({"drift_ratio": F.coalesce(F.greatest(*ratios.values()), F.lit(0.0)),
                           "drift_reasons": F.concat_ws(",", *reasons)})


def temporal_ratio_60s(df: DataFrame, *, window_us: int = MINUTE, max_rows: int = 500, alert_ratio: float = 0.15) -> DataFrame:
    """Append window_n, window_ratio, temporal_alert and effective_severity.

    Input columns: is_attack (boolean), confidence, severity.
    """
    att = F.col("is_attack")
    ranks = {f"_r{r}": F.when(att & (F.col("severity") == s), 1).otherwise(0)
             for s, r in V.SEVERITY_RANK.items() if r > 0}
    w = sliding(df, horizon_us=window_us, closed=True, max_rows=max_rows,
                sums={"_tatt": F.when(att, 1).otherwise(0), **ranks})
    top = F.coalesce(*[F.when(F.col(f"_r{r}") > 0, F.lit(r)) for r in (4, 3, 2, 1)], F.lit(0))
    ratio = F.col("_tatt") / F.col("win_n")
    sure = (F.col("severity") == "CRITICAL") & (F.col("confidence") > 0.95)
    alert = (F.when(~att, (ratio > 0.50) & (top >= 3)).when(sure, True).when(ratio >= alert_ratio, True)
             .when(F.col("win_n") < 5, F.col("confidence") > 0.85).otherwise(False))
    name = F.element_at(F.array(*[F.lit(s) for s in V.SEVERITY_BY_RANK]), top + 1)
    sev = (F.when(~att, F.when((ratio > 0.50) & (top >= 3), name).otherwise("BENIGN")).when(sure, "CRITICAL")
           .when((ratio >= alert_ratio) | (F.col("win_n") < 5), F.col("severity")).otherwise("BENIGN"))
    return w.withColumns({"window_n": F.col("win_n"), "window_ratio": ratio, "temporal_alert": alert,
                          "effective_severity": sev}).drop("win_n", "_tatt", *ranks)


# ── long-term baselines ──────────────────────────────────────────────────────
def _variance(n, mean, m2):
    """Sample variance; what rounding leaves of constant values counts as zero."""
    var = F.try_divide(m2, n - 1)
    return F.when((n >= 2) & (var > 1e-26 * F.greatest(F.lit(1.0), mean * mean)), var).otherwise(0.0)


def ueba_running_z(df: DataFrame, *, group: str = "department", min_samples: int = V.UEBA_MIN_SAMPLES,
                   bucket_us: int = MINUTE) -> DataFrame:
    """Append score_n, max_z, max_metric: largest |z| of the six metrics.

    The device state covers its flows up to and including the current one. A device whose
    department was mature just before its first flow starts from the department state. A
    device that is not mature is scored against its department; with neither, null.
    States are prefix scans over moments, so departments and hot sources split by time bucket.
    """
    ms = V.UEBA_METRICS
    d = running_moments(df, specs=[(group, "_g"), ("src_ip", "_d")], metrics=ms, bucket_us=bucket_us)
    # department state just before the device's first flow: only buckets in which devices begin are looked at. Tables by
    # device are written first, so that Spark knows whether they are small
    narrow = df.select("src_ip", group, "t_us", "flow_id", *ms)
    begins = cut(narrow.groupBy("src_ip").agg(F.min("t_us").alias("_t0")), "begins")
    buckets = narrow.join(begins, "src_ip").filter("t_us = _t0").select(group, bucket_of("t_us", bucket_us).alias("_b")).distinct()
    near = narrow.withColumn("_b", bucket_of("t_us", bucket_us)).join(cut(buckets, "buckets"), [group, "_b"], "left_semi").drop("_b")
    near = running_moments(near, specs=[(group, "_g")], metrics=ms, bucket_us=bucket_us, of=narrow)
    seed = F.struct(F.col("_gn").alias("n"), *[F.col(f"_g{s}_{m}").alias(f"{s}_{m}") for m in ms for s in "av"])
    seeds = near.join(begins, "src_ip").filter("t_us = _t0").groupBy("src_ip").agg(F.min_by(seed, "flow_id").alias("_seed"))
    d = d.join(cut(seeds, "seeds"), "src_ip")
    has = F.col("_seed.n") >= min_samples

    def started(m):
        return tuple(F.when(has, F.col(f"_seed.{c}")).otherwise(z) for c, z in (("n", 0), (f"a_{m}", 0.0), (f"v_{m}", 0.0)))

    def moments(p, m):
        return F.col(f"{p}n"), F.col(f"{p}a_{m}"), F.col(f"{p}v_{m}")

    def row(m):
        return F.lit(1), F.col(m), F.lit(0.0)

    def joined(d, p, sides):
        """Merged moments as columns, so that each step is worked out once."""
        found = {m: merged(*sides(m)) for m in ms}
        return d.withColumns({f"{p}n": found[ms[0]][0], **{f"{p}{s}_{m}": found[m][i] for m in ms for i, s in ((1, "a"), (2, "v"))}})

    d = joined(d, "_e", lambda m: (started(m), moments("_d", m)))
    d = joined(d, "_o", lambda m: (moments("_e", m), row(m)))
    d = joined(d, "_w", lambda m: (moments("_g", m), row(m)))
    d = d.withColumn("_own", F.col("_on") >= min_samples)
    d = d.withColumns({c: F.when(F.col("_own"), F.col(f"_o{c[1:]}")).otherwise(F.col(f"_w{c[1:]}")) for c in ["_n", *[f"_{s}_{m}" for m in ms for s in "av"]]})
    d = d.withColumns({f"_z_{m}": F.coalesce(F.try_divide(F.col(m) - F.col(f"_a_{m}"), F.sqrt(_variance(F.col("_n"), F.col(f"_a_{m}"), F.col(f"_v_{m}")))), F.lit(0.0)) for m in ms})
    # the first metric of the largest |z|, none where all are zero
    d = d.withColumn("_top", F.greatest(*[F.abs(f"_z_{m}") for m in ms]))
    z, name = F.when(F.col("_top") == 0, 0.0), F.when(F.col("_top") == 0, "")
    for m in ms:
        at = F.abs(f"_z_{m}") == F.col("_top")
        z, name = z.when(at, F.col(f"_z_{m}")), name.when(at, m)
    ready = F.col("_n") >= min_samples
    return d.select(*df.columns, F.col("_n").alias("score_n"), F.when(ready, F.col("_own")).alias("scored_on_device"),
                    F.when(F.col("_own") & has, F.col(group)).alias("inherited_from"),
                    F.when(ready, z).alias("max_z"), F.when(ready, name).alias("max_metric"))
