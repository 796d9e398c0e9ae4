"""Maintenance and compliance jobs on the alert and device tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowlens.functions import ip as IP
from flowlens.functions.scores import severity_rank


def pseudonymize_old(alerts: DataFrame, *, now, salt: str, days: int = 90, ts="ts") -> DataFrame:
    """Replace the addresses of alerts older than `days` by their hash, once."""
    d = alerts if "ip_pseudonymized" in alerts.columns else alerts.withColumn("ip_pseudonymized", F.lit(False))
    old = (F.col(ts) < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")) & ~F.col("ip_pseudonymized")
    h = {c: IP.pseudonymize_ip(c, salt) for c in ("src_ip", "dst_ip")}
    return d.withColumns({**{c: F.when(old, h[c]).otherwise(F.col(c)) for c in h},
                          **{f"{c}_pseudo": F.when(old, h[c]).otherwise(F.col(f"{c}_pseudo") if f"{c}_pseudo" in d.columns else F.lit("")) for c in h},
                          "ip_pseudonymized": F.col("ip_pseudonymized") | old})


def purge_old(alerts: DataFrame, *, now, days: int = 365, ts="ts") -> DataFrame:
    """Keep alerts of the last `days`."""
    return alerts.filter(F.col(ts) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def _of_subject(df: DataFrame, ip: str, salt: str):
    h = IP.pseudonymize_ip(F.lit(ip), salt)
    hit = (F.col("src_ip") == ip) | (F.col("dst_ip") == ip)
    for c in ("src_ip_pseudo", "dst_ip_pseudo"):
        if c in df.columns:
            hit = hit | (F.col(c) == h)
    return F.coalesce(hit, F.lit(False))


def subject_export(alerts: DataFrame, *, ip: str, salt: str) -> DataFrame:
    """Alerts of one address, by itself or by its hash."""
    return alerts.filter(_of_subject(alerts, ip, salt))


def subject_delete(alerts: DataFrame, *, ip: str, salt: str) -> DataFrame:
    """Alerts without those of one address."""
    return alerts.filter(~_of_subject(alerts, ip, salt))


def alert_triage_update(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Alerts with the newest triage event: status, acknowledged_by, acknowledged_us.

    Events (alert_id, t_us, status, by) are append-only.
    """
    last = events.groupBy(F.col("alert_id").alias("id")).agg(F.max_by(F.struct("status", "by", "t_us"), F.struct("t_us", "status")).alias("_e"))
    d = alerts.join(last, "id", "left")
    return d.select(*alerts.columns, F.coalesce("_e.status", F.lit("new")).alias("status"), F.col("_e.by").alias("acknowledged_by"), F.col("_e.t_us").alias("acknowledged_us"))


def purge_external_devices(devices: DataFrame, *, extra=()) -> DataFrame:
    """Devices without valid public addresses."""
    return devices.filter(~IP.is_external("ip", extra))


def device_registry(alerts: DataFrame, snapshot: DataFrame | None = None, *, t="t_us", score="ml_score") -> DataFrame:
    """Per source that is not public: first and last seen, alert count, highest risk; merged with a snapshot."""
    d = alerts.filter((F.col("src_ip") != "") & ~IP.is_external("src_ip"))
    new = d.groupBy(F.col("src_ip").alias("ip")).agg(F.min(t).alias("first_us"), F.max(t).alias("last_us"), F.count(F.lit(1)).alias("alert_count"),
                                                     F.max(score).alias("risk_score"), F.max(severity_rank("severity")).alias("worst_rank"))
    if snapshot is None:
        return new
    return new.unionByName(snapshot).groupBy("ip").agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("alert_count").alias("alert_count"),
        F.max("risk_score").alias("risk_score"), F.max("worst_rank").alias("worst_rank"))


def retention_stats(stats: DataFrame, *, now_us: int, days: int = 2, t="tick_us") -> DataFrame:
    return stats.filter(F.col(t) >= now_us - days * 86_400_000_000)


def parity_report(a: DataFrame, b: DataFrame, *, key: str, columns, tolerance: float = 1e-4) -> DataFrame:
    """Per column: largest and mean difference of two results, rows on one side only, and the verdict."""
    j = a.select(key, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(1).alias("_ia")).join(
        b.select(key, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(1).alias("_ib")), key, "full")
    diff = F.array(*[F.struct(F.lit(c).alias("column"), F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")).alias("d"),
                              (F.col("_ia").isNull() | F.col("_ib").isNull()).cast("int").alias("u")) for c in columns])
    g = j.select(F.inline(diff)).groupBy("column").agg(F.max("d").alias("max_abs_diff"), F.avg("d").alias("mean_abs_diff"), F.sum("u").alias("unmatched"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("ok", (F.coalesce("max_abs_diff", F.lit(0.0)) < tolerance) & (F.col("unmatched") == 0))
