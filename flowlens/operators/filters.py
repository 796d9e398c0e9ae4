"""Filters on flows and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowlens import values as V
from flowlens.functions import ip as IP
from flowlens.functions.scores import severity_rank


def flt_non_unicast(df: DataFrame) -> DataFrame:
    """Drop flows with a multicast, link-local, loopback, unspecified or broadcast end."""
    return df.filter(~IP.is_non_unicast("src_ip") & ~IP.is_non_unicast("dst_ip"))


def flt_internal_src(df: DataFrame, *, extra=()) -> DataFrame:
    return df.filter(IP.is_internal("src_ip", extra))


def flt_not_external_src(df: DataFrame, *, extra=()) -> DataFrame:
    """Baseline scope: everything but valid public sources; bad addresses stay."""
    return df.filter((F.col("src_ip") != "") & ~IP.is_external("src_ip", extra))


def flt_min_severity(df: DataFrame, *, floor: str = "LOW") -> DataFrame:
    return df.filter(severity_rank("severity") >= V.SEVERITY_RANK[floor])


def flt_ml_threshold(df: DataFrame, *, threshold: float = 0.50, column: str = "ml_score") -> DataFrame:
    return df.filter(F.col(column) >= threshold)


def flag_whitelist(df: DataFrame, *, pairs: DataFrame | None = None, ports=(), sources: DataFrame | None = None) -> DataFrame:
    """Append `whitelisted`: listed (dst_ip, dst_port), port, or source."""
    hit = F.col("dst_port").isin(list(ports)) if ports else F.lit(False)
    if pairs is not None:
        df = df.join(pairs.select("dst_ip", "dst_port").distinct().withColumn("_wp", F.lit(True)), ["dst_ip", "dst_port"], "left")
        hit = hit | F.coalesce(F.col("_wp"), F.lit(False))
    if sources is not None:
        df = df.join(sources.select("src_ip").distinct().withColumn("_ws", F.lit(True)), "src_ip", "left")
        hit = hit | F.coalesce(F.col("_ws"), F.lit(False))
    return df.withColumn("whitelisted", hit).drop("_wp", "_ws")


def flt_whitelist(df: DataFrame, **lists) -> DataFrame:
    cols = df.columns
    return flag_whitelist(df, **lists).filter(~F.col("whitelisted")).select(*cols)


def flt_runtime_whitelist(df: DataFrame, *, listed: DataFrame) -> DataFrame:
    """Drop flows whose source or destination is listed."""
    ips = listed.select("ip")
    return (df.join(ips.withColumnRenamed("ip", "src_ip"), "src_ip", "left_anti")
            .join(ips.withColumnRenamed("ip", "dst_ip"), "dst_ip", "left_anti"))


def flt_time_range(df: DataFrame, *, start=None, end=None, severity: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows in [start, end), optionally of one severity; the date column prunes partitions."""
    for bound, op in ((start, "ge"), (end, "lt")):
        if bound is None:
            continue
        lit = F.lit(bound).cast("timestamp")
        df = df.filter(F.col(ts) >= lit if op == "ge" else F.col(ts) < lit)
        if "alert_date" in df.columns:
            day = F.to_date(lit)
            df = df.filter(F.col("alert_date") >= day if op == "ge" else F.col("alert_date") <= day)
    return df.filter(F.col("severity") == severity.upper()) if severity else df


def flt_lookback_from_max(df: DataFrame, *, hours: int = 24, ts: str = "ts") -> DataFrame:
    """Rows newer than the newest row minus `hours` (1 to 720)."""
    hours = max(1, min(int(hours), 720))
    newest = df.select(F.max(ts)).scalar()
    return df.filter(F.col(ts) > newest - F.expr(f"INTERVAL {hours} HOURS"))


def flt_search(alerts: DataFrame, devices: DataFrame, *, q: str, limit: int = 20) -> DataFrame:
    """Devices, then newest alerts, whose text contains `q`."""
    low = q.lower()
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(low))
    dev = devices.filter(has("ip") | has("hostname") | has("department")).select(
        F.lit("device").alias("type"), F.lit(None).cast("long").alias("id"), F.col("ip").alias("src_ip"),
        F.lit("").alias("attack_type"), F.lit("").alias("severity"))
    hit = alerts.filter(has("src_ip") | has("attack_type")).select(
        F.lit("alert").alias("type"), F.col("id").cast("long"), "src_ip", "attack_type", "severity")
    if len(q) < 2:
        return dev.unionByName(hit).limit(0)
    hit = hit.orderBy(F.col("id").desc()).limit(limit)
    return dev.orderBy("src_ip").limit(limit).unionByName(hit).orderBy(
        F.col("type").desc(), F.col("id").desc(), "src_ip").limit(limit)
