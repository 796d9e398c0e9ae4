"""Table sinks: alert table, upserts, baselines, feed state, engine statistics, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowlens.operators.joins import frame
from flowlens.operators.output import shape_alerts
from flowlens.operators.setops import latest_wins
from flowlens.session import cut
from flowlens.sources.tail import opened


def snk_alerts(df: DataFrame, path: str, *, ts: str = "ts", mode: str = "append") -> None:
    """Shape alerts and append them, partitioned by date."""
    d = df if "final_score" in df.columns else shape_alerts(df)
    d = d.withColumn("alert_date", F.to_date(ts))
    # one writer per date and hash part, so that a busy date is not one task
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    d.repartition(n, "alert_date", F.pmod(F.xxhash64("id"), F.lit(max(1, n // 8)))).write.mode(mode).partitionBy("alert_date").parquet(path)


def alert_batch_writer(path: str):
    """foreachBatch function: one folder per batch id, so a retried batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        snk_alerts(batch, f"{path}/batch_id={batch_id}", mode="overwrite")
    return write


def exists(spark, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
        return True
    except Exception as ex:  # only a missing path counts as absent
        if "PATH_NOT_FOUND" in str(ex) or "UNABLE_TO_INFER_SCHEMA" in str(ex):
            return False
        raise


PARTS = 64
PENDING = "_pending"  # Spark's readers skip names that begin so


def _overwrite_parts(rows: DataFrame, path: str) -> None:
    """Replace the parts that rows belong to; other parts and their files stay as they are."""
    rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def finish_upsert(spark, path: str) -> None:
    """Carry out an upsert that was decided but not finished; repeating it changes nothing."""
    where, folder = opened(path)
    if where.get_file_info(f"{folder}/{PENDING}/_SUCCESS").type.name == "File":
        _overwrite_parts(spark.read.parquet(f"{path}/{PENDING}"), path)
        where.delete_dir(f"{folder}/{PENDING}")


def snk_upsert(df: DataFrame, path: str, *, key, order: str, parts: int = PARTS) -> None:
    """Insert or replace by key: the newest row per key wins.

    The table is dealt by hash of the key into `parts` folders; only those that df touches are read and rewritten. Their
    new rows are written aside first, as a whole: a run that is killed before that leaves the old table, one that is
    killed later is finished by the next call or by `read_upserted`. parts must not change between calls.
    """
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    finish_upsert(spark, path)
    new = cut(df.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")), "upsert")
    touched = [r["part"] for r in new.select("part").distinct().collect()]  # parts of them at most
    if exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path).filter(F.col("part").isin(touched))
        new = latest_wins(old.select(new.columns), new, key=[*keys, "part"], order=order)
    else:
        new = latest_wins(new.limit(0), new, key=[*keys, "part"], order=order)
    new.write.mode("overwrite").parquet(f"{path}/{PENDING}")
    finish_upsert(spark, path)


def read_upserted(spark, path: str) -> DataFrame:
    """The rows of an upserted table, after what was left unfinished."""
    finish_upsert(spark, path)
    return spark.read.parquet(path).drop("part")


def snk_feed_state(iocs: DataFrame, *, updated_us: int) -> DataFrame:
    """Entry count and update time per feed."""
    return iocs.groupBy("feed").agg(F.count(F.lit(1)).alias("entry_count"), F.lit(updated_us).cast("long").alias("last_updated_us"), F.lit("ok").alias("status"))


def feeds_due(state: DataFrame, feeds: dict, *, now_us: int) -> DataFrame:
    """Enabled feeds whose last update is at least their interval ago (or never)."""
    spark = state.sparkSession
    dim = frame(spark, [(n, f[3]) for n, f in feeds.items() if f[4]], "feed string, update_hours int")
    d = dim.join(state.select("feed", "last_updated_us"), "feed", "left")
    return d.filter((F.lit(now_us) - F.coalesce("last_updated_us", F.lit(0))) >= F.col("update_hours").cast("long") * F.lit(3_600_000_000)).select("feed", "update_hours")


def snk_baseline_state(df: DataFrame, path: str) -> None:
    """Save a baseline snapshot (entity_type, entity, metric, n, mean, m2, first_us, last_us)."""
    df.write.mode("overwrite").partitionBy("entity_type").parquet(path)


def load_baseline_state(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def snk_engine_stats(df: DataFrame, *, tick_us: int = 10_000_000, t: str = "t_us", latency: str = "latency_ms") -> DataFrame:
    """One row per tick: flows, rate, latency percentiles, layer counters present in the input."""
    b = ((F.col(t) - F.pmod(F.col(t), F.lit(tick_us)))).alias("tick_us")
    counters = [c for c in ("layer1_immediate", "layer2_attacks", "policy_violations", "peer_deviation", "alerts") if c in df.columns]
    g = df.groupBy(b).agg(F.count(F.lit(1)).alias("flows"), F.percentile_approx(latency, 0.5, 10000).alias("latency_p50_ms"),
                          F.percentile_approx(latency, 0.95, 10000).alias("latency_p95_ms"), *[F.sum(F.col(c).cast("long")).alias(c) for c in counters])
    return g.withColumn("flows_per_sec", F.round(F.col("flows") / F.lit(tick_us / 1_000_000), 2))


def snk_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
