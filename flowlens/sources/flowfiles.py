"""Flow files: exporter CSV and normalised Parquet splits."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowlens import values as V
from flowlens.session import cut


def src_parquet_flows(spark, path: str, *, columns=None) -> DataFrame:
    d = spark.read.parquet(path)
    return d.select(*columns) if columns else d


def label_column(columns) -> str:
    """First of label, attack, class (any case), else the last column."""
    return next((c for c in columns if c.strip().lower() in ("label", "attack", "class")), columns[-1])


def src_csv_flows(spark, path: str, *, schema=None) -> DataFrame:
    """CSV with a header; column names trimmed; text columns unless a schema is given."""
    reader = spark.read.option("header", True)
    d = (reader.schema(schema) if schema else reader).csv(path)
    return d.toDF(*[c.strip() for c in d.columns])


def _first(df: DataFrame, names, default: float = 0.0) -> Column:
    have = [F.col(f"`{n}`").try_cast("double") for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(float(default)))


def src_csv_to_flow(df: DataFrame, *, row_id: str | None = None) -> DataFrame:
    """Flow columns of an exporter CSV by candidate names; label, and a simulated source
    that depends on the row number and on the label being benign.

    Row numbers come from `row_id`, or from a two-level count over partitions.
    """
    lab = F.coalesce(F.col(f"`{label_column(df.columns)}`").cast("string"), F.lit(""))
    d = df
    if row_id is None:
        d = number_rows(df, "_idx")
        row_id = "_idx"
    idx, attack = F.col(row_id).cast("long"), ~lab.isin(V.BENIGN_LABELS)
    src = F.when(attack, F.concat(F.lit("192.0.2."), (idx % 3 + 105).cast("string"))).otherwise(F.concat(F.lit("192.168.1."), (idx % 5 + 10).cast("string")))
    g = lambda names, dflt=0.0: _first(d, names, dflt)
    return d.select(
        F.concat(F.lit("csv-"), idx.cast("string")).alias("flow_id"), src.alias("src_ip"), F.lit("203.0.113.1").alias("dst_ip"),
        g(["Src Port", "src_port"]).cast("int").alias("src_port"), g(["Dst Port", "dst_port", "Dport"]).cast("int").alias("dst_port"),
        g(["Protocol", "protocol", "Proto_num"], 6).cast("int").alias("protocol"), g(["Flow Duration", "duration", "Dur"]).alias("duration"),
        g(["Tot size", "total_bytes", "TotBytes"]).alias("total_bytes"), g(["Tot Fwd Pkts", "TotPkts", "total_pkts"]).alias("total_packets"),
        g(["TotLen Fwd Pkts", "fwd_bytes", "SrcBytes"]).alias("fwd_bytes"), g(["TotLen Bwd Pkts", "bwd_bytes"]).alias("bwd_bytes"),
        *[g([f"{f.upper()} Flag Cnt", f"{f}_flag"]).cast("int").alias(f"{f}_flag") for f in ("syn", "ack", "rst", "fin", "psh")],
        g(["Flow Byts/s", "bytes_per_sec"]).alias("bytes_per_sec"), g(["Flow Pkts/s", "pkts_per_sec"]).alias("packets_per_sec"),
        g(["Pkt Size Avg", "pkt_size_avg", "Pkt Len Mean"]).alias("pkt_size_mean"), lab.alias("actual_label"), attack.cast("int").alias("label"))


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """1-based row numbers in the order of files and of rows in them, without sorting everything in one task.

    Where each row stands is written with it first, so that all later steps see the same. Rows are counted per split of a
    file; the counts, one row a split, give each split its offset. Rows that no file holds are numbered by partition.
    """
    try:
        rows = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"))
    except AnalysisException:  # no rows of files
        rows = df.select("*", F.lit("").alias("_f"), F.spark_partition_id().cast("long").alias("_s"))
    d = cut(rows.withColumn("_m", F.monotonically_increasing_id()), "numbered")  # rises by one inside a split
    per = d.groupBy("_f", "_s").agg(F.count(F.lit(1)).alias("_c"), F.min("_m").alias("_first"))
    before = F.sum("_c").over(W.orderBy("_f", "_s").rowsBetween(W.unboundedPreceding, -1))
    off = per.select("_f", "_s", F.coalesce(before, F.lit(0)).alias("_o"), "_first")
    return d.join(off, ["_f", "_s"]).withColumn(name, F.col("_o") + F.col("_m") - F.col("_first") + 1).drop("_f", "_s", "_m", "_o", "_first")
