"""Zeek TSV logs, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

# Fields that flows, TLS records and names are made of; a log may have more, in any order.
CONN = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "duration", "orig_bytes", "resp_bytes",
        "conn_state", "history", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes"]
SSL = ["ts", "uid", "ja3", "ja3s", "server_name", "version", "cipher", "subject", "issuer", "validation_status"]
DNS = ["ts", "uid", "query", "answers"]
LOGS = {"conn": CONN, "ssl": SSL, "dns": DNS}


def _unset(c):
    return F.when(~c.isin("-", "(empty)"), c)


def _heads(lines: DataFrame) -> DataFrame:
    """(file, names) of each file of lines (value, file)."""
    heads = lines.filter(F.col("value").startswith("#fields")).groupBy("file").agg(F.max("value").alias("head"))
    return heads.select("file", F.expr("slice(split(head, '\t'), 2, size(split(head, '\t')) - 1)").alias("names"))


def _split(lines: DataFrame) -> DataFrame:
    """Rows of (value, names, file) with their fields, and whether these agree with the names."""
    return lines.withColumn("parts", F.split("value", "\t")).withColumn("fits", F.coalesce(F.size("parts") == F.size("names"), F.lit(False)))


def _rows(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Data lines with their fields, the names in their file's header (null without one), and whether both agree."""
    rows = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("parts", F.split("value", "\t"))
    return rows.join(heads, "file", "left").withColumn("fits", F.coalesce(F.size("parts") == F.size("names"), F.lit(False)))


def _named(rows: DataFrame, columns) -> DataFrame:
    at = lambda c: F.array_position("names", c)
    return rows.filter("fits").select(*[_unset(F.when(at(c) > 0, F.get("parts", (at(c) - 1).cast("int")))).alias(c) for c in columns])


def src_zeek_tsv(spark, path: str, *, columns=None, max_rows: int | None = None) -> DataFrame:
    """Read Zeek TSV (plain or gzip) as text columns.

    Each file names its own fields in its `#fields` line. Rows whose field count differs are
    left out, `zeek_misfits` has them; '-' and '(empty)' become null. `columns` fixes the result columns; by default
    they are the union over the distinct headers.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    heads = _heads(lines)
    if columns is None:  # distinct headers are few; only names reach the driver
        columns = []
        for (names,) in heads.select("names").distinct().collect():
            columns += [n for n in names if n not in columns]
    out = _named(_rows(lines, heads), columns)
    return out.limit(max_rows) if max_rows else out


def zeek_misfits(spark, path: str) -> DataFrame:
    """(file, value) of the rows that `src_zeek_tsv` leaves out: another number of fields than their header names, or no header."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return _rows(lines, _heads(lines)).filter("NOT fits").select("file", "value")


def src_zeek_stream(spark, directory: str, log: str, *, files_per_trigger: int = 16, pattern: str | None = None) -> DataFrame:
    """Stream of the lines (value, file) of one rotated log (conn, ssl or dns), to be landed by `zeek_landing`.

    A file arrives whole in one micro-batch, so its header is in the batch of its rows.
    """
    schema = T.StructType([T.StructField("value", T.StringType())])
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern or f"{log}*").text(directory)
    return lines.select("value", F.col("_metadata.file_path").alias("file"))


def zeek_landing(out: str, rejected: str, *, log: str = "conn", columns=None):
    """foreachBatch function: rows by the header of their file, as Parquet below `out`, with ts also as event_time.

    Batches are those of `src_zeek_stream`, or of `src_log_tail`, whose rows bring their header's names with them.
    Rows whose field count differs from their header, or whose file has none, go to `rejected` (file, value); nothing is
    lost. A retried batch replaces itself. Fields that a header lacks are null. `out` can be streamed from in turn.
    """
    columns = columns or LOGS[log]

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = _split(batch) if "names" in batch.columns else _rows(batch, _heads(batch))
        named = _named(rows, columns)
        named = named.withColumn("event_time", F.timestamp_micros((F.col("ts").try_cast("double") * 1_000_000).cast("long")))
        named.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        rows.filter("NOT fits").select("file", "value").write.mode("overwrite").parquet(f"{rejected}/batch_id={batch_id}")

    return run


def landed_schema(log: str = "conn", columns=None) -> T.StructType:
    """Columns that `zeek_landing` writes."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns or LOGS[log]] + [T.StructField("event_time", T.TimestampType())])


def write_zeek(df: DataFrame, path: str, log: str, mode: str = "overwrite") -> None:
    """Write rows as a Zeek TSV log; every part file starts with its header."""
    cols = df.columns
    line = F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in cols])
    head = "#separator \\x09\n#path\t" + log + "\n#fields\t" + "\t".join(cols)

    def with_header(batches):
        import pandas as pd
        first = True
        for b in batches:
            if first and len(b):
                b = pd.concat([pd.DataFrame({"value": [head]}), b], ignore_index=True)
                first = False
            yield b

    df.select(line.alias("value")).mapInPandas(with_header, "value string").write.mode(mode).text(path)
