"""Threat feeds from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowlens import values as V


def _lines(spark, path: str, comment: str) -> DataFrame:
    v = F.trim("value")
    return spark.read.text(path).select(v.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith(comment))


def _tag(df: DataFrame, feed: str, category: str, severity: str) -> DataFrame:
    return df.withColumns({"category": F.lit(category), "severity": F.lit(severity), "feed": F.lit(feed)})


def src_feed_ip_list(spark, path: str, *, feed: str, category: str, severity: str, comment: str = "#",
                     whitelist=tuple(V.TI_WHITELISTED_IPS)) -> DataFrame:
    """IOC rows of an address list: first token of each line, dotted quads only."""
    ip = F.trim(F.split_part(F.split_part(F.regexp_replace("line", r"\s+", " "), F.lit(" "), F.lit(1)), F.lit(","), F.lit(1)))
    d = _lines(spark, path, comment).select(ip.alias("ip")).filter(F.col("ip").rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$") & ~F.col("ip").isin(list(whitelist)))
    return _tag(d.distinct(), feed, category, severity)


def src_feed_ja3_csv(spark, path: str, *, feed: str, category: str, severity: str) -> DataFrame:
    """IOC rows of a fingerprint CSV: hash and name (last field of four or more, else the second)."""
    p = F.split("line", ",")
    d = _lines(spark, path, "#").filter(~F.col("line").startswith("ja3_md5")).select(p.alias("p")).filter(F.size("p") >= 2)
    name = F.when(F.size("p") >= 4, F.element_at("p", -1)).otherwise(F.element_at("p", 2))
    d = d.select(F.trim(F.element_at("p", 1)).alias("ja3"), F.trim(name).alias("name")).filter(F.length("ja3") == 32)
    return _tag(d.groupBy("ja3").agg(F.max("name").alias("name")), feed, category, severity)


def src_feed_url_list(spark, path: str, *, feed: str, category: str, severity: str, comment: str = "#",
                      whitelist=tuple(V.TI_WHITELISTED_DOMAINS)) -> tuple[DataFrame, DataFrame]:
    """(url rows, domain rows of their hosts) of a URL list."""
    urls = _lines(spark, path, comment).select(F.col("line").alias("url")).distinct()
    dom = urls.select(F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("domain")).filter(
        F.col("domain").isNotNull() & (F.col("domain") != "") & ~F.col("domain").isin(list(whitelist))).distinct()
    return _tag(urls, feed, category, severity), _tag(dom, feed, category, severity)


def src_popular_domains(spark, path: str) -> DataFrame:
    """Lower-cased names of a `rank,domain` list."""
    v = F.split("value", ",", 2)
    return spark.read.text(path).select(F.trim("value").alias("value")).filter(F.size(v) == 2).select(F.lower(F.element_at(v, 2)).alias("domain")).distinct()
