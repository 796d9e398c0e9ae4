"""Set operations on tables, columns and per-row sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowlens import values as V


def latest_wins(old: DataFrame, new: DataFrame, *, key, order) -> DataFrame:
    """Upsert: rows of both tables, the newest per key. An aggregate, so it combines map-side."""
    ks = [key] if isinstance(key, str) else list(key)
    u = old.unionByName(new)
    rest = [c for c in u.columns if c not in ks]
    return u.groupBy(*ks).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*ks, "_r.*").select(*u.columns)


def union_iocs(*feeds: DataFrame, key: str) -> DataFrame:
    """Union of feeds in load order; the last feed wins per key."""
    u = None
    for i, f in enumerate(feeds):
        f = f.withColumn("_seq", F.lit(i))
        u = f if u is None else u.unionByName(f)
    rest = [c for c in u.columns if c not in (key, "_seq")]
    return u.groupBy(key).agg(F.max_by(F.struct(*rest), "_seq").alias("_r")).select(key, "_r.*")


def union_hosts(known: DataFrame, new: DataFrame) -> DataFrame:
    """(domain, host) pairs of both tables, once each; sets stay rows."""
    return known.select("domain", "host").unionByName(new.select("domain", "host")).distinct()


def except_whitelist(iocs: DataFrame, whitelist: DataFrame, *, key: str) -> DataFrame:
    return iocs.join(whitelist.select(key), key, "left_anti")


def intersect_features(columns, loaded=None) -> list[str]:
    """Specialists a table can feed: any of a specialist's columns is there, else all loaded ones."""
    have = set(columns)
    routes = [n for n, need in V.SPECIALIST_ROUTES.items() if have & set(need)]
    return routes or list(V.SPECIALIST_ROUTES if loaded is None else loaded)


def route_per_row(df: DataFrame, *, available: str) -> DataFrame:
    """Append routes from a per-row array of available columns."""
    arr = [F.when(F.arrays_overlap(available, F.array(*[F.lit(c) for c in need])), F.lit(n)) for n, need in V.SPECIALIST_ROUTES.items()]
    hit = F.filter(F.array(*arr), lambda x: x.isNotNull())
    return df.withColumn("routes", F.when(F.size(hit) > 0, hit).otherwise(F.array(*[F.lit(n) for n in V.SPECIALIST_ROUTES])))


def port_set_intersect(df: DataFrame, *, key="src_ip", at: int | None = 200, t="t_us", rid="flow_id") -> DataFrame:
    """Role per source from the ports of its first `at` flows (all flows when None).

    Only membership flags and the number of distinct ports are kept per source.
    """
    from flowlens.operators.segments import row_index
    d = row_index(df, keys=key, name="_i", t=t, rid=rid).filter(F.col("_i") <= at) if at else df
    d = d.filter(F.col("dst_port") > 0).groupBy(key, "dst_port").agg(F.count(F.lit(1)).alias("_c"))
    has = lambda ports: F.bool_or(F.col("dst_port").isin(ports))
    g = d.groupBy(key).agg(has(V.INFRA_PORTS).alias("inf"), has(V.PRINTER_PORTS).alias("prn"), has(V.IOT_PORTS).alias("iot"),
                           has(V.SERVER_PORTS).alias("srv"), F.count(F.lit(1)).alias("n_ports"))
    role = (F.when(F.col("inf"), "Infrastructure").when(F.col("prn"), "Printer").when(F.col("iot"), "IoT")
            .when(F.col("srv") & (F.col("n_ports") > 5), "Server").otherwise("Workstation"))
    return g.select(key, "n_ports", role.alias("role"))
