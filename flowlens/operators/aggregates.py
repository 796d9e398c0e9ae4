"""Aggregations and reports. Counts and sums combine before the shuffle; lists are never
collected per key unless a fixed table bounds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowlens import values as V
from flowlens.functions import ip as IP, tls as L
from flowlens.functions.scores import lookup, severity_name, severity_rank
from flowlens.operators import quantiles as Q
from flowlens.operators.joins import family_tactic, frame, oui_prefix, oui_vendor, tactic_ids, vendor_class
from flowlens.session import cut

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
PEER = ["fpm", "unique_dst", "bytes_per_flow", "send_ratio"]


def newest_per(df: DataFrame, keys, n: int, order) -> DataFrame:
    """Newest n rows per key. The row_number limit is applied map-side before the shuffle."""
    w = W.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


# ── peers and long-term baselines ────────────────────────────────────────────
def agg_peer_baseline(samples: DataFrame, *, group="department", last: int = 500) -> DataFrame:
    """Mean and population deviation (floor 0.01) per group over its newest samples."""
    d = newest_per(samples, group, last, [F.col("t_us").desc(), F.col("flow_id").desc()])
    g = d.groupBy(group).agg(F.count(F.lit(1)).alias("n_samples"), *[F.avg(c).alias(f"mean_{c}") for c in PEER],
                             *[F.greatest(F.stddev_pop(c), F.lit(0.01)).alias(f"std_{c}") for c in PEER])
    members = samples.groupBy(group).agg(F.count_distinct("src_ip").alias("members"))
    g = g.join(members, group).filter(F.col("n_samples") >= 3)
    return g.withColumn("is_ready", (F.col("n_samples") >= 10) & (F.col("members") >= 2))


def agg_group_norms(samples: DataFrame, values: DataFrame, *, group="department", top: int = 10) -> DataFrame:
    """(group, value, n, rank): most common values per group, by the samples whose window held them.

    values: (flow_id, value) as `windows.window_values` gives them for the samples.
    """
    g = samples.select("flow_id", group).join(values, "flow_id").groupBy(group, "value").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(group).orderBy(F.col("n").desc(), "value")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def agg_welford(df: DataFrame, *, entity: str, entity_type: str, metrics=tuple(V.UEBA_METRICS), t="t_us") -> DataFrame:
    """Baseline rows (entity_type, entity, metric, n, mean, m2, first_us, last_us)."""
    per = df.groupBy(F.col(entity).alias("entity")).agg(
        F.min(t).alias("first_us"), F.max(t).alias("last_us"),
        *[F.count(m).alias(f"n_{m}") for m in metrics], *[F.avg(m).alias(f"a_{m}") for m in metrics],
        *[(F.var_pop(m) * F.count(m)).alias(f"v_{m}") for m in metrics])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"n_{m}").alias("n"), F.col(f"a_{m}").alias("mean"),
                              F.col(f"v_{m}").alias("m2")) for m in metrics])
    return per.select(F.lit(entity_type).alias("entity_type"), "entity", "first_us", "last_us", F.inline(rows))


def merge_welford(*snapshots: DataFrame) -> DataFrame:
    """Merge baseline snapshots: totals, pooled mean, and M2 with the spread of the means around it.

    The pooled mean is known before deviations from it are squared, so large values with a small spread keep it.
    """
    u = snapshots[0]
    for s in snapshots[1:]:
        u = u.unionByName(s)
    keys = ["entity_type", "entity", "metric"]
    n = F.sum("n").over(W.partitionBy(*keys))
    # weights before products: no sum of n * mean, which would lose the low digits of large means
    u = u.withColumn("_mean", F.sum(F.col("mean") * F.try_divide(F.col("n"), n)).over(W.partitionBy(*keys)))
    away = F.col("mean") - F.col("_mean")
    return u.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * away * away).alias("m2"),
                                F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def agg_device_report(baseline: DataFrame, *, target_seconds: int = V.UEBA_TARGET_SECONDS) -> DataFrame:
    """Per device: flows, observed seconds, coverage of the target, mean and deviation per metric, dataset span."""
    span = baseline.select((F.max("last_us") - F.min("first_us")) / 1e6).scalar()
    g = baseline.groupBy("entity").pivot("metric", list(V.UEBA_METRICS)).agg(
        F.first("mean").alias("mean"), F.first(F.when(F.col("n") > 1, F.sqrt(F.try_divide("m2", "n"))).otherwise(0.0)).alias("stdev_pop"))
    t = baseline.groupBy("entity").agg(F.max("n").alias("total_flows"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    obs = (F.col("last_us") - F.col("first_us")) / 1e6
    return t.join(g, "entity").select("*", obs.alias("observed_seconds"),
                                      F.round(F.least(F.lit(100.0), obs * 100.0 / target_seconds), 1).alias("coverage_pct"),
                                      F.greatest(span, F.lit(1.0)).alias("dataset_span_seconds"))


def agg_dept_baselines(baseline: DataFrame, *, min_samples: int = V.UEBA_MIN_SAMPLES) -> DataFrame:
    """Department metrics with sample deviation; mature when every metric has enough samples."""
    mature = baseline.groupBy("entity").agg(F.bool_and(F.col("n") >= min_samples).alias("mature"))
    return baseline.join(mature, "entity").select(
        F.col("entity").alias("department"), "metric", "n", "mean",
        F.when(F.col("n") >= 2, F.sqrt(F.try_divide(F.col("m2"), F.col("n") - 1))).otherwise(0.0).alias("std"), "mature")


# ── devices and domains ──────────────────────────────────────────────────────
def device_signals(df: DataFrame) -> DataFrame:
    """(ip, t_us, port, class, weight, signal) rows of both ends of each internal flow.

    The listener is judged by its port; either end by address vendor, DHCP list and TLS use. An end without a hardware
    address of its own (dst_mac, src_mac) has the flow's (mac); the DHCP list is dhcp_option_55, else dhcp_fp.
    """
    text = lambda *names: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names if c in df.columns], F.lit(""))
    end = lambda ip, port, mac, server: F.struct(
        F.col(ip).alias("ip"), F.col(port).cast("int").alias("port"), text(mac, "mac").alias("mac"), F.lit(server).alias("server"))
    d = df.select("t_us", text("ja3").alias("ja3"), text("dhcp_option_55", "dhcp_fp").alias("dhcp"),
                  F.explode(F.array(end("dst_ip", "dst_port", "dst_mac", True), end("src_ip", "src_port", "src_mac", False))).alias("e"))
    d = d.select("t_us", "ja3", "dhcp", "e.*").filter(IP.is_device_endpoint("ip"))
    cls = lookup("port", {p: c for p, (c, _) in V.PORT_EVIDENCE.items()})
    wgt = lookup("port", {p: w for p, (_, w) in V.PORT_EVIDENCE.items()})
    vendor = oui_vendor("mac")
    dcls = lookup("dhcp", {k: c for k, (_, c) in V.DHCP_FINGERPRINTS.items()})
    vote = lambda c, w, s: F.struct(c.alias("class"), w.cast("double").alias("weight"), s.alias("signal"))
    votes = F.array(
        F.when(F.col("server") & cls.isNotNull(), vote(cls, wgt, F.concat(F.lit("port:"), F.col("port")))),
        F.when(vendor_class(vendor).isNotNull(), vote(vendor_class(vendor), F.lit(V.OUI_WEIGHT), F.concat(F.lit("oui:"), oui_prefix("mac")))),
        F.when(dcls.isNotNull(), vote(dcls, F.lit(V.DHCP_WEIGHT), F.concat(F.lit("dhcp:"), F.col("dhcp")))),
        F.when(F.col("ja3") != "", vote(F.lit("laptop"), F.lit(V.JA3_SEEN_WEIGHT), F.lit("ja3:seen"))))
    return d.select("ip", "t_us", F.when(F.col("server") & cls.isNotNull(), F.col("port")).alias("port"),
                    F.filter(votes, lambda v: v.isNotNull()).alias("votes"))


def agg_device_evidence(df: DataFrame, *, sysdescr: DataFrame | None = None) -> DataFrame:
    """Device table: best class by the weights of distinct votes, confidence, flow and port counts.

    Votes are made distinct per (ip, class, signal) first, so a busy address shrinks to a
    few rows before its classes are compared.
    """
    s = device_signals(df)
    base = s.groupBy("ip").agg(F.count(F.lit(1)).alias("flow_count"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))
    votes = s.select("ip", F.explode("votes").alias("v")).select("ip", "v.*")
    if sysdescr is not None:  # columns ip, descr
        c = sysdescr.withColumn("class", L.sysdescr_class("descr")).filter(F.col("class").isNotNull())
        votes = votes.unionByName(c.select("ip", "class", F.lit(V.SYSDESCR_WEIGHT).alias("weight"),
                                           F.concat(F.lit("snmp:"), F.substring("descr", 1, 40)).alias("signal")))
    per = (votes.groupBy("ip", "class", "signal").agg(F.max("weight").alias("weight"))
           .groupBy("ip", "class").agg(F.sum("weight").alias("w")))
    known = F.col("class") != "unknown"
    # at most one entry per device class
    g = per.groupBy("ip").agg(F.max_by(F.when(known, F.col("class")), F.when(known, F.struct(F.round("w", 9), "class"))).alias("best"),
                              F.max(F.when(known, F.col("w"))).alias("bw"), F.sum(F.when(known, F.col("w"))).alias("tw"),
                              F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", F.round("w", 4))))).alias("class_scores"))
    ports = (s.filter(F.col("port").isNotNull()).groupBy("ip", "port").agg(F.count(F.lit(1)).alias("n")).groupBy("ip")
             .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("port", "n")))).alias("observed_ports")))
    return base.join(g, "ip", "left").join(ports, "ip", "left").select(
        "ip", F.coalesce("best", F.lit("unknown")).alias("device_class"),
        F.round(F.coalesce(F.try_divide("bw", "tw"), F.lit(0.0)), 4).alias("confidence"),
        "flow_count", "first_us", "last_us", "class_scores", "observed_ports")


def agg_domain_observations(df: DataFrame, *, name="sni", ts="ts") -> DataFrame:
    """Per registered name: distinct hosts, queries, first and last seen, days seen."""
    d = df.filter(F.col(name) != "").withColumn("domain", L.sld(name)).filter(F.col("domain").isNotNull())
    return d.groupBy("domain").agg(F.count_distinct("src_ip").alias("distinct_hosts"), F.count(F.lit(1)).alias("total_queries"),
                                   F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count_distinct(F.to_date(ts)).alias("days_seen"))


def agg_promote_domains(obs: DataFrame, learned: DataFrame | None = None, *, min_hosts=V.PROMOTE_MIN_HOSTS,
                        min_days=V.PROMOTE_MIN_DAYS, min_queries=V.PROMOTE_MIN_QUERIES) -> DataFrame:
    """Names used by enough hosts on enough days, not learned yet."""
    d = obs.filter((F.col("distinct_hosts") >= min_hosts) & (F.col("days_seen") >= min_days) & (F.col("total_queries") >= min_queries))
    return d if learned is None else d.join(learned.select("domain"), "domain", "left_anti")


def agg_learn_fp(triaged: DataFrame, *, allow_tp: bool = False) -> DataFrame:
    """False-positive patterns: attack type, source and destination subnet, port."""
    g = triaged.groupBy(F.coalesce("attack_type", F.lit("")).alias("attack_type"), IP.subnet_pattern("src_ip").alias("src_pattern"),
                        IP.subnet_pattern("dst_ip").alias("dst_pattern"), F.coalesce("dst_port", F.lit(0)).alias("dst_port")).agg(
        F.count_if(F.col("verdict") == "FP").alias("fp"), F.count_if(F.col("verdict") == "TP").alias("tp"))
    if not allow_tp:
        g = g.filter(F.col("tp") == 0)
    return g.filter((F.col("fp") > 0) & ((F.col("attack_type") != "") | (F.col("src_pattern") != "") | (F.col("dst_pattern") != "") | (F.col("dst_port") != 0))
                    ).withColumn("confidence", F.col("fp") / (F.col("fp") + F.col("tp"))).withColumnRenamed("fp", "learned_from_n")


# ── alert reports ────────────────────────────────────────────────────────────
def _is_benign() -> Column:
    return F.coalesce("verdict", F.lit("")).startswith("benign-") | (F.coalesce("attack_type", F.lit("")) == "BENIGN")


def severity_counts(prefix: str = "") -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(prefix + s.lower()) for s in SEVERITIES]


def agg_severity_counts(alerts: DataFrame, devices: DataFrame) -> DataFrame:
    """One row: alerts per severity without benign ones, benign count, total, devices."""
    ok = ~_is_benign()
    g = alerts.agg(F.count(F.lit(1)).alias("total_alerts"),
                   *[F.count_if(ok & (F.col("severity") == s)).alias(f"{s.lower()}_count") for s in SEVERITIES],
                   F.count_if(~ok).alias("benign_count"))
    return g.withColumn("total_devices", devices.select(F.count(F.lit(1))).scalar())


def agg_dept_rollup(devices: DataFrame) -> DataFrame:
    """Per department: devices, alerts, highest risk; by priority, then risk."""
    g = devices.groupBy(F.when(F.coalesce("department", F.lit("")) == "", "Unmapped").otherwise(F.col("department")).alias("department")).agg(
        F.count(F.lit(1)).alias("device_count"), F.sum("alert_count").alias("alert_count"), F.max("risk_score").alias("risk_score"),
        F.min(lookup("priority", V.PRIORITY_RANK, 99)).alias("priority_rank"))
    return g.orderBy("priority_rank", F.col("risk_score").desc(), "department")


def agg_hour_severity(alerts: DataFrame, *, ts="ts") -> DataFrame:
    """Hour of day by severity, all 24 hours."""
    g = alerts.groupBy(F.hour(ts).alias("hour")).agg(*severity_counts())
    hours = alerts.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(g, "hour", "left").fillna(0)


def agg_timeseries(alerts: DataFrame, *, bucket: str = "hour", ts="ts") -> DataFrame:
    """Hour or day bucket by severity."""
    return alerts.groupBy(F.date_trunc(bucket, ts).alias("bucket")).agg(*severity_counts())


def agg_range_summary(alerts: DataFrame) -> DataFrame:
    """Total, per severity, distinct sources."""
    return alerts.agg(F.count(F.lit(1)).alias("total"), *severity_counts(),
                      F.count_distinct(F.when(F.col("src_ip") != "", F.col("src_ip"))).alias("unique_src_ips"))


def agg_rule_stats(alerts: DataFrame, *, ts="ts") -> DataFrame:
    """Per rule: fires, last fired, distinct ends, correlated, worst severity, ordinal in name order."""
    d = alerts.withColumn("_r", F.explode("rule_names"))
    d = d.withColumn("rule_name", F.trim(F.regexp_replace(F.trim("_r"), f"^{V.RULE_PREFIX}", ""))).filter(F.col("rule_name") != "")
    g = d.groupBy("rule_name").agg(
        F.count(F.lit(1)).alias("fires"), F.max(ts).alias("last_fired"), F.count_distinct(F.when(F.col("src_ip") != "", F.col("src_ip"))).alias("unique_src_ips"),
        F.count_distinct(F.when(F.col("dst_ip") != "", F.col("dst_ip"))).alias("unique_dst_ips"), F.sum(F.col("correlated").cast("long")).alias("correlated"),
        severity_name(F.max(severity_rank("severity"))).alias("worst_severity"))
    # one row per rule: the ordinal window runs over rule names only
    return g.withColumn("rule_id", F.row_number().over(W.orderBy("rule_name")))


def tactic_dim(spark) -> DataFrame:
    return frame(spark, [(*r, r[0] in V.TACTICS_COVERED) for r in V.TACTIC_META], "tactic string, tactic_id string, ord int, covered boolean")


def agg_tactic_distribution(alerts: DataFrame) -> DataFrame:
    """Alerts per tactic and family; the catch-all family is split by port; tactics without alerts appear with 0."""
    other = lambda i: lookup("dst_port", {p: v[i] for p, v in V.OTHER_BY_PORT.items()}, V.OTHER_DEFAULT[i])
    is_other = F.col("attack_type") == "Other"
    fam = F.coalesce("attack_type", F.lit("Unclassified"))
    g = alerts.filter(~_is_benign()).groupBy(
        F.when(is_other, other(0)).otherwise(F.coalesce(family_tactic(fam), F.lit("Unclassified"))).alias("tactic"),
        F.when(is_other, other(1)).otherwise(fam).alias("family")).agg(F.count(F.lit(1)).alias("n"))
    return tactic_dim(alerts.sparkSession).join(g, "tactic", "left").select(
        "tactic", "tactic_id", "ord", "covered", F.coalesce("family", F.lit("")).alias("family"), F.coalesce("n", F.lit(0)).alias("n"))


def agg_tactic_multi(alerts: DataFrame) -> DataFrame:
    """Alerts per tactic of the 1:n map, in fixed tactic order."""
    per = alerts.groupBy(F.coalesce("attack_type", F.lit("Unclassified")).alias("attack_type")).agg(F.count(F.lit(1)).alias("n"))
    g = per.select(F.explode(tactic_ids("attack_type")).alias("tactic_id"), "n").groupBy("tactic_id").agg(F.sum("n").alias("n"))
    dim = frame(alerts.sparkSession, [(i, *t) for i, t in enumerate(V.TACTICS)], "ord int, tactic_id string, tactic string")
    return dim.join(g, "tactic_id", "left").select("ord", "tactic_id", "tactic", F.coalesce("n", F.lit(0)).alias("n"))


def agg_score_histogram(alerts: DataFrame, *, column="ml_score", bins: int = 20) -> DataFrame:
    """Fixed-width bins over [0, 1], zero-filled."""
    bins = max(5, min(int(bins), 50))
    v = F.least(F.greatest(F.col(column), F.lit(0.0)), F.lit(1.0))
    g = alerts.filter(F.col(column).isNotNull()).groupBy(F.least(F.floor(v * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    dim = alerts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return dim.join(g, "bin", "left").select("bin", F.round(F.col("bin") / bins, 3).alias("lower_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def agg_entity_stats(entities: DataFrame) -> DataFrame:
    """Entity counts by readiness and risk, overall ('*') and per department.

    The overall row is added up from the department rows.
    """
    per = entities.groupBy("department").agg(
        F.count(F.lit(1)).alias("entities"), F.count_if("baseline_ready").alias("ready"), F.count_if(F.col("risk_score") >= 65).alias("high_risk"),
        F.count_if(F.col("risk_score") >= 80).alias("critical_risk"), F.sum("risk_score").alias("_s"), F.max("risk_score").alias("max_risk"),
        F.sum("total_flows").alias("total_flows"))
    sums = ["entities", "ready", "high_risk", "critical_risk", "_s", "total_flows"]
    total = per.agg(*[F.sum(c).alias(c) for c in sums], F.max("max_risk").alias("max_risk")).withColumn("department", F.lit("*"))
    return per.unionByName(total).withColumn("avg_risk", F.try_divide("_s", "entities")).drop("_s")


def agg_peer_group_summary(entities: DataFrame) -> DataFrame:
    return entities.filter(F.col("peer_group_id") >= 0).groupBy("peer_group_id", "department").agg(
        F.count(F.lit(1)).alias("member_count"), F.avg("risk_score").alias("avg_risk"), F.max("risk_score").alias("max_risk"))


def agg_alert_stats(outbox: DataFrame) -> DataFrame:
    """Dispatch counters by severity and channel."""
    return outbox.groupBy("severity", "channel").agg(F.count(F.lit(1)).alias("n"))


def fp_reduction(classified: DataFrame) -> DataFrame:
    """One row: whitelisted, gated, suppressed, fired, and the share kept away from analysts."""
    v = F.col("verdict")
    g = classified.agg(F.count(F.lit(1)).alias("total"), F.count_if(v == "benign-whitelist").alias("whitelisted"),
                       F.count_if(v == "benign-gated").alias("gated"), F.count_if(v == "benign-suppressed").alias("suppressed"),
                       F.count_if(v == "attack").alias("fired"))
    return g.withColumn("fp_reduction_rate", F.round(
        (F.col("whitelisted") + F.col("gated") + F.col("suppressed")) * 100.0 / F.greatest("total", F.lit(1)), 1))


def agg_engine_contribution(df: DataFrame, *, ml: float = 0.5, other: float = 0.65) -> DataFrame:
    """One row: alerts found by one engine only, or by all three."""
    m, u, r = F.col("ml_score") >= ml, F.col("ueba_score") >= other, F.col("rule_score") >= other
    return df.agg(F.count_if(m & u & r).alias("combined"), F.count_if(m & ~u & ~r).alias("ml_only"),
                  F.count_if(u & ~m).alias("ueba_only"), F.count_if(r & ~m & ~u).alias("rule_only"))


def agg_incidents(alerts: DataFrame, *, ts="ts", window: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """Incident records per source and time window, and the (incident_id, alert_id) rows.

    Members stay rows of their own, so that no record grows with the number of alerts.
    """
    start = F.window(ts, window)["start"]
    d = alerts.withColumns({"opened_at": start, "incident_id": F.sha2(F.concat_ws("|", "src_ip", F.unix_micros(start).cast("string")), 256)})
    head = d.groupBy("incident_id", "src_ip", "opened_at").agg(
        F.count(F.lit(1)).alias("alert_count"), F.max(severity_rank("severity")).alias("_r"), F.min("id").alias("first_alert_id"),
        F.max("id").alias("last_alert_id"), F.count_distinct("attack_type").alias("attack_types"))
    head = head.withColumns({"severity": severity_name("_r"), "status": F.lit("open"),
                             "title": F.concat(F.lit("Alerts from "), F.col("src_ip"))}).drop("_r")
    return head, d.select("incident_id", F.col("id").alias("alert_id"))


# ── model quality ────────────────────────────────────────────────────────────
def agg_psi(df: DataFrame, *, stats: dict[str, tuple[float, float]], min_rows: int = V.PSI_MIN_ROWS) -> DataFrame:
    """Population stability index per feature against normal deciles."""
    feats = list(stats)
    z = [F.struct(F.lit(c).alias("feature"), ((F.col(c) - F.lit(float(m))) / F.lit(max(float(s), 1e-10))).alias("z")) for c, (m, s) in stats.items()]
    d = df.select(F.inline(F.array(*z)))
    edges = V.NORMAL_DECILES
    b = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        b = F.when(F.col("z") < e, F.lit(i)).otherwise(b)
    counts = d.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(b == i).alias(f"b{i}") for i in range(V.PSI_BINS)])
    psi = F.lit(0.0)
    for i in range(V.PSI_BINS):
        a = F.greatest(F.col(f"b{i}") / F.col("n"), F.lit(1e-6))
        psi = psi + (a - F.lit(1.0 / V.PSI_BINS)) * F.log(a / F.lit(1.0 / V.PSI_BINS))
    return counts.filter(F.col("n") >= min_rows).select("feature", "n", psi.alias("psi"), (psi > V.PSI_ALERT).alias("drifted")).filter(F.col("feature").isin(feats))


def agg_binary_metrics(df: DataFrame, *, keys=(), label="label", predicted="predicted") -> DataFrame:
    """TP, FP, FN, precision, recall and F1, overall or per key."""
    p, y = F.col(predicted) == 1, F.col(label) == 1
    g = df.groupBy(*keys).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"))
    pr = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    rc = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return g.withColumns({"precision": pr, "recall": rc, "f1": 2 * pr * rc / F.greatest(pr + rc, F.lit(1e-9))})


LATENCY = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def agg_latency_percentiles(df: DataFrame, *, column: str, k: int | None = None) -> DataFrame:
    """p50, p95, p99, max, mean: exact ones by narrowing ranges, or with k from sketches of that size."""
    if k:
        return Q.sketched_quantiles(Q.quantile_sketches(df, [], column, k), [], LATENCY).drop("n")
    values = Q.exact_quantiles(df.select(column), [column], list(LATENCY.values()))[column]
    top = df.agg(F.max(column).cast("double"), F.avg(column)).first()
    return frame(df.sparkSession, [[*values, *top]], ", ".join(f"{n} double" for n in [*LATENCY, "max", "mean"]))


def agg_cold_start_median(df: DataFrame, *, columns=tuple(V.HOST_AGGREGATES)) -> DataFrame:
    """One row of exact medians, the values that hosts without history start from."""
    return Q.quantile_row(cut(df.select(*columns), "medians"), {c: (c, 0.5) for c in columns})


def agg_class_weights(df: DataFrame, *, label="family") -> DataFrame:
    """Inverse-frequency weight N / (K * n) per class, and the count it implies."""
    g = df.groupBy(F.col(label).alias("family")).agg(F.count(F.lit(1)).alias("n"))
    tot = g.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"))
    total, classes = tot.select("total").scalar(), tot.select("classes").scalar()
    w = total / (classes * F.col("n"))
    return g.select("family", "n", w.alias("class_weight"), F.round(total / (classes * w)).cast("long").alias("implied_count"),
                    F.coalesce(family_tactic("family"), F.lit("Unclassified")).alias("tactic"))


def source_alias(c) -> Column:
    """Fold spellings of one training source."""
    n = F.regexp_replace(c, "-heldout", "")
    return F.coalesce(lookup(n, V.SOURCE_ALIASES), n)


def agg_training_composition(train: DataFrame, heldout: DataFrame) -> DataFrame:
    """Rows per source; the training count wins over the held-out one."""
    a = train.groupBy(source_alias(F.col("source")).alias("source")).agg(F.sum("n").alias("train_count"))
    b = heldout.groupBy(source_alias(F.col("source")).alias("source")).agg(F.sum("n").alias("heldout_count"))
    return a.join(b, "source", "full").withColumn("n", F.coalesce("train_count", "heldout_count", F.lit(0)))


# ── tops ─────────────────────────────────────────────────────────────────────
def top_n(df: DataFrame, column: str, *, n: int = 10, blank=None) -> DataFrame:
    """Most frequent values; ties by value."""
    if blank is not None:
        df = df.filter(F.col(column) != blank)
    g = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.col("n").desc(), "value").limit(n)


def top_offenders(alerts: DataFrame, *, n: int = 15, ts="ts", attacks: int = 5) -> DataFrame:
    """Sources by alert count with worst severity, last seen and up to five attack types."""
    d = alerts.filter(F.coalesce("src_ip", F.lit("")) != "")
    per = d.groupBy("src_ip", "attack_type").agg(F.count(F.lit(1)).alias("c"), F.max(severity_rank("severity")).alias("r"), F.max(ts).alias("t"))
    g = per.groupBy("src_ip").agg(F.sum("c").alias("n"), severity_name(F.max("r")).alias("worst_severity"), F.max("t").alias("last_seen"))
    top = g.orderBy(F.col("n").desc(), "src_ip").limit(n)
    names = newest_per(per.join(top.select("src_ip"), "src_ip"), "src_ip", attacks, ["attack_type"])
    names = names.groupBy("src_ip").agg(F.sort_array(F.collect_list("attack_type")).alias("attacks"))
    return top.join(names, "src_ip")


def latest_per_key(df: DataFrame, *, keys, by, columns) -> DataFrame:
    """Newest row per key, as an aggregate."""
    ks = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*ks).agg(F.max_by(F.struct(*columns), by).alias("_r")).select(*ks, "_r.*")


def recent_alerts(alerts: DataFrame, *, n: int = 50) -> DataFrame:
    """Newest alerts with final score, tactic and rule flag."""
    top = alerts.orderBy(F.col("id").desc()).limit(n)
    return top.withColumns({"final_score": F.round(F.greatest("ml_score", "ueba_score", "rule_score", "eta_score"), 4),
                            "mitre_tactic": F.coalesce(family_tactic("attack_type"), F.lit("Unclassified")),
                            "correlated": F.exists("rule_names", lambda r: r.startswith(V.RULE_PREFIX))})


def device_alert_history(alerts: DataFrame, *, ip: str, n: int = 50) -> DataFrame:
    return alerts.filter(F.col("src_ip") == ip).orderBy(F.col("id").desc()).limit(n)


def high_risk_entities(entities: DataFrame, *, min_risk: float = 0, department: str | None = None, n: int = 100) -> DataFrame:
    d = entities.filter(F.col("risk_score") >= min_risk)
    d = d.filter(F.col("department") == department) if department else d
    return d.orderBy(F.col("risk_score").desc(), "ip").limit(n)


def risk_timeline(events: DataFrame, *, since_us=None, ip: str | None = None) -> DataFrame:
    """Risk events of one address ascending (200), or of all descending (500)."""
    d = events if since_us is None else events.filter(F.col("t_us") > since_us)
    if ip:
        return d.filter(F.col("src_ip") == ip).orderBy("t_us", "flow_id").limit(200)
    return d.orderBy(F.col("t_us").desc(), F.col("flow_id").desc()).limit(500)


def top_fp_patterns(patterns: DataFrame, *, n: int = 10) -> DataFrame:
    return patterns.orderBy(F.col("learned_from_n").desc(), F.col("confidence").desc(), "attack_type", "src_pattern", "dst_pattern", "dst_port").limit(n)


def top_drifted(psi: DataFrame, *, n: int = 5) -> DataFrame:
    return psi.filter("drifted").orderBy(F.col("psi").desc(), "feature").limit(n)
