"""Queries: sources, sinks and maintenance jobs. Files are written from the given tables
below the shared scratch folder and read back."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from flowlens import values as V
from flowlens.operators import aggregates as A, features as X, jobs as Jb, joins as J, setops as So
from flowlens.operators.joins import cidr_join
from flowlens.plans.flowview import START_US, alerts, flows, with_views
from flowlens.plans.q_aggregates import WFX, device_baseline, fp_patterns, spread
from flowlens.plans.q_features import CONN, conn, _RK
from flowlens.plans.q_joins import BAD_IPS, DIMS, dim
from flowlens.plans.registry import query, sql_round
from flowlens.session import scratch_path
from flowlens.sources import feeds, flowfiles, sinks, zeek
from flowlens.sources.dimensions import src_dimensions


def vw(sql, **kw):
    return with_views(sql, extra={**DIMS, "conn": CONN, **kw.pop("extra", {})}, **kw)


def text_file(df, name):
    path = scratch_path(df.sparkSession, name)
    df.select(F.col(df.columns[0]).alias("value")).write.mode("overwrite").text(path)
    return path


@query("src_zeek_tsv", vw("SELECT uid, orig_h AS src_ip, orig_p AS src_port, proto, history, resp_ip_bytes FROM conn"))
def _(spark, sf):
    path = scratch_path(spark, "conn-log")
    zeek.write_zeek(conn(spark, sf).select(*[F.col(f"`{c}`") for c in zeek.CONN]), path, "conn")
    d = zeek.src_zeek_tsv(spark, path)
    return d.select("uid", F.col("`id.orig_h`").alias("src_ip"), F.col("`id.orig_p`").cast("long").alias("src_port"), "proto", "history", F.col("resp_ip_bytes").cast("long"))


def cic_csv(spark, sf):
    path = scratch_path(spark, "cic-csv")
    f = flows(spark, sf)
    f.select(F.col("flow_id").alias(" Row"), F.col("dst_port").alias("Dst Port "), F.col("src_port").alias("Src Port"), F.col("protocol").alias("Protocol"), F.col("duration").alias("Flow Duration"),
             F.col("total_bytes").alias("Tot size"), F.col("fwd_packets").alias("Tot Fwd Pkts"), F.col("fwd_bytes").alias("TotLen Fwd Pkts"), F.col("bwd_bytes").alias("TotLen Bwd Pkts"),
             F.col("syn_flag").alias("SYN Flag Cnt"), F.when(F.col("p1") > 0.5, F.col("family")).otherwise("Benign").alias("Label")).write.option("header", True).csv(path)
    return path


@query("src_csv_flows", vw("SELECT flow_id, dst_port, CASE WHEN p1 > 0.5 THEN family ELSE 'Benign' END AS label FROM flows"))
def _(spark, sf):
    d = flowfiles.src_csv_flows(spark, cic_csv(spark, sf))
    return d.select(F.col("Row").cast("long").alias("flow_id"), F.col("Dst Port").cast("int").alias("dst_port"), F.col(flowfiles.label_column(d.columns)).alias("label"))


@query("src_csv_to_flow", vw(f"""SELECT concat('csv-', flow_id) AS flow_id, CASE WHEN p1 > 0.5 THEN concat('192.0.2.', flow_id % 3 + 105) ELSE concat('192.168.1.', flow_id % 5 + 10) END AS src_ip, src_port::INT AS src_port, dst_port, protocol, syn_flag, 0 AS rst_flag,
 CAST(p1 > 0.5 AS INT) AS label, {sql_round({'duration': 'duration', 'total_bytes': 'total_bytes', 'fwd_bytes': 'fwd_bytes'})} FROM flows"""))
def _(spark, sf):
    d = flowfiles.src_csv_to_flow(flowfiles.src_csv_flows(spark, cic_csv(spark, sf)), row_id="Row")
    return d.select("flow_id", "src_ip", "src_port", "dst_port", "protocol", "syn_flag", "rst_flag", "label", "duration", "total_bytes", "fwd_bytes")


@query("src_csv_row_numbers", vw("SELECT count(*) AS n, 1::BIGINT AS lowest, count(*) AS highest, count(*) AS different, 1 AS in_file_order FROM flows"))
def _(spark, sf):
    """Numbers of exporter rows, against their places in the files."""
    d = flowfiles.src_csv_flows(spark, cic_csv(spark, sf))
    numbered = flowfiles.number_rows(d.withColumn("place", F.col("_metadata.file_path")), "idx")
    per_file = numbered.groupBy("place").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count(F.lit(1)).alias("n"))
    whole = per_file.agg(F.bool_and(F.col("hi") - F.col("lo") + 1 == F.col("n")).cast("int").alias("in_file_order"))
    return numbered.agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("lowest"), F.max("idx").alias("highest"), F.count_distinct("idx").alias("different")).withColumn(
        "in_file_order", F.lit(whole.first()[0]))


@query("src_parquet_flows", vw("SELECT flow_id, src_ip, fwd_bytes FROM flows"))
def _(spark, sf):
    path = scratch_path(spark, "flows")
    flows(spark, sf).write.parquet(path)
    return flowfiles.src_parquet_flows(spark, path, columns=["flow_id", "src_ip", "fwd_bytes"])


@query("src_feed_ip_list", vw("SELECT DISTINCT dst_ip AS ip, 'scanner' AS category, 'MEDIUM' AS severity, 'f' AS feed FROM flows WHERE dst_port = 23"))
def _(spark, sf):
    t = flows(spark, sf).filter("dst_port = 23").select(F.expr("CASE flow_id % 4 WHEN 0 THEN concat('  ', dst_ip, ' # seen') WHEN 1 THEN concat(dst_ip, ',x') WHEN 2 THEN dst_ip ELSE concat(dst_ip, '\t9') END").alias("v"))
    junk = flows(spark, sf).filter("dst_port = 22").select(F.expr("CASE flow_id % 3 WHEN 0 THEN '# note' WHEN 1 THEN 'not.an.ip' ELSE '8.8.8.8' END").alias("v"))
    return feeds.src_feed_ip_list(spark, text_file(t.union(junk), "ips"), feed="f", category="scanner", severity="MEDIUM")


@query("src_feed_ja3_csv", vw("SELECT DISTINCT ja3, 'Evil' AS name, 'malware_tls' AS category, 'HIGH' AS severity, 'j' AS feed FROM flows WHERE ja3 <> ''"))
def _(spark, sf):
    t = flows(spark, sf).select(F.expr("CASE WHEN ja3 = '' THEN 'ja3_md5,Firstseen,Lastseen,Listingreason' WHEN flow_id % 2 = 0 THEN concat(ja3, ',2024,2025, Evil') ELSE concat(ja3, ',Evil') END").alias("v"))
    return feeds.src_feed_ja3_csv(spark, text_file(t, "ja3"), feed="j", category="malware_tls", severity="HIGH")


@query("src_feed_url_list", "SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS domain, 'malware_distribution' AS category, 'HIGH' AS severity, 'u' AS feed FROM pages")
def _(spark, sf):
    t = spark.read.parquet(f"{sf}/pages.parquet").select("url")
    return feeds.src_feed_url_list(spark, text_file(t, "urls"), feed="u", category="malware_distribution", severity="HIGH")[1]


@query("src_popular_domains", "SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS domain FROM pages")
def _(spark, sf):
    t = spark.read.parquet(f"{sf}/pages.parquet").select(F.concat_ws(",", "page_id", F.upper(F.try_parse_url("url", F.lit("HOST")))))
    return feeds.src_popular_domains(spark, text_file(t, "popular"))


# Configuration files unlike the fixed values.
CONFIG = {
    "identity": json.dumps({"description": "hosts", "devices": {"192.168.10.7": {"hostname": "h7", "type": "server", "department": "IT", "trusted": True}, "192.168.20.9": {"owner": "x"}},
                            "subnet_to_department": {"192.168.10.0/24": "IT", "192.168.20.0/24": "Finance"}, "department_sensitivity": {"IT": {"level": "high", "data_class": "internal"}}}, indent=1),
    "vlans": json.dumps({"vlan_map": {"10": {"department": "Technical", "priority": "critical", "subnet": "192.168.10.0/24"}}}, indent=1),
    "policies": json.dumps({"anonymizer_detection": {"enabled": True, "tor": {"dst_ports": [9001], "default_severity": "LOW"}, "web": {"dst_ports": [80, 8080]}, "off": {"enabled": False, "dst_ports": [53]}}}, indent=1),
    "ja3": json.dumps({"malware_ja3": {"b32309a26951912be7dba376398abc3b": {"name": "x", "family": "f", "severity": "HIGH"}}}, indent=1),
    "mitre": json.dumps({"tactic_meta": {"Impact": {"id": "TA0040", "order": 1}}}, indent=1),
    "holidays": "# days off\nhours: 4\n\nholidays:\n  - \"2024-01-01\"   # first\n  - 2024-01-26\n",
    "networks": "extra_internal: [93.184.3.0/24, '93.184.4.0/24']\npublic_office_ips:\n- 93.184.5.6\n",
}
_PORTED = "SELECT 'port' AS kind, CASE dst_port WHEN 9001 THEN 'tor' ELSE 'web' END AS a, CASE dst_port WHEN 9001 THEN 'LOW' ELSE 'MEDIUM' END AS b, count(*) AS n FROM flows WHERE dst_port IN (9001, 80, 8080) GROUP BY ALL"
_ROWS = """(VALUES ('device', '192.168.10.7', 'server/IT/true', 1), ('device', '192.168.20.9', 'unknown/Unknown/false', 1), ('subnet', '192.168.10.0/24', 'IT', 1), ('subnet', '192.168.20.0/24', 'Finance', 1),
 ('sensitivity', 'IT', 'high/internal/false', 1), ('vlan', '10', 'Technical/192.168.10.0/24', 1), ('tactic', 'TA0040', 'Impact', 1), ('holiday', '2024-01-01', NULL, 1), ('holiday', '2024-01-26', NULL, 1))"""


@query("src_dimensions", vw(f"""{_PORTED} UNION ALL SELECT 'ja3', 'x', 'f/HIGH', count(*) FROM flows WHERE ja3 = 'b32309a26951912be7dba376398abc3b' UNION ALL SELECT * FROM {_ROWS}
 UNION ALL SELECT 'internal', dst_ip, NULL, count(*) FROM flows WHERE dst_ip LIKE '93.184.3.%' OR dst_ip LIKE '93.184.4.%' OR dst_ip = '93.184.5.6' GROUP BY 2"""))
def _(spark, sf):
    """All dimensions from files, matched with flows where they meet them."""
    base = scratch_path(spark, "config")
    for name, text in CONFIG.items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{base}/{name}")
    d, f = src_dimensions(spark, {name: f"{base}/{name}" for name in CONFIG}), flows(spark, sf)

    def rows(df, kind, a, b=None, n=F.lit(1)):
        return df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), (F.concat_ws("/", *b) if b else F.lit(None).cast("string")).alias("b"), n.cast("long").alias("n"))

    ports = f.join(d["anonymizer_ports"], F.col("dst_port") == F.col("port")).groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))
    ja3 = f.select("ja3").join(d["ja3_malware"], "ja3").groupBy("name", "family", "severity").agg(F.count(F.lit(1)).alias("n"))
    nets = d["internal_networks"].filter("cidr LIKE '93.%'").withColumn("inside", F.lit(1))
    inside = cidr_join(f.filter("dst_ip LIKE '93.%'"), nets, ip="dst_ip", values=["inside"]).filter("inside = 1").groupBy("dst_ip").agg(F.count(F.lit(1)).alias("n"))
    tables = [rows(ports, "port", "category", ["severity"], F.col("n")), rows(ja3, "ja3", "name", ["family", "severity"], F.col("n")), rows(d["devices"], "device", "ip", ["device_type", "department", "trusted"]),
              rows(d["subnets"], "subnet", "cidr", ["department"]), rows(d["sensitivity"], "sensitivity", "department", ["level", "data_class", "escalate"]), rows(d["vlans"], "vlan", "vlan", ["department", "cidr"]),
              rows(d["tactics"], "tactic", "tactic_id", ["tactic"]), rows(d["holidays"], "holiday", "day"), rows(inside, "internal", "dst_ip", None, F.col("n"))]
    return reduce(DataFrame.unionByName, tables)


# ── sinks ────────────────────────────────────────────────────────────────────
_NEW = "SELECT DISTINCT dst_ip AS ip, 'seen' AS category, 'LOW' AS severity, 'feed_b' AS feed FROM flows WHERE dst_port IN (22, 80) AND dst_ip LIKE '93.%'"


@query("snk_upsert", vw("SELECT ip, category, severity, feed, 2 AS added FROM nw UNION ALL SELECT ip, category, severity, feed, 1 FROM bad_ips WHERE ip NOT IN (SELECT ip FROM nw)", extra={"nw": _NEW}))
def _(spark, sf):
    path = scratch_path(spark, "iocs")
    sinks.snk_upsert(dim(spark, sf, BAD_IPS).withColumn("added", F.lit(1)), path, key="ip", order="added")
    sinks.snk_upsert(dim(spark, sf, _NEW).withColumn("added", F.lit(2)), path, key="ip", order="added")
    return sinks.read_upserted(spark, path)


_FEED = "CASE category WHEN 'anonymizer' THEN 'tor_exit_nodes' WHEN 'botnet_c2' THEN 'feodo_botnet_c2' ELSE 'cinsscore_badguys' END"


@query("snk_feed_state", vw(f"SELECT f AS feed, coalesce(n, 0) AS entry_count, h AS update_hours FROM (VALUES ('feodo_botnet_c2', 1), ('sslbl_malicious_ja3', 6), ('urlhaus_online', 1), ('emergingthreats_compromised', 12), ('tor_exit_nodes', 6)) t(f, h) LEFT JOIN (SELECT {_FEED} AS f, count(*) AS n FROM bad_ips GROUP BY 1) USING (f)"))
def _(spark, sf):
    hour = 3_600_000_000
    state = sinks.snk_feed_state(dim(spark, sf, BAD_IPS).withColumn("feed", F.expr(_FEED)), updated_us=1000 * hour)
    due = sinks.feeds_due(state, V.FEEDS, now_us=1006 * hour)
    return due.join(state, "feed", "left").select("feed", F.coalesce("entry_count", F.lit(0)).alias("entry_count"), "update_hours")


@query("snk_baseline_state", vw(f"SELECT entity_type, entity, metric, n, first_us, last_us, {sql_round({'mean': 'mean', 'spread': 'sqrt(m2 / n)'})} FROM wdev", extra=WFX))
def _(spark, sf):
    path = scratch_path(spark, "baseline")
    sinks.snk_baseline_state(device_baseline(spark, sf), path)
    return spread(sinks.load_baseline_state(spark, path))


@query("snk_engine_stats", vw("SELECT t_us - t_us % 10000000 AS tick_us, count(*) AS flows, sum(CAST(p1 > 0.5 AS INT))::BIGINT AS layer2_attacks, round(round(count(*) / 10.0, 2), 6) + 0.0 AS flows_per_sec, round(quantile_disc(duration, 0.5), 6) + 0.0 AS latency_p50_ms, round(quantile_disc(duration, 0.95), 6) + 0.0 AS latency_p95_ms FROM flows GROUP BY 1"))
def _(spark, sf):
    f = flows(spark, sf).withColumns({"latency_ms": F.col("duration"), "layer2_attacks": F.col("p1") > 0.5})
    return sinks.snk_engine_stats(f)


@query("snk_jsonl", vw("SELECT id, severity, round(ml_score, 6) + 0.0 AS ml_score FROM alerts"))
def _(spark, sf):
    path = scratch_path(spark, "alerts-jsonl")
    sinks.snk_jsonl(alerts(spark, sf).select("id", "severity", "ml_score"), path)
    return spark.read.schema("id long, severity string, ml_score double").json(path)


# ── jobs ─────────────────────────────────────────────────────────────────────
NOW = "2024-01-31 00:00:00"
_ALL = "SELECT id, src_ip, dst_ip, t_us FROM alerts"


def pseudo(spark, sf):
    return Jb.pseudonymize_old(alerts(spark, sf, 1), now=NOW, salt="s", days=10)


_h = lambda c: f"CASE WHEN ts < TIMESTAMP '2024-01-21 00:00:00' THEN substr(sha256(concat('s', {c})), 1, 16) ELSE {c} END"
query("pseudonymize_old", vw(f"SELECT id, {_h('src_ip')} AS src_ip, {_h('dst_ip')} AS dst_ip, CAST(ts < TIMESTAMP '2024-01-21 00:00:00' AS INT) AS done FROM alerts", compress=1))(
    lambda spark, sf: pseudo(spark, sf).select("id", "src_ip", "dst_ip", F.col("ip_pseudonymized").cast("int").alias("done")))
query("purge_old", vw("SELECT id FROM alerts WHERE ts >= TIMESTAMP '2024-01-21 00:00:00'", compress=1))(
    lambda spark, sf: Jb.purge_old(alerts(spark, sf, 1), now=NOW, days=10).select("id"))
_IP = "192.168.20.3"
query("subject_export", vw(f"SELECT id FROM alerts WHERE src_ip = '{_IP}' OR dst_ip = '{_IP}'", compress=1))(
    lambda spark, sf: Jb.subject_export(pseudo(spark, sf), ip=_IP, salt="s").select("id"))
query("subject_delete", vw(f"SELECT id FROM alerts WHERE src_ip <> '{_IP}' AND dst_ip <> '{_IP}'", compress=1))(
    lambda spark, sf: Jb.subject_delete(pseudo(spark, sf), ip=_IP, salt="s").select("id"))
_EV = "SELECT id AS alert_id, t_us + 5 AS t_us, CASE id % 2 WHEN 0 THEN 'acknowledged' ELSE 'false_positive' END AS status, 'ann' AS by FROM alerts WHERE id % 3 = 0 UNION ALL SELECT id, t_us + 9, 'closed', 'bob' FROM alerts WHERE id % 9 = 0"


@query("alert_triage_update", vw("SELECT id, CASE WHEN id % 9 = 0 THEN 'closed' WHEN id % 3 <> 0 THEN 'new' WHEN id % 2 = 0 THEN 'acknowledged' ELSE 'false_positive' END AS status, CASE WHEN id % 9 = 0 THEN 'bob' WHEN id % 3 = 0 THEN 'ann' END AS acknowledged_by FROM alerts"))
def _(spark, sf):
    a = alerts(spark, sf)
    return Jb.alert_triage_update(a, spark.sql(_EV.replace("FROM alerts", "FROM {a}"), a=a)).select("id", "status", "acknowledged_by")


query("purge_external_devices", vw("SELECT DISTINCT dst_ip AS ip FROM flows WHERE dst_ip LIKE '192.168.%'"))(
    lambda spark, sf: Jb.purge_external_devices(flows(spark, sf).select(F.col("dst_ip").alias("ip")).distinct()))


@query("device_registry", vw(f"SELECT src_ip AS ip, min(t_us) AS first_us, max(t_us) AS last_us, count(*) AS alert_count, round(max(ml_score), 6) + 0.0 AS risk_score, max({_RK}) AS worst_rank FROM alerts GROUP BY 1"))
def _(spark, sf):
    a = alerts(spark, sf)
    return Jb.device_registry(a.filter("t_us >= 300000000"), Jb.device_registry(a.filter("t_us < 300000000")))


query("retention_stats", vw("SELECT t_us - t_us % 10000000 AS tick_us, count(*) AS flows FROM flows WHERE t_us - t_us % 10000000 >= 2592000000000 - 2 * 86400000000 GROUP BY 1", compress=1))(
    lambda spark, sf: Jb.retention_stats(sinks.snk_engine_stats(flows(spark, sf, 1).withColumn("latency_ms", F.col("duration"))), now_us=2_592_000_000_000).select("tick_us", "flows"))
