"""Policies as tables: rules read from a file, applied by equality joins.

The file is JSON over several lines. Its sections become tables with a rank where order decides: on equal severity the
earlier rule names the violation. Flows meet the rules of their port, device type, department and addresses in joins on
those; what a rule says about violations found before it is evaluated on the few rules a flow has met.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens import values as V
from flowlens.functions import ip as IP, scores as S, tls as L

VIOLATIONS = "array<struct<severity:string,category:string,subject:string>>"
SECTIONS = {
    "port": "enabled boolean, default_severity string, dst_ports array<int>",
    "device": "enabled boolean, rules array<struct<device_types: array<string>, forbidden_categories: array<string>, forbidden_ports: array<int>, severity: string>>",
    "department": "enabled boolean, rules map<string, struct<allowed_categories: array<string>, forbidden_categories: array<string>, severity_boost: string>>",
    "time": "enabled boolean, business_hours struct<start: int, `end`: int>",
    "vpn": "authorized_ips array<string>, authorized_departments array<string>, authorized_server_ips array<string>",
}


@dataclass
class PolicyRules:
    """ports (port, rank, category, severity); devices (device_type, rank, forbidden, ports, severity); departments

    (department, allowed, forbidden, severity); vpn (kind, value); hours (start, end): no row if time does not matter.
    """

    ports: DataFrame
    devices: DataFrame
    departments: DataFrame
    vpn: DataFrame
    hours: DataFrame


def _lower(c: str) -> Column:
    return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lower)


def read_policies(spark: SparkSession, path: str) -> PolicyRules:
    """Rules of a policy file. Sections that are missing or not enabled have no rules."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("s"))

    def section(name: str, schema: str) -> DataFrame:
        return whole.select(F.from_json(F.col("s")[name], schema).alias("c")).select("c.*")

    on = F.coalesce(F.col("enabled"), F.lit(False))
    kinds = whole.select(F.from_json(F.col("s")["anonymizer_detection"], "map<string,string>").alias("m")).filter(F.col("m")["enabled"] == "true")
    kinds = kinds.select(F.posexplode(F.map_entries("m")).alias("rank", "e")).select("rank", F.col("e.key").alias("category"), F.from_json("e.value", SECTIONS["port"]).alias("c"))
    kinds = kinds.filter(F.col("c.dst_ports").isNotNull() & F.coalesce(F.col("c.enabled"), F.lit(True)))
    ports = kinds.select(F.explode("c.dst_ports").alias("port"), "rank", "category", F.coalesce("c.default_severity", F.lit("MEDIUM")).alias("severity"))
    devices = section("device_restrictions", SECTIONS["device"]).filter(on).select(F.posexplode("rules").alias("rank", "r")).select("rank", "r.*")
    devices = devices.select(F.explode(_lower("device_types")).alias("device_type"), "rank", _lower("forbidden_categories").alias("forbidden"),
                             F.coalesce("forbidden_ports", F.array().cast("array<int>")).alias("ports"), F.coalesce("severity", F.lit("CRITICAL")).alias("severity")).distinct()
    departments = section("department_policies", SECTIONS["department"]).filter(on).select(F.explode("rules").alias("department", "r")).select("department", "r.*")
    departments = departments.select("department", _lower("allowed_categories").alias("allowed"), _lower("forbidden_categories").alias("forbidden"), F.coalesce("severity_boost", F.lit("HIGH")).alias("severity"))
    given = section("authorized_vpn", SECTIONS["vpn"])
    vpn = given.select(F.explode(F.map_from_arrays(F.array(F.lit("src_ip"), F.lit("department"), F.lit("dst_ip")),
                                                   F.array("authorized_ips", "authorized_departments", "authorized_server_ips"))).alias("kind", "values"))
    vpn = vpn.select("kind", F.explode("values").alias("value")).distinct()
    hours = section("time_based_policies", SECTIONS["time"]).filter(on).select(F.coalesce("business_hours.start", F.lit(V.BUSINESS_START)).alias("start"),
                                                                              F.coalesce("business_hours.end", F.lit(V.BUSINESS_END)).alias("end"))
    return PolicyRules(ports, devices, departments, vpn, hours)


def _violation(severity, category, subject) -> Column:
    as_column = [F.lit(x) if isinstance(x, str) else x for x in (severity, category, subject)]
    return F.struct(*[c.cast("string").alias(n) for c, n in zip(as_column, ("severity", "category", "subject"), strict=True)])


def _listed(rows: DataFrame, key: str, name: str, fields: list[str]) -> DataFrame:
    """One row a key with its rules in order: as many as the file has for it."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias(name))


def _forbidden(v: Column, forbidden: Column, allowed: Column | None = None) -> Column:
    """Violations in v of a category that is forbidden, or of any where anonymizers are as such."""
    bad = F.filter(v, lambda x: F.array_contains(forbidden, "anonymizer") | F.array_contains(forbidden, F.lower(x["category"])))
    return bad if allowed is None else F.filter(bad, lambda x: ~F.array_contains(allowed, F.lower(x["category"])))


def policy_by_rules(df: DataFrame, rules: PolicyRules, *, ts: str = "ts", patterns=tuple(V.BANK_LOOKALIKES), exfil_bytes: int = V.EXFIL_BYTES) -> DataFrame:
    """Append violation, policy_severity, policy_category, policy_reasons, policy_boost, as `policy_eval` does by built-in rules.

    Rules in order: anonymizer ports (not for private destinations), device, department, time, exfiltration, exit-node
    hit (dst_category), bank lookalike. A missing department, device type or name meets no rule of its kind.
    """
    none = F.array().cast(VIOLATIONS)
    hours = rules.hours.first()  # one row
    d = df.withColumns({"_port": F.col("dst_port").cast("int"), "_type": F.lower("device_type"), "_dst_public": ~IP.is_private("dst_ip")})
    d = d.join(_listed(rules.ports, "port", "_anon", ["category", "severity"]).withColumnRenamed("port", "_port"), "_port", "left")
    d = d.join(_listed(rules.devices, "device_type", "_device", ["forbidden", "ports", "severity"]).withColumnRenamed("device_type", "_type"), "_type", "left")
    d = d.join(rules.departments.select(F.col("department"), F.struct("allowed", "forbidden", "severity").alias("_dept")), "department", "left")
    for kind in ("src_ip", "department", "dst_ip"):
        own = rules.vpn.filter(F.col("kind") == kind).select(F.col("value").alias(kind), F.lit(True).alias(f"_vpn_{kind}"))
        d = d.join(own, kind, "left")
    allowed = F.coalesce("_vpn_src_ip", "_vpn_department", "_vpn_dst_ip", F.lit(False))
    tor = F.struct(F.lit(None).cast("int").alias("rank"), F.lit("tor").alias("category"), F.lit("HIGH").alias("severity"))
    hits = F.when(F.col("_dst_public"), F.coalesce("_anon", F.array().cast("array<struct<rank:int,category:string,severity:string>>"))).otherwise(F.array().cast("array<struct<rank:int,category:string,severity:string>>"))
    if "ja3" in df.columns:
        hits = F.concat(hits, F.when(F.col("ja3").isin(V.JA3_TOR), F.array(tor)).otherwise(F.array().cast("array<struct<rank:int,category:string,severity:string>>")))
    d = d.withColumn("_hits", hits)
    first = F.transform(F.filter("_hits", lambda h: ~((h["category"] == "vpn_unauthorized") & allowed)), lambda h: _violation(h["severity"], h["category"], F.col("dst_ip")))

    def device(v: Column, rule: Column) -> Column:
        bad = _forbidden(v, rule["forbidden"])
        return F.concat(v, F.when(F.size(bad) > 0, F.array(_violation(rule["severity"], "device_restriction", F.get(bad, F.lit(0))["category"]))).otherwise(none),
                        F.when(F.array_contains(rule["ports"], F.col("_port")), F.array(_violation(rule["severity"], "device_port_violation", F.col("_port")))).otherwise(none))

    # a list that a rule extends is a column of its own, so that it is evaluated once
    d = d.withColumn("_v0", first.cast(VIOLATIONS))
    d = d.withColumn("_v1", F.when(F.col("_device").isNull(), F.col("_v0")).otherwise(F.aggregate(F.col("_device"), F.col("_v0"), device)))
    bad = _forbidden(F.col("_v1"), F.col("_dept.forbidden"), F.col("_dept.allowed"))
    d = d.withColumn("_v2", F.when(F.col("_dept").isNotNull() & (F.size(bad) > 0), F.concat("_v1", F.array(_violation(F.col("_dept.severity"), "department_restriction", F.get(bad, F.lit(0))["category"])))).otherwise(F.col("_v1")))
    closed = F.lit(False)
    if hours is not None:
        closed = F.coalesce((F.weekday(ts) >= 5) | (F.hour(ts) < hours["start"]) | (F.hour(ts) > hours["end"]), F.lit(False))
    sni = F.coalesce(F.col("sni"), F.lit("")) if "sni" in df.columns else F.lit("")
    exit_hit = F.coalesce(F.col("dst_category") == "anonymizer", F.lit(False)) if "dst_category" in df.columns else F.lit(False)
    more = [F.when((F.size("_v2") > 0) & closed, _violation("MEDIUM", "time_escalation", "")),
            F.when((F.size("_hits") > 0) & (F.col("fwd_bytes") > exfil_bytes), _violation("CRITICAL", "exfiltration", F.col("fwd_bytes"))),
            F.when(exit_hit, _violation("HIGH", "tor_exit_node", F.col("dst_ip"))),
            F.when((sni != "") & L.bank_lookalike(sni, patterns).isNotNull(), _violation("HIGH", "credential_harvesting", sni))]
    d = d.withColumn("_v", F.concat("_v2", F.array_compact(F.array(*more))))
    rank = F.transform("_v", lambda v: S.severity_rank(v["severity"]))
    best = F.get("_v", (F.array_position(rank, F.array_max(rank)) - 1).cast("int"))
    d = d.withColumn("_best", F.when(F.size("_v") > 0, best))
    return d.select(*df.columns, (F.size("_v") > 0).alias("violation"), F.coalesce("_best.severity", F.lit("BENIGN")).alias("policy_severity"),
                    F.coalesce("_best.category", F.lit("")).alias("policy_category"),
                    F.transform("_v", lambda v: F.concat_ws(": ", F.upper(v["category"]), v["subject"])).alias("policy_reasons"),
                    S.lookup("_best.severity", V.POLICY_BOOST, 0.0).alias("policy_boost"))
