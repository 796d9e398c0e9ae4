"""Alert shaping, routing and text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens import values as V
from flowlens.functions.scores import lookup


def shape_alerts(df: DataFrame) -> DataFrame:
    """Append final_score, rule_names, ueba_reasons and correlated from the scores and reasons."""
    s = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rules = F.filter("reasons", lambda r: r.startswith(V.RULE_PREFIX))
    return df.withColumns({
        "final_score": F.round(F.greatest(s("ml_score"), s("ueba_score"), s("rule_score"), s("eta_score")), 6),
        "rule_names": rules, "ueba_reasons": F.filter("reasons", lambda r: ~r.startswith(V.RULE_PREFIX)),
        "correlated": (F.size(rules) > 0) & ((s("ml_score") >= 0.5) | (s("ueba_score") >= 0.5))})


def build_alert(df: DataFrame) -> DataFrame:
    """Alert rows of fused flows; reasons in the order peers, policy, behaviour, rules."""
    none = F.array().cast("array<string>")
    part = lambda c: F.coalesce(F.col(c), none) if c in df.columns else none
    rules = F.transform(part("rule_alerts"), lambda r: F.concat(F.lit("Rule: "), r))
    d = df.filter("alert").withColumn("reasons", F.concat(part("peer_reasons"), part("policy_reasons"), part("ueba_reasons"), rules))
    return d.select(
        F.col("flow_id").alias("id"), "flow_id", "t_us", "ts", "severity", F.col("ml_type").alias("attack_type"),
        F.coalesce("ml_source", "tag").alias("source"), "src_ip", "dst_ip", "dst_port", F.lit(0.0).alias("confidence"),
        "ml_score", F.col("ueba_anomaly").alias("ueba_score"), "rule_score", "eta_score", "tag", "reasons", "department",
        F.round("peer_score", 4).alias("peer_deviation_score"))


def immediate_alert(df: DataFrame) -> DataFrame:
    """Alert rows of flows that the intelligence gate stops at once."""
    d = df.filter("gate_action = 'ALERT_IMMEDIATE'")
    zero = F.lit(0.0)
    return d.select(
        F.col("flow_id").alias("id"), "flow_id", "t_us", "ts", F.col("gate_severity").alias("severity"), F.col("gate_attack").alias("attack_type"),
        F.col("gate_source").alias("source"), "src_ip", "dst_ip", "dst_port", (F.col("gate_confidence") * 100).alias("confidence"),
        zero.alias("ml_score"), zero.alias("ueba_score"), zero.alias("rule_score"), "eta_score", F.lit("INTEL_GATE").alias("tag"),
        F.array(F.concat_ws(" ", "gate_source", "gate_attack")).alias("reasons"), "department", zero.alias("peer_deviation_score"))


def route_alerts(df: DataFrame, *, enabled, routes=None) -> DataFrame:
    """Outbox rows: one per alert and enabled channel of its severity."""
    table = routes or V.ALERT_ROUTES
    chans = F.array().cast("array<string>")
    for sev, names in table.items():
        on = [n for n in names if n in set(enabled)]
        if on:
            chans = F.when(F.col("severity") == sev, F.array(*[F.lit(n) for n in on])).otherwise(chans)
    return df.withColumn("channel", F.explode(chans))


def cef_format(df: DataFrame, *, vendor: str = "flowlens", product: str = "flowlens", version: str = "1.0", facility: int = V.SYSLOG_FACILITY) -> Column:
    """CEF line with the syslog priority in front."""
    sev = lookup("severity", V.SYSLOG_SEVERITY, 6)
    return F.concat(F.lit("<"), (sev + facility * 8).cast("string"), F.lit(f">CEF:0|{vendor}|{product}|{version}|"), F.col("attack_type"), F.lit("|"),
                    F.col("severity"), F.lit("|"), sev.cast("string"), F.lit("|src="), F.col("src_ip"), F.lit(" dst="), F.col("dst_ip"), F.lit(" dpt="),
                    F.col("dst_port").cast("string"), F.lit(" cs1="), F.col("tag"), F.lit(" cs2="), F.col("department"), F.lit(" cfp1="),
                    F.round("confidence", 2).cast("string"), F.lit(" msg="), F.array_join(F.slice("reasons", 1, 3), "; "))


def recommended_action() -> Column:
    return (F.when(F.col("severity") == "CRITICAL", V.ACTION_CRITICAL).when(F.col("attack_type") == "Ransomware", V.ACTION_RANSOMWARE)
            .when(F.col("severity") == "HIGH", V.ACTION_HIGH).otherwise(V.ACTION_DEFAULT))


def certin_report(df: DataFrame, *, organization: str = "", sector: str = "", email: str = "", phone: str = "", reported_at=None, product: str = "flowlens", name: str = "report") -> DataFrame:
    """Append an incident report per alert, as nested JSON text.

    Alerts may bring ja3 (text) and threat_intel_hits (list of text); without them both are empty.
    """
    ja3 = F.coalesce(F.col("ja3"), F.lit("")) if "ja3" in df.columns else F.lit("")
    hits = F.coalesce(F.col("threat_intel_hits"), F.array().cast("array<string>")) if "threat_intel_hits" in df.columns else F.array().cast("array<string>")
    a = lambda c, n=None: F.col(c).alias(n or c)
    lit = lambda v, n: F.lit(v).alias(n)
    when = F.coalesce(reported_at, F.current_timestamp()) if reported_at is not None else F.current_timestamp()
    text = F.concat(F.col("attack_type"), F.lit(f" detected by {product}. Source: "), F.col("src_ip"), F.lit(" -> Destination: "), F.col("dst_ip"),
                    F.lit(":"), F.col("dst_port").cast("string"), F.lit(". Confidence: "), F.format_number("confidence", 1), F.lit("%."))
    end = lambda ip, role, dept, port: F.struct(F.col(ip).alias("ip"), F.lit(role).alias("role"), dept.alias("department"), port.alias("port"))
    return df.withColumn(name, F.to_json(F.struct(
        lit("1.0", "certin_schema_version"),
        F.struct(lit(organization, "organization"), lit(sector, "sector"), lit(email, "contact_email"), lit(phone, "contact_phone")).alias("reporting_entity"),
        F.struct(F.coalesce(lookup("attack_type", V.INCIDENT_TYPES), F.lit(V.INCIDENT_DEFAULT)).alias("type"), a("severity"),
                 F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("detection_timestamp"),
                 F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss").alias("reporting_timestamp"), text.alias("description")).alias("incident"),
        F.array(end("src_ip", "source", F.col("department"), F.lit(None).cast("int")),
                end("dst_ip", "destination", F.lit(None).cast("string"), F.col("dst_port").cast("int"))).alias("affected_systems"),
        F.struct(a("attack_type"), a("ml_score"), a("ueba_score"), a("rule_score"), ja3.alias("ja3_hash"), hits.alias("threat_intel_hits"), a("reasons")).alias("indicators"),
        recommended_action().alias("recommended_action"))))


def alert_text(df: DataFrame, *, product: str = "flowlens") -> DataFrame:
    """Append mail subject and body, chat title and evidence."""
    num = lambda c, d: F.format_number(F.coalesce(F.col(c), F.lit(0.0)), d)
    lines = [("Severity", F.col("severity")), ("Attack Type", F.col("attack_type")), ("Source", F.col("tag")),
             ("Time", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")), ("Source IP", F.col("src_ip")), ("Dest IP", F.col("dst_ip")),
             ("Dest Port", F.col("dst_port").cast("string")), ("Department", F.col("department")), ("Confidence", F.concat(num("confidence", 1), F.lit("%"))),
             ("ML Score", num("ml_score", 3)), ("UEBA Score", num("ueba_score", 3)), ("ETA Score", num("eta_score", 3))]
    body = F.concat_ws("\n", *[F.concat(F.lit(k + ": "), v) for k, v in lines], F.lit("Reasons:"),
                       F.array_join(F.transform("reasons", lambda r: F.concat(F.lit("  - "), r)), "\n"))
    head = F.concat(F.lit("["), F.col("severity"), F.lit("] "))
    return df.withColumns({"mail_subject": F.concat(head, F.lit(f"{product}: "), F.col("attack_type"), F.lit(" from "), F.col("src_ip")), "mail_body": body,
                           "chat_title": F.concat(head, F.col("attack_type")),
                           "chat_evidence": F.array_join(F.transform(F.slice("reasons", 1, 5), lambda r: F.concat(F.lit("- "), r)), "\n")})


def json_lists(c) -> Column:
    """JSON text list to ARRAY<STRING>; bad text gives an empty array."""
    return F.coalesce(F.from_json(F.col(c) if isinstance(c, str) else c, "array<string>"), F.array().cast("array<string>"))
