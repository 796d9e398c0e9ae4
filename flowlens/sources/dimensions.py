"""Dimension tables from configuration files: JSON over several lines, and the lists of YAML files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from flowlens import values as V
from flowlens.operators.joins import frame
from flowlens.operators.policy import read_policies

SCHEMAS = {
    "devices": "ip string, hostname string, mac string, device_type string, department string, owner string, priority string, trusted boolean",
    "subnets": "cidr string, department string",
    "sensitivity": "department string, level string, data_class string, escalate boolean",
    "vlans": "ord int, vlan string, department string, priority string, cidr string",
    "anonymizer_ports": "category string, severity string, port int",
    "ja3_malware": "ja3 string, name string, family string, severity string",
    "tactics": "tactic_id string, tactic string",
    "holidays": "day string",
    "internal_networks": "cidr string",
}


def json_entries(spark: SparkSession, path: str, section: str, fields: str) -> DataFrame:
    """(ord, name, the fields) of the entries of one section, an object of objects or of plain values, in file order.

    fields: a struct's schema, or one type name for plain values, which become the column `value`. An entry that does not
    fit has null fields; a section that is missing has no rows.
    """
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("s"))
    entries = whole.select(F.posexplode(F.map_entries(F.from_json(F.col("s")[section], "map<string,string>"))).alias("ord", "e")).select("ord", F.col("e.key").alias("name"), F.col("e.value").alias("v"))
    if " " not in fields:
        return entries.select("ord", "name", F.col("v").try_cast(fields).alias("value"))
    return entries.select("ord", "name", F.from_json("v", fields).alias("c")).select("ord", "name", "c.*")


def yaml_lists(spark: SparkSession, path: str) -> DataFrame:
    """(section, ord, value) of the plain items of a YAML file's lists, as `- value` lines or `[a, b]`, without quotes and comments."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\\r?\\n")).alias("ord", "line"))
    bare = F.rtrim(F.regexp_replace("line", r"(^|\s)#.*$", ""))
    lines = lines.withColumn("line", bare).filter(F.trim("line") != "")
    lines = lines.withColumn("head", F.regexp_extract("line", r"^([A-Za-z_]\w*):", 1))
    lines = lines.withColumn("section", F.last(F.when(F.col("head") != "", F.col("head")), ignorenulls=True).over(W.orderBy("ord").rowsBetween(W.unboundedPreceding, 0)))  # one file of configuration
    inline = F.split(F.regexp_extract("line", r"^\w+:\s*\[(.*)\]\s*$", 1), ",")
    item = F.regexp_extract("line", r"^\s*-\s+(.*)$", 1)
    each = lines.select("section", "ord", F.explode(F.when(F.col("head") != "", inline).otherwise(F.array(item))).alias("value"))
    return each.select("section", "ord", F.btrim(F.btrim("value"), F.lit("\"'")).alias("value")).filter("value <> ''")


def _or(c: str, default) -> Column:
    return F.coalesce(F.col(c), F.lit(default))


def src_dimensions(spark: SparkSession, files: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Dimension tables: from a file where `files` names one, else from the fixed values.

    Files: identity (devices, subnets, sensitivity), vlans, policies (anonymizer ports), ja3, mitre (tactics), holidays
    and networks (YAML lists; networks add to the fixed ones, single addresses as /32 or /128).
    """
    files = files or {}
    fixed = {
        "devices": [], "subnets": V.SUBNET_DEPARTMENTS.items(), "sensitivity": [(k, *v) for k, v in V.DEPARTMENT_SENSITIVITY.items()],
        "vlans": [(i, *v) for i, v in enumerate(V.VLANS)], "anonymizer_ports": [(n, s, p) for n, s, ps in V.ANONYMIZERS for p in ps],
        "ja3_malware": [(k, *v) for k, v in V.JA3_MALWARE.items()], "tactics": V.TACTICS, "holidays": [(d,) for d in V.HOLIDAYS], "internal_networks": [(c,) for c in V.INTERNAL_CIDRS_V4],
    }
    out = {name: frame(spark, rows, SCHEMAS[name]) for name, rows in fixed.items()}
    if path := files.get("identity"):
        d = json_entries(spark, path, "devices", "hostname string, mac string, type string, department string, owner string, priority string, trusted boolean")
        out["devices"] = d.select(F.col("name").alias("ip"), _or("hostname", "").alias("hostname"), _or("mac", "").alias("mac"), _or("type", "unknown").alias("device_type"),
                                  _or("department", "Unknown").alias("department"), _or("owner", "").alias("owner"), _or("priority", "medium").alias("priority"), _or("trusted", False).alias("trusted"))
        out["subnets"] = json_entries(spark, path, "subnet_to_department", "string").select(F.col("name").alias("cidr"), F.col("value").alias("department"))
        d = json_entries(spark, path, "department_sensitivity", "level string, data_class string, alert_escalation boolean")
        out["sensitivity"] = d.select(F.col("name").alias("department"), "level", "data_class", _or("alert_escalation", False).alias("escalate"))
    if path := files.get("vlans"):
        d = json_entries(spark, path, "vlan_map", "department string, priority string, subnet string")
        out["vlans"] = d.select("ord", F.col("name").alias("vlan"), "department", "priority", F.col("subnet").alias("cidr"))
    if path := files.get("policies"):
        out["anonymizer_ports"] = read_policies(spark, path).ports.select("category", "severity", "port")
    if path := files.get("ja3"):
        d = spark.read.text(path, wholetext=True).select(F.from_json(F.from_json("value", "map<string,string>")["malware_ja3"], "map<string,struct<name:string,family:string,severity:string>>").alias("m"))
        out["ja3_malware"] = d.select(F.explode("m").alias("ja3", "c")).select("ja3", "c.name", "c.family", "c.severity")
    if path := files.get("mitre"):
        out["tactics"] = json_entries(spark, path, "tactic_meta", "id string, `order` int").select(F.col("id").alias("tactic_id"), F.col("name").alias("tactic"))
    if path := files.get("holidays"):
        out["holidays"] = yaml_lists(spark, path).filter("section = 'holidays'").select(F.col("value").alias("day"))
    if path := files.get("networks"):
        own = yaml_lists(spark, path)
        single = F.concat("value", F.when(F.col("value").contains(":"), "/128").otherwise("/32"))
        out["internal_networks"] = out["internal_networks"].unionByName(
            own.filter("section IN ('extra_internal', 'public_office_ips')").select(F.when(F.col("section") == "extra_internal", F.col("value")).otherwise(single).alias("cidr"))).distinct()
    return out
