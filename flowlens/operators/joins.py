"""Enrichment joins.

Tables of unknown size are joined by equality, with no broadcast hint: Spark's size
statistics decide, and adaptive execution splits skewed partitions. Range, prefix and
suffix matches are turned into equality joins on the part of the key that must be equal.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowlens import values as V
from flowlens.functions import ip as IP, tls as L
from flowlens.functions.scores import lookup, severity_rank
from flowlens.operators.segments import SECOND, bucket_of


def frame(spark, rows, schema: str) -> DataFrame:
    """A small table from given rows. Built from Arrow data it is a local relation, so Spark
    knows its size when it chooses the join."""
    names = [f.split()[0] for f in schema.split(",")]
    return spark.createDataFrame(pd.DataFrame([tuple(r) for r in rows], columns=names), schema)


# ── logs ─────────────────────────────────────────────────────────────────────
def join_conn_ssl(conn: DataFrame, ssl: DataFrame) -> DataFrame:
    """Flows with their TLS record by uid; certificate flags derived."""
    d = conn.join(ssl, "uid", "left")
    subj, issuer = F.coalesce("cert_subject", F.lit("")), F.coalesce("cert_issuer", F.lit(""))
    return d.withColumns({"cert_self_signed": (subj == issuer) & (subj != ""),
                          "cert_expired": F.coalesce(F.col("validation_status") == "expired", F.lit(False))})


def join_dns_asof(conn: DataFrame, dns: DataFrame, *, bucket_us: int = 600 * SECOND) -> DataFrame:
    """Append dns_query: the latest name that resolved to dst_ip at or before the flow, else the SNI.

    `dns` has t_us, query and answers (comma list). The match runs inside (address, bucket);
    the last name of earlier buckets is carried in, so a hot address is split by time.
    """
    ans = (dns.select(F.col("t_us").alias("_t"), F.col("query").alias("_q"), F.explode(F.split("answers", ",")).alias("_ip"))
           .withColumn("_ip", F.trim("_ip")).filter(~F.col("_ip").isin("", "-") & (F.col("_q") != "")))
    row = F.struct(*[F.col(f"`{c}`") for c in conn.columns])
    left = conn.select(F.col("dst_ip").alias("_ip"), F.col("t_us").alias("_t"), F.lit(1).alias("_k"),
                       F.lit(None).cast("string").alias("_q"), row.alias("_row"))
    right = ans.select("_ip", "_t", F.lit(0).alias("_k"), "_q",
                       F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    ev = left.unionByName(right).withColumn("_b", bucket_of("_t", bucket_us))
    last = F.max_by(F.when(F.col("_k") == 0, F.col("_q")), F.when(F.col("_k") == 0, F.struct("_t", "_q")))
    before = W.partitionBy("_ip").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = ev.groupBy("_ip", "_b").agg(last.alias("_l")).select(
        "_ip", "_b", F.last("_l", ignorenulls=True).over(before).alias("_c"))
    inside = W.partitionBy("_ip", "_b").orderBy("_t", "_k", "_q").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = ev.join(carry, ["_ip", "_b"]).withColumn("_q", F.coalesce(F.last("_q", ignorenulls=True).over(inside), "_c"))
    out = d.filter("_k = 1").select("_row.*", "_q")
    sni = F.when(F.col("sni") != "", F.col("sni")) if "sni" in conn.columns else F.lit(None).cast("string")
    return out.withColumn("dns_query", F.coalesce("_q", sni)).withColumn("dns_resolved", F.col("_q")).drop("_q")


# ── networks ─────────────────────────────────────────────────────────────────
def cidr_join(df: DataFrame, nets: DataFrame, *, ip: str, values: list[str], first_by: str | None = None) -> DataFrame:
    """Append the values of the matching IPv4 network: most specific first, or lowest `first_by`.

    One equality join per distinct prefix length (at most 33), on the leading bits.
    """
    n = nets.withColumns({"_p": F.split_part("cidr", F.lit("/"), F.lit(2)).cast("int"),
                          "_net": IP.ip4(F.split_part("cidr", F.lit("/"), F.lit(1)))}).filter(F.col("_net").isNotNull())
    lengths = sorted((r[0] for r in n.select("_p").distinct().collect()), reverse=True)
    out = df.withColumn("_ip4", IP.ip4(ip))
    found: list[Column] = []
    for p in lengths:
        prio = F.col(first_by) if first_by else F.lit(-p)
        val = F.struct(prio.alias("_o"), *[F.col(v) for v in values])
        side = (n.filter(F.col("_p") == p)
                .groupBy(F.shiftright("_net", 32 - p).cast("long").alias(f"_n{p}"))
                .agg(F.min(val).alias(f"_v{p}")))
        out = out.withColumn(f"_n{p}", F.shiftright("_ip4", 32 - p).cast("long")).join(side, f"_n{p}", "left").drop(f"_n{p}")
        found.append(F.col(f"_v{p}"))
    best = F.array_min(F.array(*found)) if found else F.lit(None)
    out = out.withColumn("_best", best)
    return out.select(*df.columns, *[(F.col(f"_best.{v}") if found else F.lit(None).cast("string")).alias(v) for v in values])


def join_cidr_scope(df: DataFrame, nets: DataFrame, *, ip: str = "src_ip") -> DataFrame:
    """Append scope by a table of internal networks (column cidr)."""
    d = cidr_join(df, nets.withColumn("_in", F.lit(True)), ip=ip, values=["_in"])
    return d.withColumn("scope", F.when(F.col("_in"), "internal").when(IP.is_valid_ip(ip), "external")
                        .otherwise("invalid")).drop("_in")


def subnet_table(spark) -> DataFrame:
    return frame(spark, V.SUBNET_DEPARTMENTS.items(), "cidr string, department string")


def join_subnet_dept(df: DataFrame, subnets: DataFrame | None = None, *, ip: str = "src_ip") -> DataFrame:
    """Append department by most specific subnet, else Unknown."""
    nets = subnets if subnets is not None else subnet_table(df.sparkSession)
    return cidr_join(df.drop("department"), nets, ip=ip, values=["department"]).withColumn(
        "department", F.coalesce("department", F.lit("Unknown")))


def vlan_table(spark) -> DataFrame:
    return frame(spark, [(i, *v) for i, v in enumerate(V.VLANS)],
                 "ord int, vlan string, department string, priority string, cidr string")


def join_vlan_first(df: DataFrame, vlans: DataFrame | None = None, *, ip: str = "src_ip") -> DataFrame:
    """Append vlan, department, priority of the first matching network in map order, else the fallback."""
    t = vlans if vlans is not None else vlan_table(df.sparkSession)
    cols = ["vlan", "department", "priority"]
    d = cidr_join(df.drop(*cols), t, ip=ip, values=cols, first_by="ord")
    return d.withColumns({c: F.coalesce(c, F.lit(x)) for c, x in zip(cols, V.VLAN_FALLBACK)})


IDENTITY = ["hostname", "device_type", "department", "owner", "priority", "trusted"]


def join_identity(df: DataFrame, devices: DataFrame, subnets: DataFrame | None = None, *, ip: str = "src_ip", extra=()) -> DataFrame:
    """Append identity columns: external record, known device, else subnet defaults.

    `devices` has ip and the identity columns; missing values take defaults.
    """
    known = devices.select(F.col("ip").alias(ip), *[F.col(c).alias(f"_i_{c}") for c in IDENTITY], F.lit(True).alias("_known"))
    d = join_subnet_dept(df, subnets, ip=ip).join(known, ip, "left")
    ext, hit = IP.is_external(ip, extra), F.coalesce("_known", F.lit(False))
    defaults = {"hostname": "", "device_type": "unknown", "department": "Unknown", "owner": "", "priority": "medium", "trusted": False}
    external = {"hostname": "", "device_type": "external", "department": "External", "owner": "", "priority": "low", "trusted": False}
    fallback = {**{c: F.lit(v) for c, v in defaults.items()}, "department": F.col("department")}
    d = d.withColumn("_ext", ext)
    cols = {c: F.when(F.col("_ext"), F.lit(external[c])).when(hit, F.coalesce(f"_i_{c}", F.lit(defaults[c]))).otherwise(fallback[c])
            for c in IDENTITY}
    d = d.withColumns(cols)
    level = lookup("department", {k: v[0] for k, v in V.DEPARTMENT_SENSITIVITY.items()}, "medium")
    klass = lookup("department", {k: v[1] for k, v in V.DEPARTMENT_SENSITIVITY.items()})
    esc = lookup("department", {k: v[2] for k, v in V.DEPARTMENT_SENSITIVITY.items()}, False)
    d = d.withColumns({
        "sensitivity": F.when(F.col("_ext"), "low").otherwise(level),
        "data_class": F.when(F.col("_ext"), "external").otherwise(F.coalesce(klass, F.when(hit, "internal").otherwise("unknown"))),
        "alert_escalation": esc})
    return d.drop("_ext", "_known", *[f"_i_{c}" for c in IDENTITY])


# ── threat intelligence ──────────────────────────────────────────────────────
HIT = "struct<type:string,value:string,category:string,severity:string,feed:string,direction:string>"


def _hit(kind: str, value: Column, p: str, direction: str = "dst") -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("value"), F.col(f"{p}_category").alias("category"),
                    F.col(f"{p}_severity").alias("severity"), F.col(f"{p}_feed").alias("feed"),
                    F.lit(direction).alias("direction"))


def _ioc(table: DataFrame, key: str, to: str, p: str) -> DataFrame:
    """Feed side of a join: one row a key, the most severe entry, of several the first by feed and category."""
    entry = ("category", "severity", "feed")
    best = F.min_by(F.struct(*entry), F.struct(-severity_rank("severity"), "feed", "category"))
    return table.groupBy(F.col(key).alias(to)).agg(best.alias("_e")).select(to, *[F.col(f"_e.{c}").alias(f"{p}_{c}") for c in entry])


def join_ioc_ip(df: DataFrame, bad_ips: DataFrame, *, whitelist=tuple(V.TI_WHITELISTED_IPS)) -> DataFrame:
    """Append dst_hit and src_hit."""
    good = bad_ips.filter(~F.col("ip").isin(list(whitelist)))
    d = df.join(_ioc(good, "ip", "dst_ip", "_d"), "dst_ip", "left").join(_ioc(good, "ip", "src_ip", "_s"), "src_ip", "left")
    return d.select(*df.columns, F.when(F.col("_d_severity").isNotNull(), _hit("ip", F.col("dst_ip"), "_d")).alias("dst_hit"),
                    F.when(F.col("_s_severity").isNotNull(), _hit("ip", F.col("src_ip"), "_s", "src")).alias("src_hit"))


def join_ioc_ja3(df: DataFrame, bad_ja3: DataFrame) -> DataFrame:
    """Append ja3_hit."""
    d = df.join(_ioc(bad_ja3, "ja3", "ja3", "_j"), "ja3", "left")
    return d.select(*df.columns, F.when(F.col("_j_severity").isNotNull() & (F.col("ja3") != ""),
                                        _hit("ja3", F.col("ja3"), "_j")).alias("ja3_hit"))


def allow_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """One row per allowed domain with its first layer (override, exclusion, learned, popular)."""
    parts = [t.select(F.lower("domain").alias("domain"), F.lit(V.ALLOW_LAYERS.index(n)).alias("prio"), F.lit(n).alias("layer"))
             for n, t in layers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("domain").agg(F.min_by("layer", "prio").alias("layer"))


def domain_verdicts(names: DataFrame, bad: DataFrame, allowed: DataFrame) -> DataFrame:
    """Verdict per distinct name: walking up its parents, an allowed level stops without a
    match and a bad level stops with one; allowed wins on the same level."""
    steps = names.select("domain", F.posexplode(L.domain_suffixes("domain")).alias("level", "suffix"))
    listed = (allowed.select(F.col("domain").alias("suffix"), F.lit(0).alias("rank"), "layer",
                             *[F.lit(None).cast("string").alias(c) for c in ("category", "severity", "feed")])
              .unionByName(bad.select(F.col("domain").alias("suffix"), F.lit(1).alias("rank"), F.lit(None).cast("string").alias("layer"),
                                      "category", "severity", "feed")))
    v = F.struct("suffix", "rank", "layer", "category", "severity", "feed")
    return (steps.join(listed, "suffix").groupBy("domain").agg(F.min_by(v, F.struct("level", "rank")).alias("v"))
            .select("domain", "v.*"))


def domain_names(df: DataFrame, *, name: str = "sni") -> DataFrame:
    """Distinct names in lower case (domain)."""
    return df.select(F.lower(name).alias("domain")).filter(F.col("domain") != "").distinct()


def join_ioc_domain(df: DataFrame, bad: DataFrame, allowed: DataFrame, *, name: str = "sni", verdicts: DataFrame | None = None) -> DataFrame:
    """Append domain_hit and allow_layer; the walk runs once per distinct name. verdicts: those of all names, where they are at hand."""
    d = df.withColumn("_dn", F.lower(F.coalesce(F.col(name), F.lit(""))))
    v = domain_verdicts(domain_names(df, name=name), bad, allowed) if verdicts is None else verdicts
    v = v.select(F.col("domain").alias("_dn"), F.col("suffix").alias("_suffix"),
                                                    F.col("layer").alias("allow_layer"), *[F.col(c).alias(f"_m_{c}") for c in ("category", "severity", "feed")])
    j = d.join(v, "_dn", "left")
    return j.select(*df.columns, "allow_layer", F.when(F.col("_m_severity").isNotNull(), _hit("domain", F.col("_suffix"), "_m")).alias("domain_hit"))


def allowlist_suppressions(df: DataFrame, bad: DataFrame, allowed: DataFrame, *, name: str = "sni") -> DataFrame:
    """Lookups stopped by each allow layer."""
    return join_ioc_domain(df, bad, allowed, name=name).filter(F.col("allow_layer").isNotNull()).groupBy(
        F.col("allow_layer").alias("layer")).agg(F.count(F.lit(1)).alias("suppressed"))


def ioc_flow_hits(df: DataFrame, *, bad_ips: DataFrame, bad_ja3: DataFrame, bad_domains: DataFrame, allowed: DataFrame,
                  name: str = "sni", verdicts: DataFrame | None = None) -> DataFrame:
    """Append threat_hits (dst, src, ja3, domain order) and best_hit (highest severity, first wins)."""
    d = (df.transform(join_ioc_ip, bad_ips).transform(join_ioc_ja3, bad_ja3)
         .transform(join_ioc_domain, bad_domains, allowed, name=name, verdicts=verdicts))
    hits = F.filter(F.array("dst_hit", "src_hit", "ja3_hit", "domain_hit"), lambda h: h.isNotNull())
    d = d.withColumn("threat_hits", hits)
    best = F.aggregate("threat_hits", F.lit(None).cast(HIT), lambda a, h: F.when(
        a.isNull() | (severity_rank(h["severity"]) > severity_rank(a["severity"])), h).otherwise(a))
    return d.withColumn("best_hit", best).drop("dst_hit", "src_hit", "ja3_hit", "domain_hit", "allow_layer")


def join_ja3_builtin(df: DataFrame, bad_ja3: DataFrame, *, ja3: str = "ja3", prefix: str = "ja3") -> DataFrame:
    """Append <prefix>_name, <prefix>_severity: browsers exempt, IOC table first, built-in list second."""
    best = F.min_by(F.struct("name", "severity"), F.struct(-severity_rank("severity"), "name"))
    t = bad_ja3.groupBy(F.col("ja3").alias(ja3)).agg(best.alias("_e")).select(ja3, F.col("_e.name").alias("_bn"), F.col("_e.severity").alias("_bs"))
    d = df.join(t, ja3, "left")
    builtin = lookup(ja3, V.JA3_SUSPECT)
    exempt = (F.coalesce(F.col(ja3), F.lit("")) == "") | F.col(ja3).isin(list(V.JA3_BROWSERS))
    return d.withColumns({
        f"{prefix}_name": F.when(~exempt, F.coalesce("_bn", builtin)),
        f"{prefix}_severity": F.when(~exempt, F.coalesce("_bs", F.when(builtin.isNotNull(), "HIGH")))}).drop("_bn", "_bs")


# ── alerts ───────────────────────────────────────────────────────────────────
def join_suppression(alerts: DataFrame, suppressions: DataFrame, *, t="t_us") -> DataFrame:
    """Drop alerts whose (src_ip, attack_type) is suppressed at that time."""
    s = suppressions.groupBy("src_ip", "attack_type").agg(F.max("expires_us").alias("_exp"))
    d = alerts.join(s, ["src_ip", "attack_type"], "left")
    return d.filter(F.col("_exp").isNull() | (F.col("_exp") <= F.col(t))).select(*alerts.columns)


def _prefix(c: str) -> Column:
    return F.rtrim(F.coalesce(F.col(c), F.lit("")), F.lit("*"))


def match_fp_pattern(alerts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Append fp_action: 'suppress', 'downgrade' or null.

    The first pattern (by id) with confidence >= 0.5 that fits decides; an empty field fits
    anything. Patterns of one shape (which fields are set, how many labels the address
    prefixes have) match by equality, so there is one equality join per distinct shape.
    """
    p = patterns.filter(F.col("confidence") >= 0.5).select(
        F.coalesce("attack_type", F.lit("")).alias("_a"), _prefix("src_pattern").alias("_s"), _prefix("dst_pattern").alias("_d"),
        F.coalesce("dst_port", F.lit(0)).cast("long").alias("_p"),
        F.struct("id", F.when(F.col("confidence") >= 0.8, "suppress").otherwise("downgrade").alias("act")).alias("_r"))
    # a prefix that ends at a dot is cut by its number of labels, any other by its length
    dots = lambda c: F.when((F.col(c) == "") | F.col(c).endswith("."), F.length(F.regexp_replace(c, "[^.]", ""))).otherwise(-1)
    size = lambda c: F.when(dots(c) < 0, F.length(c)).otherwise(0)
    p = p.withColumn("_shape", F.struct((F.col("_a") != "").alias("a"), dots("_s").alias("sd"), size("_s").alias("sl"),
                                        dots("_d").alias("dd"), size("_d").alias("dl"), (F.col("_p") != 0).alias("p")))

    def head(ip, n, length):
        if n == 0:
            return F.lit("")
        key = F.concat(F.substring_index(ip, ".", n), F.lit(".")) if n > 0 else F.substring(ip, 1, length)
        return F.when(F.startswith(F.col(ip), key), key)

    # field sets and label counts: at most 64 combinations for dotted prefixes, usually about four
    shapes = [r[0] for r in p.select("_shape").distinct().collect()]
    out, found = alerts, []
    for i, s in enumerate(shapes):
        same = F.lit(True)
        for f in ("a", "sd", "sl", "dd", "dl", "p"):
            same = same & (F.col(f"_shape.{f}") == s[f])
        side = p.filter(same).groupBy("_a", "_s", "_d", "_p").agg(F.min("_r").alias(f"_r{i}"))
        keys = {"_a": F.col("attack_type") if s["a"] else F.lit(""), "_s": head("src_ip", s["sd"], s["sl"]), "_d": head("dst_ip", s["dd"], s["dl"]),
                "_p": F.col("dst_port").cast("long") if s["p"] else F.lit(0).cast("long")}
        out = out.withColumns(keys).join(side, list(keys), "left").drop(*keys)
        found.append(F.col(f"_r{i}"))
    act = F.array_min(F.array(*found))["act"] if found else F.lit(None).cast("string")
    return out.select(*alerts.columns, act.alias("fp_action"))


def join_fp_pattern(alerts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Drop suppressed alerts; set downgraded ones to LOW and 'Other', with a note."""
    d = match_fp_pattern(alerts, patterns).filter(F.coalesce("fp_action", F.lit("")) != "suppress")
    down = F.coalesce(F.col("fp_action") == "downgrade", F.lit(False))
    cols = {"severity": F.when(down, "LOW").otherwise(F.col("severity")),
            "attack_type": F.when(down, "Other").otherwise(F.col("attack_type"))}
    if "reasons" in alerts.columns:
        note = F.concat(F.lit("[fine-tuning suppression] downgraded from "), F.col("attack_type"))
        cols["reasons"] = F.when(down, F.concat("reasons", F.array(note))).otherwise(F.col("reasons"))
    return d.withColumns(cols).drop("fp_action")


def join_triage(alerts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Alerts with a TP or FP verdict."""
    v = verdicts.filter(F.col("verdict").isin("TP", "FP")).select(F.col("alert_id").alias("id"), "verdict")
    return alerts.drop("verdict").join(v, "id")


def join_device_enrich(devices: DataFrame, alerts: DataFrame, known: DataFrame) -> DataFrame:
    """Device classes with alert counts and known-device facts; risk from alerts and flows."""
    per = alerts.groupBy(F.col("src_ip").alias("ip")).agg(F.count(F.lit(1)).alias("alert_count"), F.max(severity_rank("severity")).alias("_rk"))
    k = known.select("ip", "hostname", F.col("vendor").alias("_kv"), F.col("os").alias("_ko"), F.col("device_type").alias("_kt"), "department", "priority")
    d = devices.join(per, "ip", "left").join(k, "ip", "left")
    ne = lambda c: F.nullif(F.col(c), F.lit(""))
    vendor, os_ = F.coalesce(ne("_kv"), F.col("vendor"), F.lit("")), F.coalesce(ne("_ko"), F.col("os_hint"), F.lit(""))
    n = F.coalesce("alert_count", F.lit(0))
    return d.select(
        "ip", F.coalesce("hostname", F.lit("")).alias("hostname"), vendor.alias("vendor"), os_.alias("os"),
        F.concat_ws(" / ", F.nullif(vendor, F.lit("")), F.nullif(os_, F.lit(""))).alias("vendor_os"),
        F.coalesce(ne("_kt"), F.when(F.col("device_class") != "unknown", F.col("device_class")), F.lit("")).alias("device_type"),
        "device_class", F.coalesce("department", F.lit("")).alias("department"), F.coalesce("priority", F.lit("medium")).alias("priority"),
        "confidence", "flow_count", n.alias("alert_count"),
        F.element_at(F.array(*[F.lit(s) for s in V.SEVERITY_BY_RANK]), F.coalesce("_rk", F.lit(0)) + 1).alias("max_severity"),
        F.round(n * 10.0 + F.col("flow_count") * 0.01, 4).alias("risk_score"))


def tactic_ids(attack: Column | str) -> Column:
    """Tactic ids of an attack type: exact entry, else the first map entry where either text
    contains the other, else an empty array."""
    c = F.col(attack) if isinstance(attack, str) else attack
    entries = [F.struct(F.lit(k).alias("k"), F.array(*[F.lit(t) for t in ts]).alias("t")) for k, ts in V.ATTACK_TACTICS.items()]
    table = F.array(*entries)
    exact = F.get(F.filter(table, lambda e: e["k"] == c), F.lit(0))["t"]
    near = F.get(F.filter(table, lambda e: c.contains(e["k"]) | F.contains(e["k"], c)), F.lit(0))["t"]
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.coalesce(exact, near, F.array().cast("array<string>")))


def join_mitre(df: DataFrame, *, attack: str = "attack_type") -> DataFrame:
    """One row per alert and tactic; the map is looked up per row, so nothing shuffles."""
    names = lookup("tactic_id", dict(V.TACTICS))
    return df.withColumn("tactic_id", F.explode(tactic_ids(attack))).withColumn("tactic", names)


def family_tactic(c) -> Column:
    return lookup(c, V.FAMILY_TACTIC, "Unclassified")


def join_family_tactic(df: DataFrame, *, attack: str = "attack_type") -> DataFrame:
    return df.withColumn("mitre_tactic", F.coalesce(family_tactic(attack), F.lit("Unclassified")))


def oui_prefix(mac) -> Column:
    """First six hex digits of a hardware address, null if it is shorter."""
    c = F.col(mac) if isinstance(mac, str) else mac
    clean = F.upper(F.regexp_replace(c, "[:.-]", ""))
    return F.when(F.length(clean) >= 6, F.substring(clean, 1, 6))


def oui_vendor(mac) -> Column:
    return lookup(oui_prefix(mac), V.OUI_VENDOR)


def vendor_class(vendor) -> Column:
    return lookup(vendor, V.VENDOR_CLASS)


def join_oui(df: DataFrame, *, mac: str = "mac") -> DataFrame:
    """Append vendor and class_hint of a hardware address."""
    return df.withColumn("vendor", oui_vendor(mac)).withColumn("class_hint", vendor_class("vendor"))


def join_policy_ports(df: DataFrame, *, tor_exits: DataFrame | None = None) -> DataFrame:
    """Append anonymizers: ARRAY(STRUCT(category, severity)) in rule order, then fingerprint
    and exit-list hits. Port rules do not apply to private destinations."""
    private = IP.is_private("dst_ip")
    by_port = [F.when(F.col("dst_port").isin(ports) & ~F.col("_priv"),
                      F.struct(F.lit(n).alias("category"), F.lit(s).alias("severity"))) for n, s, ports in V.ANONYMIZERS]
    tor = F.struct(F.lit("tor").alias("category"), F.lit("HIGH").alias("severity"))
    hits = [*by_port, F.when(F.col("ja3").isin(V.JA3_TOR), tor)]
    d = df.withColumn("_priv", private)
    if tor_exits is not None:
        d = d.join(tor_exits.select(F.col("ip").alias("dst_ip"), F.lit(True).alias("_exit")).distinct(), "dst_ip", "left")
        hits.append(F.when(F.col("_exit"), tor))
    return d.withColumn("anonymizers", F.filter(F.array(*hits), lambda h: h.isNotNull())).drop("_priv", "_exit")


def anti_already_promoted(candidates: DataFrame, learned: DataFrame) -> DataFrame:
    return candidates.join(learned.select("domain"), "domain", "left_anti")
