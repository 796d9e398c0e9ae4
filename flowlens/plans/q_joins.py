"""Queries: filters and enrichment joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens import values as V
from flowlens.functions import tls as L
from flowlens.operators import filters as Fl, joins as J
from flowlens.plans.flowview import START_US, alerts, flows, tls_flows, with_views
from flowlens.plans.q_features import _RK, addr, AX, ADDR_N, casemap, inlist, rng, _scope
from flowlens.plans.q_windows import DEPT_SQL
from flowlens.plans.registry import query, sql_round

# ── reference tables derived from the flows, one text for both engines ───────
BAD_IPS = """SELECT DISTINCT dst_ip AS ip, CASE dst_port WHEN 4444 THEN 'botnet_c2' WHEN 9001 THEN 'anonymizer' WHEN 22 THEN 'compromised' ELSE 'scanner' END AS category,
 CASE dst_port WHEN 4444 THEN 'CRITICAL' WHEN 9001 THEN 'MEDIUM' WHEN 22 THEN 'HIGH' ELSE 'LOW' END AS severity, 'feed_a' AS feed FROM flows WHERE dst_port IN (4444, 9001, 22, 23) AND dst_ip LIKE '93.%'"""
BAD_DOM = """SELECT DISTINCT CASE sni WHEN 'a.b.bad-c2.example' THEN 'bad-c2.example' WHEN 'sub.evil.test' THEN 'evil.test' WHEN 'drive.google.com' THEN 'drive.google.com' ELSE 'shop.example' END AS domain,
 'malware_distribution' AS category, CASE sni WHEN 'a.b.bad-c2.example' THEN 'CRITICAL' WHEN 'sub.evil.test' THEN 'MEDIUM' ELSE 'HIGH' END AS severity, 'feed_d' AS feed
 FROM flows WHERE sni IN ('a.b.bad-c2.example', 'sub.evil.test', 'drive.google.com', 'cdn.shop.example')"""
BAD_JA3 = """SELECT DISTINCT ja3, CASE ja3 WHEN '0123456789abcdef0123456789abcdef' THEN 'TestRAT' ELSE 'Listed' END AS name, 'malware_tls' AS category,
 CASE ja3 WHEN '0123456789abcdef0123456789abcdef' THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity, 'feed_j' AS feed FROM flows
 WHERE ja3 IN ('0123456789abcdef0123456789abcdef', 'b32309a26951912be7dba376398abc3b', '51c64c77e60f3980eea90869b68c58a8')"""
DIMS = {"bad_ips": BAD_IPS, "bad_dom": BAD_DOM, "bad_ja3": BAD_JA3, "addr": AX["addr"], "addrn": ADDR_N}
# learned domain: cdn.shop.example is allowed before its bad parent is reached
ALLOW = [("google.com", "override"), ("cdn.shop.example", "L3-learned"), ("portal.gov.in", "L1-popular"), ("portal.gov.in", "L4-exclusion")]


def dim(spark, sf, text, f=None):
    f = flows(spark, sf) if f is None else f
    return spark.sql(text.replace("FROM flows", "FROM {f}"), f=f)


def allowed(spark):
    tabs = {n: J.frame(spark, [(d,) for d, m in ALLOW if m == n], "domain string") for n in V.ALLOW_LAYERS}
    return J.allow_layers(tabs)


def vw(sql, **kw):
    return with_views(sql, extra={**DIMS, **kw.pop("extra", {})}, **kw)


# ── filters ──────────────────────────────────────────────────────────────────
query("flt_min_severity", vw(f"SELECT id, severity FROM alerts WHERE {_RK} >= 2"))(
    lambda spark, sf: alerts(spark, sf).transform(Fl.flt_min_severity, floor="MEDIUM").select("id", "severity"))
query("flt_ml_threshold", vw("SELECT id FROM alerts WHERE ml_score >= 0.7"))(
    lambda spark, sf: alerts(spark, sf).transform(Fl.flt_ml_threshold, threshold=0.7).select("id"))


@query("flt_whitelist", vw("SELECT flow_id FROM flows WHERE NOT (dst_port IN (53, 123)) AND NOT (dst_port = 443 AND dst_ip IN (SELECT ip FROM wl)) AND src_ip NOT IN (SELECT DISTINCT src_ip FROM flows WHERE src_ip LIKE '192.168.60.%')",
                           extra={"wl": "SELECT DISTINCT dst_ip AS ip FROM flows WHERE dst_port = 443 AND dst_ip LIKE '93.184.1.%'"}))
def _(spark, sf):
    f = flows(spark, sf)
    pairs = f.filter("dst_port = 443 AND dst_ip LIKE '93.184.1.%'").select("dst_ip", "dst_port")
    srcs = f.filter("src_ip LIKE '192.168.60.%'").select("src_ip")
    return f.transform(Fl.flt_whitelist, pairs=pairs, ports=[53, 123], sources=srcs).select("flow_id")


@query("flt_runtime_whitelist", vw("SELECT flow_id FROM flows WHERE src_ip NOT IN (SELECT ip FROM bl) AND dst_ip NOT IN (SELECT ip FROM bl)",
                                   extra={"bl": "SELECT DISTINCT src_ip AS ip FROM flows WHERE src_ip LIKE '192.168.1.%'"}))
def _(spark, sf):
    f = flows(spark, sf)
    listed = f.filter("src_ip LIKE '192.168.1.%'").select(F.col("src_ip").alias("ip")).distinct()
    return f.transform(Fl.flt_runtime_whitelist, listed=listed).select("flow_id")


query("flt_time_range", vw("SELECT id FROM alerts WHERE ts >= TIMESTAMP '2024-01-01 00:02:00' AND ts < TIMESTAMP '2024-01-01 00:06:00' AND severity = 'HIGH'"))(
    lambda spark, sf: alerts(spark, sf).transform(Fl.flt_time_range, start="2024-01-01 00:02:00", end="2024-01-01 00:06:00", severity="high").select("id"))
query("flt_lookback_from_max", vw("SELECT id FROM alerts WHERE ts > (SELECT max(ts) FROM alerts) - INTERVAL 48 HOURS", compress=1))(
    lambda spark, sf: alerts(spark, sf, 1).transform(Fl.flt_lookback_from_max, hours=48).select("id"))


def known_devices(spark, sf):
    return dim(spark, sf, KNOWN)


KNOWN = """SELECT DISTINCT src_ip AS ip, concat('host-', replace(src_ip, '.', '-')) AS hostname, CASE WHEN src_ip LIKE '%1' THEN 'printer' WHEN src_ip LIKE '%2' THEN 'workstation' WHEN src_ip LIKE '%3' THEN 'ip_camera' ELSE '' END AS device_type,
 CASE WHEN src_ip LIKE '192.168.20.%' THEN 'Finance' ELSE 'IT' END AS department, 'ops' AS owner, 'high' AS priority, true AS trusted,
 CASE WHEN src_ip LIKE '%4' THEN 'Dell' ELSE '' END AS vendor, CASE WHEN src_ip LIKE '%5' THEN 'Linux' ELSE '' END AS os FROM flows WHERE src_ip NOT LIKE '%7' AND src_ip NOT LIKE '%8'"""
DIMS["known"] = KNOWN


@query("flt_search", vw("""SELECT * FROM (SELECT 'device' AS type, CAST(NULL AS BIGINT) AS id, ip AS src_ip, '' AS attack_type, '' AS severity FROM (SELECT ip FROM known WHERE contains(lower(ip), '30.1') OR contains(lower(hostname), '30.1') OR contains(lower(department), '30.1') ORDER BY ip LIMIT 20)
 UNION ALL SELECT 'alert', id, src_ip, attack_type, severity FROM (SELECT * FROM alerts WHERE contains(src_ip, '30.1') OR contains(lower(attack_type), '30.1') ORDER BY id DESC LIMIT 20)) ORDER BY type DESC, id DESC, src_ip LIMIT 20"""))
def _(spark, sf):
    return Fl.flt_search(alerts(spark, sf), known_devices(spark, sf), q="30.1")


# ── logs ─────────────────────────────────────────────────────────────────────
@query("join_conn_ssl", vw("""SELECT flow_id, CASE WHEN dst_port = 443 THEN tls_version END AS tls_version, CASE WHEN dst_port = 443 THEN ja3s END AS ja3s,
 CAST(dst_port = 443 AND cert_self_signed AS INT) AS self_signed, CAST(dst_port = 443 AND cert_expired AS INT) AS expired FROM tls"""))
def _(spark, sf):
    t = tls_flows(spark, sf).withColumn("uid", F.concat(F.lit("C"), "flow_id"))
    conn = t.select("uid", "flow_id", "src_ip", "dst_ip", "t_us")
    ssl = t.filter("dst_port = 443").select("uid", "ja3s", "tls_version", "cert_subject", "cert_issuer", "validation_status")
    return J.join_conn_ssl(conn, ssl).select("flow_id", "tls_version", "ja3s", F.col("cert_self_signed").cast("int").alias("self_signed"), F.col("cert_expired").cast("int").alias("expired"))


DNS = "SELECT t_us - 1000000 AS t_us, sni AS query, dst_ip AS answers FROM flows WHERE dst_port = 443 AND flow_id % 2 = 0 AND sni <> ''"
DIMS["dns"] = DNS
DNS_SQL = """SELECT flow_id, coalesce(q, nullif(sni, '')) AS dns_query, q AS dns_resolved FROM (SELECT f.flow_id, f.sni, (SELECT max_by(d.query, struct_pack(t := d.t_us, q := d.query)) FROM dns d WHERE d.answers = f.dst_ip AND d.t_us <= f.t_us) AS q FROM flows f)"""


@query("join_dns_asof", vw(DNS_SQL))
def _(spark, sf):
    f = flows(spark, sf)
    return J.join_dns_asof(f, dim(spark, sf, DNS), bucket_us=60_000_000).select("flow_id", "dns_query", "dns_resolved")


# ── networks ─────────────────────────────────────────────────────────────────
@query("join_cidr_scope", vw(f"""SELECT flow_id, ip, CASE WHEN {rng('10.0.0.0/8', '172.16.0.0/12', '192.168.0.0/16', '203.0.113.0/25')} THEN 'internal' WHEN n IS NOT NULL OR ip LIKE '%:%' THEN 'external' ELSE 'invalid' END AS scope FROM addrn"""))
def _(spark, sf):
    nets = J.frame(spark, [("10.0.0.0/8",), ("172.16.0.0/12",), ("192.168.0.0/16",), ("203.0.113.0/25",)], "cidr string")
    return J.join_cidr_scope(addr(spark, sf), nets, ip="ip")


query("join_subnet_dept", vw(f"SELECT flow_id, {DEPT_SQL} AS department FROM flows"))(
    lambda spark, sf: J.join_subnet_dept(flows(spark, sf)).select("flow_id", "department"))
_VL = "CASE string_split(src_ip, '.')[3] " + " ".join(f"WHEN '{v[3].split('.')[2]}' THEN '{{}}{v[0]}'" for v in V.VLANS) + " ELSE '{}99' END"
_VD = "CASE string_split(src_ip, '.')[3] " + " ".join(f"WHEN '{v[3].split('.')[2]}' THEN '{v[1]}'" for v in V.VLANS) + " ELSE 'Unmapped' END"
_VP = "CASE string_split(src_ip, '.')[3] " + " ".join(f"WHEN '{v[3].split('.')[2]}' THEN '{v[2]}'" for v in V.VLANS) + " ELSE 'high' END"
query("join_vlan_first", vw(f"SELECT flow_id, {_VL.replace('{}', '')} AS vlan, {_VD} AS department, {_VP} AS priority FROM flows"))(
    lambda spark, sf: J.join_vlan_first(flows(spark, sf)).select("flow_id", "vlan", "department", "priority"))


_SENS = {k: v[0] for k, v in V.DEPARTMENT_SENSITIVITY.items()}
_DCLS = {k: v[1] for k, v in V.DEPARTMENT_SENSITIVITY.items()}
IDENT = {"ident": f"""SELECT flow_id, t_us, src_ip, dst_ip, dst_port, fwd_bytes, ja3, sni, coalesce(k.hostname, '') AS hostname, coalesce(CASE WHEN k.ip IS NOT NULL THEN k.device_type END, 'unknown') AS device_type,
 coalesce(k.department, {DEPT_SQL}) AS department, coalesce(k.owner, '') AS owner, coalesce(k.priority, 'medium') AS priority, coalesce(k.trusted, false) AS trusted FROM flows LEFT JOIN known k ON k.ip = flows.src_ip"""}


def identified(spark, sf):
    return J.join_identity(flows(spark, sf), known_devices(spark, sf))


@query("join_identity", vw(f"""SELECT flow_id, hostname, device_type, department, owner, priority, CAST(trusted AS INT) AS trusted, {casemap('department', _SENS, "'medium'")} AS sensitivity,
 {casemap('department', _DCLS, "'internal'")} AS data_class, CAST(department IN ('Infrastructure','Finance','IT','IoT','Unknown') AS INT) AS escalate FROM ident""", extra=IDENT))
def _(spark, sf):
    return identified(spark, sf).select("flow_id", "hostname", "device_type", "department", "owner", "priority", F.col("trusted").cast("int"),
                                        "sensitivity", "data_class", F.col("alert_escalation").cast("int").alias("escalate"))


# ── threat intelligence ──────────────────────────────────────────────────────
@query("join_ioc_ip", vw("SELECT flow_id, d.category AS dst_category, d.severity AS dst_severity, s.severity AS src_severity FROM flows f LEFT JOIN bad_ips d ON d.ip = f.dst_ip LEFT JOIN bad_ips s ON s.ip = f.src_ip"))
def _(spark, sf):
    d = flows(spark, sf).transform(J.join_ioc_ip, dim(spark, sf, BAD_IPS))
    return d.select("flow_id", F.col("dst_hit.category").alias("dst_category"), F.col("dst_hit.severity").alias("dst_severity"), F.col("src_hit.severity").alias("src_severity"))


@query("join_ioc_ja3", vw("SELECT flow_id, b.severity AS ja3_severity FROM flows f LEFT JOIN bad_ja3 b ON b.ja3 = f.ja3 AND f.ja3 <> ''"))
def _(spark, sf):
    return flows(spark, sf).transform(J.join_ioc_ja3, dim(spark, sf, BAD_JA3)).select("flow_id", F.col("ja3_hit.severity").alias("ja3_severity"))


_DV = "CASE sni WHEN 'a.b.bad-c2.example' THEN 'bad-c2.example' WHEN 'sub.evil.test' THEN 'evil.test' WHEN 'drive.google.com' THEN 'drive.google.com' END"
_DS = "CASE sni WHEN 'a.b.bad-c2.example' THEN 'CRITICAL' WHEN 'sub.evil.test' THEN 'MEDIUM' WHEN 'drive.google.com' THEN 'HIGH' END"
# recursive walk from the name to its parents, written without knowledge of the answer
WALK = {"allow": "SELECT * FROM (VALUES ('google.com', 'override', 0), ('cdn.shop.example', 'L3-learned', 2), ('portal.gov.in', 'L4-exclusion', 1)) t(domain, layer, p)",
        "sfx": "SELECT DISTINCT sni, i, array_to_string(string_split(sni, '.')[i:], '.') AS s FROM flows, range(1, 8) r(i) WHERE sni <> '' AND i <= len(string_split(sni, '.'))",
        "stop": "SELECT sni, i, s, layer, b.severity AS sev FROM sfx LEFT JOIN allow a ON a.domain = s LEFT JOIN bad_dom b ON b.domain = s WHERE a.domain IS NOT NULL OR b.domain IS NOT NULL",
        "verd": "SELECT sni, CASE WHEN layer IS NULL THEN s END AS value, CASE WHEN layer IS NULL THEN sev END AS severity, layer FROM (SELECT *, row_number() OVER (PARTITION BY sni ORDER BY i) AS r FROM stop) WHERE r = 1"}


@query("join_ioc_domain", vw("SELECT flow_id, v.value AS domain_value, v.severity AS domain_severity, v.layer AS allow_layer FROM flows LEFT JOIN verd v ON v.sni = flows.sni", extra=WALK))
def _(spark, sf):
    d = flows(spark, sf).transform(J.join_ioc_domain, dim(spark, sf, BAD_DOM), allowed(spark))
    return d.select("flow_id", F.col("domain_hit.value").alias("domain_value"), F.col("domain_hit.severity").alias("domain_severity"), "allow_layer")


@query("join_allowlist_layers", vw("SELECT layer, count(*) AS suppressed FROM flows JOIN verd v ON v.sni = flows.sni WHERE layer IS NOT NULL GROUP BY layer", extra=WALK))
def _(spark, sf):
    return J.allowlist_suppressions(flows(spark, sf), dim(spark, sf, BAD_DOM), allowed(spark))


_rk = lambda c: f"coalesce({casemap(c, V.SEVERITY_RANK, 0)}, 0)"
HITS = {**WALK, "hits": f"""SELECT *, CASE WHEN m > 0 THEN CASE WHEN {_rk('ds')} = m THEN 'ip' WHEN {_rk('js')} = m THEN 'ja3' ELSE 'domain' END END AS best_type,
 CASE m WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' END AS best_severity FROM (SELECT *, greatest({_rk('ds')}, {_rk('js')}, {_rk('ms')}) AS m FROM
 (SELECT f.*, b.severity AS ds, b.category AS dc, j.severity AS js, j.category AS jc, v.severity AS ms FROM flows f LEFT JOIN bad_ips b ON b.ip = f.dst_ip LEFT JOIN bad_ja3 j ON j.ja3 = f.ja3 AND f.ja3 <> '' LEFT JOIN verd v ON v.sni = f.sni))"""}


def with_hits(df, spark, sf):
    return J.ioc_flow_hits(df, bad_ips=dim(spark, sf, BAD_IPS), bad_ja3=dim(spark, sf, BAD_JA3).filter("ja3 <> ''"), bad_domains=dim(spark, sf, BAD_DOM), allowed=allowed(spark))


@query("ioc_flow_hits", vw("SELECT flow_id, CAST(ds IS NOT NULL AS INT) + CAST(js IS NOT NULL AS INT) + CAST(ms IS NOT NULL AS INT) AS n_hits, best_type, best_severity FROM hits", extra=HITS))
def _(spark, sf):
    d = with_hits(flows(spark, sf), spark, sf)
    return d.select("flow_id", F.size("threat_hits").alias("n_hits"), F.col("best_hit.type").alias("best_type"), F.col("best_hit.severity").alias("best_severity"))


JB = f"""CASE WHEN f.ja3 = '' OR f.ja3 IN {inlist(V.JA3_BROWSERS)} THEN NULL ELSE coalesce(b.{{}}, {{}}) END"""
_bn = casemap("f.ja3", V.JA3_SUSPECT, "NULL")


@query("join_ja3_builtin", vw(f"SELECT flow_id, {JB.format('name', _bn)} AS ja3_name, {JB.format('severity', f'CASE WHEN {_bn} IS NOT NULL THEN ' + chr(39) + 'HIGH' + chr(39) + ' END')} AS ja3_severity FROM flows f LEFT JOIN bad_ja3 b ON b.ja3 = f.ja3"))
def _(spark, sf):
    return flows(spark, sf).transform(J.join_ja3_builtin, dim(spark, sf, BAD_JA3)).select("flow_id", "ja3_name", "ja3_severity")


# ── alerts ───────────────────────────────────────────────────────────────────
SUPP = "SELECT src_ip, family AS attack_type, max(t_us) + 30000000 AS expires_us FROM flows WHERE flow_id % 17 = 0 GROUP BY src_ip, family"
DIMS["supp"] = SUPP


@query("join_suppression", vw("SELECT id FROM alerts a WHERE NOT EXISTS (SELECT 1 FROM supp s WHERE s.src_ip = a.src_ip AND s.attack_type = a.attack_type AND s.expires_us > a.t_us)"))
def _(spark, sf):
    return alerts(spark, sf).transform(J.join_suppression, dim(spark, sf, SUPP)).select("id")


PATS = [(1, "Mirai", "192.168.10.*", "", 443, 0.9), (2, "", "", "93.184.*", 23, 0.6), (3, "Recon", "", "", 0, 0.49), (4, "Recon", "192.168.20.*", "", 0, 0.5),
        (5, "Mirai", "192.168.*", "", 443, 0.55), (6, "Neris", "", "192.168.1.*", 0, 0.8)]
PAT_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{s}', '{d}', {p}, {c})" for i, a, s, d, p, c in PATS) + ") t(pid, pa, ps, pd, pp, conf)"
FPX = {"pats": PAT_SQL, "fpm": """SELECT a.id, min_by(CASE WHEN conf >= 0.8 THEN 'suppress' ELSE 'downgrade' END, pid) AS act FROM alerts a JOIN pats ON conf >= 0.5 AND (pa = '' OR pa = attack_type) AND (pp = 0 OR pp = dst_port)
 AND starts_with(src_ip, rtrim(ps, '*')) AND starts_with(dst_ip, rtrim(pd, '*')) GROUP BY a.id"""}


@query("join_fp_pattern", vw("SELECT a.id, CASE WHEN act = 'downgrade' THEN 'LOW' ELSE severity END AS severity, CASE WHEN act = 'downgrade' THEN 'Other' ELSE attack_type END AS attack_type FROM alerts a LEFT JOIN fpm USING (id) WHERE act IS DISTINCT FROM 'suppress'", extra=FPX))
def _(spark, sf):
    pats = J.frame(spark, PATS, "id int, attack_type string, src_pattern string, dst_pattern string, dst_port int, confidence double")
    return alerts(spark, sf).transform(J.join_fp_pattern, pats).select("id", "severity", "attack_type")


def triage(spark, sf):
    return flows(spark, sf).filter("verdict IS NOT NULL").select(F.col("flow_id").alias("alert_id"), "verdict")


query("join_triage", vw("SELECT id, attack_type, verdict FROM alerts WHERE verdict IN ('TP', 'FP')"))(
    lambda spark, sf: alerts(spark, sf).transform(J.join_triage, triage(spark, sf)).select("id", "attack_type", "verdict"))

DEV = """SELECT src_ip AS ip, CASE WHEN max(dst_port) > 9000 THEN 'laptop' ELSE 'unknown' END AS device_class, CASE WHEN src_ip LIKE '%6' THEN 'HP' END AS vendor, CAST(NULL AS STRING) AS os_hint,
 CAST(0.5 AS DOUBLE) AS confidence, count(*) AS flow_count FROM flows GROUP BY src_ip"""
DIMS["dev"] = DEV
ENRICH = f"""SELECT dev.ip, coalesce(k.hostname, '') AS hostname, coalesce(nullif(k.vendor, ''), dev.vendor, '') AS vendor, coalesce(nullif(k.os, ''), dev.os_hint, '') AS os,
 concat_ws(' / ', nullif(coalesce(nullif(k.vendor, ''), dev.vendor, ''), ''), nullif(coalesce(nullif(k.os, ''), dev.os_hint, ''), '')) AS vendor_os,
 coalesce(nullif(k.device_type, ''), nullif(device_class, 'unknown'), '') AS device_type, device_class, coalesce(k.department, '') AS department, coalesce(k.priority, 'medium') AS priority, dev.confidence, flow_count,
 coalesce(n, 0) AS alert_count, ['BENIGN','LOW','MEDIUM','HIGH','CRITICAL'][coalesce(mx, 0) + 1] AS max_severity, round(CAST(coalesce(n, 0) * 10.0 + flow_count * 0.01 AS DOUBLE), 6) + 0.0 AS risk_score
 FROM dev LEFT JOIN (SELECT src_ip AS ip, count(*) AS n, max({_RK}) AS mx FROM alerts GROUP BY 1) ac ON ac.ip = dev.ip LEFT JOIN known k ON k.ip = dev.ip"""


def enriched(spark, sf):
    return J.join_device_enrich(dim(spark, sf, DEV), alerts(spark, sf), known_devices(spark, sf))


query("join_device_enrich", vw(ENRICH))(lambda spark, sf: enriched(spark, sf))

_TROWS = ", ".join(f"('{k}', '{t}', {i})" for i, (k, ts) in enumerate(V.ATTACK_TACTICS.items()) for t in ts)
# attack names that need the exact entry, the substring fallback, and none
ATT = "SELECT id, CASE WHEN id % 4 = 0 THEN concat(attack_type, '-x') WHEN id % 4 = 1 THEN 'Brute Force' ELSE attack_type END AS attack_type FROM alerts"
MITX = {"att2": ATT, "tmap": f"SELECT * FROM (VALUES {_TROWS}) t(k, tid, ord)", "tnames": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in V.TACTICS) + ") t(tid, tname)",
        "hit": """SELECT a, coalesce(min(ord) FILTER (k = a), min(ord)) AS ord FROM (SELECT DISTINCT attack_type AS a FROM att2) JOIN tmap ON k = a OR contains(a, k) OR contains(k, a) GROUP BY a"""}


@query("join_mitre", vw("SELECT id, attack_type, tid AS tactic_id, tname AS tactic FROM att2 JOIN hit ON hit.a = attack_type JOIN tmap ON tmap.ord = hit.ord JOIN tnames USING (tid)", extra=MITX))
def _(spark, sf):
    a = alerts(spark, sf)
    return spark.sql(ATT.replace("FROM alerts", "FROM {a}"), a=a).transform(J.join_mitre)


query("join_family_tactic", vw(f"SELECT id, {casemap('attack_type', V.FAMILY_TACTIC, chr(39) + 'Unclassified' + chr(39))} AS mitre_tactic FROM alerts"))(
    lambda spark, sf: alerts(spark, sf).transform(J.join_family_tactic).select("id", "mitre_tactic"))

_MAC = "CASE flow_id % 6 WHEN 0 THEN '3c:07:54:00:00:01' WHEN 1 THEN 'B8-27-EB-11-22-33' WHEN 2 THEN '0011.3222.aabb' WHEN 3 THEN 'ffffff000000' WHEN 4 THEN '4C:5E:0C:aa:bb:cc' ELSE 'ab' END"
query("join_oui", vw("""SELECT flow_id, CASE flow_id % 6 WHEN 0 THEN 'Apple' WHEN 1 THEN 'Raspberry-Pi' WHEN 2 THEN 'Synology' WHEN 4 THEN 'MikroTik' END AS vendor,
 CASE flow_id % 6 WHEN 0 THEN 'laptop' WHEN 1 THEN 'server' WHEN 2 THEN 'nas' WHEN 4 THEN 'router' END AS class_hint FROM flows"""))(
    lambda spark, sf: flows(spark, sf).withColumn("mac", F.expr(_MAC)).transform(J.join_oui).select("flow_id", "vendor", "class_hint"))

_AN = "concat_ws(',', " + ", ".join(f"CASE WHEN dst_port IN {inlist(p)} AND dst_ip LIKE '93.%' THEN '{n}' END" for n, s, p in V.ANONYMIZERS) + f", CASE WHEN ja3 IN {inlist(V.JA3_TOR)} THEN 'tor' END)"
query("join_policy_ports", vw(f"SELECT flow_id, {_AN} AS categories FROM flows"))(
    lambda spark, sf: flows(spark, sf).transform(J.join_policy_ports).select("flow_id", F.array_join(F.transform("anonymizers", lambda a: a["category"]), ",").alias("categories")))
