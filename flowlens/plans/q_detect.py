"""Queries: detection, scoring, fusion, formats and the whole cascade."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from flowlens import values as V
from flowlens.functions import scores as S
from flowlens.operators import aggregates as A, detect as D, joins as J, output as O, windows as Wn
from flowlens.operators.policy import policy_by_rules, read_policies
from flowlens.operators.segments import running_totals, sliding
from flowlens.plans.cascade import cascade, scored_features
from flowlens.plans.flowview import START_US, alerts, flows, ladder_sql, scored, tls_flows, with_views
from flowlens.plans.q_aggregates import PEERX, peer_baseline
from flowlens.plans.q_features import CANON_SQL, TLSV, _RK, casemap, inlist
from flowlens.plans.q_joins import (BAD_DOM, BAD_IPS, BAD_JA3, DIMS, DNS, DNS_SQL, HITS, IDENT, JB, KNOWN, PATS, PAT_SQL, SUPP, WALK, _bn, allowed, dim,
                                    identified, known_devices, with_hits)
from flowlens.plans.q_windows import (BEACON, BEACON_SQL, EM_SQL, EXPX, HOST_SQL, TEMP, ZX, hp_sql, keyed, real, recursive, running_z, slots, win, with_dept,
                                      _RISKX, _pick, uf_sql)
from flowlens.plans.registry import query, sql_round
from flowlens.session import cut, dealt, scratch_path

SEVN = "['BENIGN','LOW','MEDIUM','HIGH','CRITICAL']"


def vw(sql, **kw):
    return with_views(sql, extra={**DIMS, **kw.pop("extra", {})}, **kw)


def named(name, sql, fn, **kw):
    query(name, vw(sql, **kw) if sql else None)(fn)


# ── model columns ────────────────────────────────────────────────────────────
named("route_stage2", "SELECT flow_id, CASE WHEN p < 0.04 THEN 'benign' ELSE 'attack' END AS label, round(CASE WHEN p < 0.04 THEN 1 - p ELSE p END, 6) + 0.0 AS confidence FROM scored",
      lambda spark, sf: scored(spark, sf).transform(D.route_stage2).select("flow_id", "label", "confidence"))
ML = {"ml": f"""SELECT *, p >= 0.04 AS is_attack, CASE WHEN p < 0.04 THEN 'BENIGN' WHEN fam <> '' THEN fam ELSE 'Unclassified' END AS ml_type, CASE WHEN p >= 0.04 THEN {ladder_sql('p', 'cascade')} ELSE 'BENIGN' END AS ml_severity,
 CASE WHEN p >= 0.04 AND fam <> '' THEN 'stage2_family' ELSE 'stage1_binary' END AS ml_source FROM (SELECT *, CASE WHEN flow_id % 7 = 0 THEN '' ELSE family END AS fam FROM scored)"""}


def ml_rows(spark, sf):
    return D.ml_result(scored(spark, sf).withColumn("fam", F.when(F.col("flow_id") % 7 == 0, "").otherwise(F.col("family"))), family="fam")


named("ml_result", "SELECT flow_id, CAST(is_attack AS INT) AS is_attack, ml_type, ml_severity, ml_source FROM ml",
      lambda spark, sf: ml_rows(spark, sf).select("flow_id", F.col("is_attack").cast("int"), "ml_type", "ml_severity", "ml_source"), extra=ML)
_PR = "array(p1, p2, p3, p1 * p2, (p1 + p3) / 2)"
named("score_stage2", f"SELECT flow_id, (['BitCoinMiner','BruteForce','Coinminer','Coinminer-v2','Hajime'])[list_position(l, list_max(l))] AS family, round(list_max(l), 6) + 0.0 AS family_confidence FROM (SELECT flow_id, [p1, p2, p3, p1 * p2, (p1 + p3) / 2] AS l FROM flows)",
      lambda spark, sf: D.score_stage2(flows(spark, sf).select("flow_id", F.expr(_PR).alias("pr")), probs="pr", classes=V.FAMILIES[:5]).drop("pr"))
named("final_score_blend", f"SELECT id, final, {ladder_sql('final', 'blend')} AS severity FROM (SELECT id, round(CASE WHEN id % 2 = 0 THEN 0.60*ml_score + 0.25*ueba_score + 0.15*eta_score ELSE 0.85*ml_score + 0.15*eta_score END, 6) + 0.0 AS final FROM alerts)",
      lambda spark, sf: alerts(spark, sf).withColumns({"ueba_ready": F.col("id") % 2 == 0, "rule_score": F.col("eta_score")})
      .select("id", F.round(D.final_score_blend() + 1e-9, 6).alias("final")).withColumn("severity", S.severity_of("final", "blend")))

# ── specialist verdicts ──────────────────────────────────────────────────────
_L1 = "CASE WHEN flow_id % 3 = 0 THEN 'DoS' ELSE family END"
_L3 = "CASE WHEN flow_id % 2 = 0 THEN 'DoS' ELSE family END"
SPEC = {"spec": f"""SELECT *, {_L1} AS l1, family AS l2, {_L3} AS l3, p1 >= 0.5 AS a1, p2 >= 0.5 AS a2, p3 >= 0.5 AS a3, CASE WHEN p1 >= 0.5 THEN p1 ELSE 1 - p1 END AS c1, CASE WHEN p2 >= 0.5 THEN p2 ELSE 1 - p2 END AS c2,
 CASE WHEN p3 >= 0.5 THEN p3 ELSE 1 - p3 END AS c3 FROM scored"""}


def verdicts(df):
    lab = {"1": F.expr(_L1), "2": F.col("family"), "3": F.expr(_L3)}
    v = [F.struct(F.lit(s).alias("source"), lab[i].alias("label"), (F.col(f"p{i}") >= 0.5).alias("is_attack"),
                  F.when(F.col(f"p{i}") >= 0.5, F.col(f"p{i}")).otherwise(1 - F.col(f"p{i}")).alias("confidence"), (1 - F.col(f"p{i}")).alias("benign_prob"))
         for i, s in (("1", "spec1_cic"), ("2", "spec2_botnet"), ("3", "spec3_iot"))]
    return df.withColumn("verdicts", F.array(*v))


_n = "(CAST(a1 AS INT) + CAST(a2 AS INT) + CAST(a3 AS INT))"
_m = "greatest(CASE WHEN a1 THEN c1 ELSE 0 END, CASE WHEN a2 THEN c2 ELSE 0 END, CASE WHEN a3 THEN c3 ELSE 0 END)"
_bl = f"CASE WHEN a1 AND c1 = {_m} THEN l1 WHEN a2 AND c2 = {_m} THEN l2 ELSE l3 END"
_bs = f"CASE WHEN a1 AND c1 = {_m} THEN 'spec1_cic' WHEN a2 AND c2 = {_m} THEN 'spec2_botnet' ELSE 'spec3_iot' END"
_one = "(NOT a1 OR NOT a2 OR l1 = l2) AND (NOT a1 OR NOT a3 OR l1 = l3) AND (NOT a2 OR NOT a3 OR l2 = l3)"
_srcs = "concat_ws('+', CASE WHEN a1 THEN 'spec1_cic' END, CASE WHEN a2 THEN 'spec2_botnet' END, CASE WHEN a3 THEN 'spec3_iot' END)"
CONS = f"""SELECT flow_id, CASE WHEN n = 0 THEN 'Unknown' ELSE bl END AS consensus_type, round(q, 6) + 0.0 AS consensus_probability, CASE WHEN n = 0 THEN 'LOW' ELSE {ladder_sql('q', 'confidence')} END AS consensus_severity,
 CASE WHEN n = 0 THEN 'none_agreed' WHEN n = 1 THEN bs WHEN one THEN concat('consensus(', srcs, ')') ELSE concat('split(', bs, ')') END AS consensus_source FROM
 (SELECT *, CASE WHEN n = 0 THEN p * 0.4 WHEN n = 1 THEN p * m * 0.9 WHEN one THEN p * least(m * (1.05 + n * 0.1), 1.0) ELSE p * m * 0.85 END AS q FROM (SELECT *, {_n} AS n, {_m} AS m, {_bl} AS bl, {_bs} AS bs, {_one} AS one, {_srcs} AS srcs FROM spec))"""
named("consensus_specialists", CONS, lambda spark, sf: verdicts(scored(spark, sf)).transform(D.consensus_specialists).select("flow_id", "consensus_type", "consensus_probability", "consensus_severity", "consensus_source"), extra=SPEC)
named("binary_gate", "SELECT flow_id, CAST(p > 0.5 AS INT) AS gate, CASE WHEN p > 0.5 THEN 3 ELSE 0 END AS n_verdicts FROM scored",
      lambda spark, sf: verdicts(scored(spark, sf)).transform(D.binary_gate).select("flow_id", F.col("gate_attack").cast("int").alias("gate"), F.size("verdicts").alias("n_verdicts")))
_SPF = ["Dst Port", "Flow Duration", "TotLen Fwd Pkts", "Nowhere", "Elsewhere"]
named("specialist_features", "SELECT flow_id, CASE WHEN (flow_id % 3 = 0) THEN NULL ELSE round(dst_port + duration + fwd_bytes, 6) + 0.0 END AS total FROM flows",
      lambda spark, sf: flows(spark, sf).withColumn("duration", F.when(F.col("flow_id") % 3 != 0, F.col("duration"))).transform(D.specialist_features, features=_SPF)
      .select("flow_id", F.when(F.col("features").isNotNull(), F.aggregate("features", F.lit(0.0), lambda a, x: a + x)).alias("total")))

# ── TLS and intelligence gate ────────────────────────────────────────────────
_ja3s = f"CASE WHEN ja3s IN {inlist(V.JA3_BROWSERS)} OR ja3s = '' THEN NULL ELSE coalesce(bs.severity, CASE WHEN {casemap('f.ja3s', V.JA3_SUSPECT, 'NULL')} IS NOT NULL THEN 'HIGH' END) END"
ETA = {"etaj": f"SELECT f.*, {JB.format('severity', 'CASE WHEN ' + _bn + ' IS NOT NULL THEN ' + chr(39) + 'HIGH' + chr(39) + ' END')} AS j1, {_ja3s} AS j2 FROM tls f LEFT JOIN bad_ja3 b ON b.ja3 = f.ja3 LEFT JOIN bad_ja3 bs ON bs.ja3 = f.ja3s",
       "etaf": f"""SELECT *, {TLSV} > 0 AS v1, cert_self_signed AS v2, cert_expired AS v3, cert_subject <> '' AND sni <> '' AND lower(cert_subject) <> lower(sni) AS v4,
 dst_port = 443 AND dst_ip LIKE '93.%' AND (sni = '' OR regexp_matches(sni, '^[0-9.]+$')) AS v5, cipher_suite IN (10, 47, 53, 4, 5) AS v6, dst_port = 443 AS is_tls FROM etaj""",
       "eta": f"""SELECT *, CASE WHEN is_tls THEN round(least(CASE j1 WHEN 'CRITICAL' THEN 0.6 ELSE CASE WHEN j1 IS NULL THEN 0 ELSE 0.4 END END + CASE WHEN j2 IS NULL THEN 0 ELSE 0.2 END + {TLSV} + CASE WHEN v2 THEN 0.25 ELSE 0 END + CASE WHEN v3 THEN 0.15 ELSE 0 END
 + CASE WHEN v4 THEN 0.2 ELSE 0 END + CASE WHEN v5 THEN 0.15 ELSE 0 END + CASE WHEN v6 THEN 0.15 ELSE 0 END, 1.0), 4) ELSE 0 END AS eta_score, CASE WHEN is_tls THEN CAST(v1 AS INT) + CAST(v2 AS INT) + CAST(v3 AS INT) + CAST(v4 AS INT) + CAST(v5 AS INT) + CAST(v6 AS INT) ELSE 0 END AS n_anom FROM etaf"""}


def eta_rows(spark, sf):
    return D.eta_score(tls_flows(spark, sf), bad_ja3=dim(spark, sf, BAD_JA3))


named("eta_score", "SELECT flow_id, CAST(is_tls AS INT) AS is_tls, round(CAST(eta_score AS DOUBLE), 6) + 0.0 AS eta_score, n_anom FROM eta",
      lambda spark, sf: eta_rows(spark, sf).select("flow_id", F.col("is_tls").cast("int"), "eta_score", F.size("tls_anomalies").alias("n_anom")), extra=ETA)
_pairs = {k: v[0] for k, v in V.JA3_PAIRS.items()}
PAIR = {"pair": f"""SELECT *, {casemap("concat(ja3, '_', ja3s)", _pairs, 'NULL')} AS pair_name, {casemap('ja3', {k: v[0] for k, v in V.JA3_MALWARE.items()}, 'NULL')} AS malware_name, {casemap('ja3', {k: v[2] for k, v in V.JA3_MALWARE.items()}, 'NULL')} AS malware_severity,
 ja3 IN {inlist(sorted({k.split('_')[0] for k in V.JA3_PAIRS}))} AND ja3s <> '' AND {casemap("concat(ja3, '_', ja3s)", _pairs, 'NULL')} IS NULL AS pair_mismatch FROM eta"""}
named("ja3_pair_match", "SELECT flow_id, pair_name, malware_name, malware_severity, CAST(pair_mismatch AS INT) AS pair_mismatch FROM pair",
      lambda spark, sf: D.ja3_pair_match(tls_flows(spark, sf)).select("flow_id", "pair_name", "malware_name", "malware_severity", F.col("pair_mismatch").cast("int")), extra={**ETA, **PAIR})
named("ja3_rarity", """SELECT flow_id, CAST(ja3 <> '' AND row_number() OVER (PARTITION BY src_ip, ja3 ORDER BY t_us, flow_id) = 1 AS INT) AS entity_new, CAST(ja3 <> '' AND n < 70 AS INT) AS network_rare
 FROM flows LEFT JOIN (SELECT ja3, count(DISTINCT src_ip) AS n FROM flows GROUP BY 1) USING (ja3)""",
      lambda spark, sf: D.ja3_rarity(flows(spark, sf), rare_below=70).select("flow_id", F.col("ja3_entity_new").cast("int").alias("entity_new"), F.col("ja3_network_rare").cast("int").alias("network_rare")))
named("dns_tls_check", f"SELECT flow_id, CAST(ext AND q IS NULL AS INT) AS hardcoded, CAST(ext AND q IS NOT NULL AND sni <> '' AND lower(sni) <> lower(q) AS INT) AS fronting FROM (SELECT f.flow_id, f.sni, f.dst_port = 443 AND f.dst_ip LIKE '93.%' AS ext, d.dns_resolved AS q FROM flows f JOIN ({DNS_SQL}) d USING (flow_id))",
      lambda spark, sf: J.join_dns_asof(flows(spark, sf), dim(spark, sf, DNS), bucket_us=60_000_000).transform(D.dns_tls_check).select("flow_id", F.col("hardcoded_ip").cast("int").alias("hardcoded"), F.col("domain_fronting").cast("int").alias("fronting")))

_wl = "flow_id % 31 = 0"
GATE = {**HITS, **ETA, **PAIR,
        "gate": f"""SELECT p.*, m, best_severity, CASE WHEN best_type = 'ip' THEN dc WHEN best_type = 'ja3' THEN jc ELSE 'malware_distribution' END AS best_cat, ds, dc, {_wl} AS wl,
 CASE WHEN {_wl} THEN 'SKIP_BENIGN' WHEN m >= 3 OR pair_name IS NOT NULL OR (malware_severity = 'CRITICAL' AND NOT pair_mismatch) THEN 'ALERT_IMMEDIATE' ELSE 'CONTINUE' END AS gate_action FROM pair p JOIN (SELECT flow_id, m, best_severity, best_type, ds, dc, jc FROM hits) h USING (flow_id)""",
        "gat": """SELECT *, CASE WHEN gate_action = 'CONTINUE' AND m > 0 THEN 0.15 ELSE 0 END AS ti_boost, CASE WHEN gate_action = 'CONTINUE' AND m > 0 THEN best_severity ELSE '' END AS ti_severity,
 CASE WHEN gate_action = 'CONTINUE' AND n_anom > 0 AND eta_score > 0 THEN least(n_anom * 0.1, 0.25) ELSE 0 END AS eta_pure,
 CASE WHEN wl THEN 'whitelist' WHEN m >= 3 THEN 'threat_intel' WHEN pair_name IS NOT NULL THEN 'ja3_pair_match' WHEN malware_severity = 'CRITICAL' AND NOT pair_mismatch THEN 'ja3_match' ELSE '' END AS gate_source,
 CASE WHEN wl THEN 'BENIGN' WHEN m >= 3 THEN best_severity WHEN gate_action = 'ALERT_IMMEDIATE' THEN 'CRITICAL' ELSE 'BENIGN' END AS gate_severity,
 CASE WHEN wl THEN '' WHEN m >= 3 THEN best_cat WHEN pair_name IS NOT NULL THEN pair_name WHEN gate_action = 'ALERT_IMMEDIATE' THEN malware_name ELSE '' END AS gate_attack FROM gate"""}


def gated(spark, sf):
    d = with_hits(tls_flows(spark, sf), spark, sf).withColumn("whitelisted", F.col("flow_id") % 31 == 0)
    d = D.eta_score(d, bad_ja3=dim(spark, sf, BAD_JA3))
    return D.ja3_pair_match(d).transform(D.intel_gate)


named("intel_gate", "SELECT flow_id, gate_action, gate_severity, gate_source, gate_attack, ti_severity, " + sql_round({"ti_boost": "ti_boost", "eta_pure": "eta_pure", "intel_boost": "least(ti_boost + eta_pure, 0.5)"}) + " FROM gat",
      lambda spark, sf: gated(spark, sf).select("flow_id", "gate_action", "gate_severity", "gate_source", "gate_attack", "ti_severity", "ti_boost", "eta_pure", "intel_boost"), extra=GATE)
named("apply_intel_boost", "SELECT flow_id, CAST(att OR flip AS INT) AS is_attack, CASE WHEN flip THEN 'MEDIUM' ELSE s END AS ml_severity, CASE WHEN flip THEN 'TLS_Suspicious' ELSE t END AS ml_type FROM (SELECT flow_id, p1 >= 0.45 AS att, CASE WHEN p1 >= 0.45 THEN 'HIGH' ELSE 'BENIGN' END AS s, CASE WHEN p1 >= 0.45 THEN family ELSE 'BENIGN' END AS t, p1 < 0.45 AND p2 * 0.5 > 0 AND p1 + p2 * 0.5 > 0.5 AS flip FROM flows)",
      lambda spark, sf: D.apply_intel_boost(flows(spark, sf).select("flow_id", (F.col("p1") >= 0.45).alias("is_attack"), F.when(F.col("p1") >= 0.45, "HIGH").otherwise("BENIGN").alias("ml_severity"),
                                                                   F.when(F.col("p1") >= 0.45, F.col("family")).otherwise("BENIGN").alias("ml_type"), F.lit("x").alias("ml_source"), F.col("p1").alias("ml_score"), (F.col("p2") * 0.5).alias("intel_boost")))
      .select("flow_id", F.col("is_attack").cast("int"), "ml_severity", "ml_type"))

# ── policy ───────────────────────────────────────────────────────────────────
_ext = "dst_ip LIKE '93.%'"
# fwd bytes scaled up so that the exfiltration rule fires
POL = {**IDENT, "pol0": "SELECT i.*, CASE WHEN flow_id % 2 = 0 THEN fwd_bytes * 2000 ELSE fwd_bytes END AS fb, b.category AS dcat FROM ident i LEFT JOIN bad_ips b ON b.ip = i.dst_ip",
       "pol1": f"""SELECT *, {_ext} AND dst_port = 9001 AS tor, {_ext} AND dst_port = 4444 AS i2p, {_ext} AND dst_port = 1194 AS vpn, lower(device_type) AS dt,
 make_timestamp({START_US} + t_us * 3600) AS tt, department IN ('IT') AS auth FROM pol0""",
       "pol2": """SELECT *, vpn AND NOT auth AS vp, tor OR i2p OR (vpn AND NOT auth) AS any_anon, (dt = 'ip_camera' OR dt = 'printer') AS iot_dev FROM pol1""",
       "pol3": """SELECT *, iot_dev AND any_anon AS d1, iot_dev AND dst_port IN (22, 3389, 5900, 4444, 6667, 31337) AS d2, dt = 'workstation' AND i2p AS d3 FROM pol2""",
       "pol4": """SELECT *, CASE WHEN any_anon OR d2 THEN CASE department WHEN 'Finance' THEN any_anon OR d1 OR d2 WHEN 'IoT' THEN true WHEN 'Guest' THEN i2p WHEN 'IT' THEN false ELSE false END ELSE false END AS dep FROM pol3""",
       "pol5": """SELECT *, any_anon OR d2 AS base, (any_anon OR d2) AND (isodow(tt) > 5 OR hour(tt) < 8 OR hour(tt) > 19) AS late, (tor OR i2p OR vpn) AND fb > 10000000 AS exf, coalesce(dcat = 'anonymizer', false) AS ex, contains(lower(sni), 'hdfc-secure') AS bank FROM pol4""",
       "pol": """SELECT *, list_filter([CASE WHEN tor THEN '3tor' END, CASE WHEN i2p THEN '3i2p' END, CASE WHEN vp THEN '2vpn_unauthorized' END, CASE WHEN d1 THEN '4device_restriction' END, CASE WHEN d2 THEN '4device_port_violation' END, CASE WHEN d3 THEN '3device_restriction' END,
 CASE WHEN dep THEN CASE department WHEN 'Finance' THEN '3' WHEN 'IoT' THEN '4' ELSE '1' END || 'department_restriction' END, CASE WHEN late THEN '2time_escalation' END, CASE WHEN exf THEN '4exfiltration' END, CASE WHEN ex THEN '3tor_exit_node' END, CASE WHEN bank THEN '3credential_harvesting' END], lambda x: x IS NOT NULL) AS v FROM pol5""",
       "polr": f"""SELECT *, len(v) > 0 AS violation, coalesce({SEVN}[mr + 1], 'BENIGN') AS policy_severity, coalesce(list_filter(v, lambda x: x[1] = CAST(mr AS VARCHAR))[1][2:], '') AS policy_category FROM (SELECT *, CAST(list_max(list_transform(v, lambda x: x[1])) AS INT) AS mr FROM pol)"""}


def policy_input(spark, sf):
    d = identified(spark, sf).withColumns({"fwd_bytes": F.when(F.col("flow_id") % 2 == 0, F.col("fwd_bytes") * 2000).otherwise(F.col("fwd_bytes")),
                                           "ts": F.timestamp_micros(F.lit(START_US) + F.col("t_us") * 3600)})
    return d.join(dim(spark, sf, BAD_IPS).select(F.col("ip").alias("dst_ip"), F.col("category").alias("dst_category")), "dst_ip", "left")


def policy_rows(spark, sf):
    return D.policy_eval(policy_input(spark, sf))


# Rules unlike the built-in ones: a new category, other severities, a department without rules, other hours.
POLICY_FILE = {
    "anonymizer_detection": {"enabled": True, "tor": {"default_severity": "HIGH", "dst_ports": [9001]}, "i2p": {"default_severity": "HIGH", "dst_ports": [4444]},
                             "vpn_unauthorized": {"default_severity": "MEDIUM", "dst_ports": [1194]}, "proxy": {"enabled": False, "dst_ports": [80]}, "webproxy": {"default_severity": "LOW", "dst_ports": [8080]}},
    "device_restrictions": {"enabled": True, "rules": [{"device_types": ["IP_Camera", "printer"], "forbidden_categories": ["Anonymizer"], "severity": "CRITICAL"},
                                                       {"device_types": ["ip_camera", "printer"], "forbidden_ports": [22, 3389], "severity": "LOW"},
                                                       {"device_types": ["workstation"], "forbidden_categories": ["i2p"], "severity": "HIGH"}]},
    "department_policies": {"enabled": True, "rules": {"Finance": {"forbidden_categories": ["webproxy"], "severity_boost": "LOW"}, "IoT": {"forbidden_categories": ["anonymizer"], "severity_boost": "CRITICAL"},
                                                       "IT": {"allowed_categories": ["webproxy"], "forbidden_categories": ["anonymizer"], "severity_boost": "MEDIUM"}}},
    "time_based_policies": {"enabled": True, "business_hours": {"start": 6, "end": 21}},
    "authorized_vpn": {"authorized_ips": ["192.168.20.1"], "authorized_departments": ["Sales"], "authorized_server_ips": []},
}
_DIFF = {"pol1": [("dst_port = 1194 AS vpn", f"dst_port = 1194 AS vpn, {_ext} AND dst_port = 8080 AS web"), ("department IN ('IT')", "(department = 'Sales' OR src_ip = '192.168.20.1')")],
         "pol2": [("(vpn AND NOT auth) AS any_anon", "(vpn AND NOT auth) OR web AS any_anon")], "pol3": [("(22, 3389, 5900, 4444, 6667, 31337)", "(22, 3389)")],
         "pol4": [("WHEN 'Finance' THEN any_anon OR d1 OR d2", "WHEN 'Finance' THEN web"), ("WHEN 'Guest' THEN i2p", ""), ("WHEN 'IT' THEN false", "WHEN 'IT' THEN tor OR i2p OR vp OR d1 OR d2 OR d3")],
         "pol5": [("hour(tt) < 8 OR hour(tt) > 19", "hour(tt) < 6 OR hour(tt) > 21"), ("(tor OR i2p OR vpn)", "(tor OR i2p OR vpn OR web)")],
         "pol": [("CASE WHEN vp THEN '2vpn_unauthorized' END,", "CASE WHEN vp THEN '2vpn_unauthorized' END, CASE WHEN web THEN '1webproxy' END,"), ("'4device_port_violation'", "'1device_port_violation'"),
                 ("WHEN 'Finance' THEN '3' WHEN 'IoT' THEN '4' ELSE '1' END", "WHEN 'Finance' THEN '1' WHEN 'IoT' THEN '4' ELSE '2' END")]}
POL_FILE = dict(POL)
for _k, _changes in _DIFF.items():
    for _old, _new in _changes:
        assert _old in POL_FILE[_k]
        POL_FILE[_k] = POL_FILE[_k].replace(_old, _new)


named("policy_eval", "SELECT flow_id, CAST(violation AS INT) AS violation, policy_severity, policy_category, len(v)::INT AS n_violations, round(CAST(CASE policy_severity WHEN 'CRITICAL' THEN 0.5 WHEN 'HIGH' THEN 0.4 WHEN 'MEDIUM' THEN 0.25 WHEN 'LOW' THEN 0.1 ELSE 0 END AS DOUBLE), 6) + 0.0 AS policy_boost FROM polr",
      lambda spark, sf: policy_rows(spark, sf).select("flow_id", F.col("violation").cast("int"), "policy_severity", "policy_category", F.size("policy_reasons").alias("n_violations"), "policy_boost"), extra=POL)
@query("policy_rules_as_data", vw("SELECT flow_id, CAST(violation AS INT) AS violation, policy_severity, policy_category, len(v)::INT AS n_violations FROM polr", extra=POL_FILE))
def _(spark, sf):
    path = scratch_path(spark, "policies")
    spark.createDataFrame([(json.dumps(POLICY_FILE, indent=1),)], "value string").coalesce(1).write.text(path)
    d = policy_by_rules(policy_input(spark, sf), read_policies(spark, path))
    return d.select("flow_id", F.col("violation").cast("int"), "policy_severity", "policy_category", F.size("policy_reasons").alias("n_violations"))


named("vpn_authorized", "SELECT flow_id, CAST(src_ip IN ('192.168.10.10', '192.168.10.20') OR department = 'IT' AS INT) AS ok FROM ident",
      lambda spark, sf: identified(spark, sf).select("flow_id", D.vpn_authorized().cast("int").alias("ok")), extra=IDENT)

# ── peers and behaviour ──────────────────────────────────────────────────────
_z = lambda m: f"round(CASE WHEN std_{m} < 0.01 THEN CASE WHEN abs({m} - mean_{m}) < 0.01 THEN 0 ELSE 10 END ELSE abs({m} - mean_{m}) / std_{m} END, 9)"
PDX = {**PEERX, "emd": "SELECT *, " + __import__("flowlens.plans.q_windows", fromlist=["DEPT_SQL"]).DEPT_SQL + " AS department FROM em",
       "pz": "SELECT emd.*, p.mean_fpm IS NOT NULL AND fpm IS NOT NULL AS known, " + ", ".join(f"{_z(m)} AS z_{m}" for m in A.PEER) + " FROM emd LEFT JOIN (SELECT * FROM peerm WHERE is_ready) p USING (department)",
       "pdev": """SELECT *, CASE WHEN known THEN least(CASE WHEN z_fpm >= 5 THEN 0.35 WHEN z_fpm >= 3 THEN 0.20 ELSE 0 END + CASE WHEN z_unique_dst >= 5 THEN 0.30 WHEN z_unique_dst >= 3 THEN 0.15 ELSE 0 END + CASE WHEN z_bytes_per_flow >= 5 THEN 0.25 WHEN z_bytes_per_flow >= 3 THEN 0.10 ELSE 0 END
 + CASE WHEN z_send_ratio >= 4 AND send_ratio > 0.8 THEN 0.30 WHEN z_send_ratio >= 3 THEN 0.10 ELSE 0 END, 1.0) ELSE 0 END AS peer_score FROM pz"""}


def peer_rows(spark, sf):
    return D.peer_deviation(with_dept(flows(spark, sf).transform(Wn.entity_metrics_60s)), peer_baseline(spark, sf))


named("peer_deviation", "SELECT flow_id, round(CAST(peer_score AS DOUBLE), 6) + 0.0 AS peer_score FROM pdev", lambda spark, sf: peer_rows(spark, sf).select("flow_id", "peer_score"), extra=PDX)
_own = {"own": "SELECT src_ip, avg(fpm) AS mean_fpm, avg(unique_dst) AS mean_unique_dst, avg(bytes_per_flow) AS mean_bytes_per_flow, avg(send_ratio) AS mean_send_ratio FROM push GROUP BY 1 HAVING count(*) >= 5"}


@query("cold_start_inherit", vw("SELECT src_ip, department, CASE WHEN o.mean_fpm IS NOT NULL THEN 'own' WHEN p.mean_fpm IS NOT NULL THEN 'department' ELSE 'none' END AS baseline_source, " + sql_round({f"mean_{m}": f"coalesce(o.mean_{m}, p.mean_{m})" for m in A.PEER})
                                + " FROM (SELECT DISTINCT src_ip, department FROM emd) LEFT JOIN own o USING (src_ip) LEFT JOIN (SELECT * FROM peerm WHERE is_ready) p USING (department)", extra={**PDX, **_own}))
def _(spark, sf):
    from flowlens.plans.q_windows import pushes
    ent = with_dept(flows(spark, sf)).select("src_ip", "department").distinct()
    own = pushes(spark, sf).groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"mean_{m}") for m in A.PEER]).filter("n >= 5")
    return D.cold_start_inherit(ent, own, peer_baseline(spark, sf))


UL = {**ZX, "ul": f"""SELECT *, max_z IS NOT NULL AS ready, coalesce(abs(max_z) >= 3, false) AS hot FROM zz"""}
named("ueba_long_result", f"""SELECT flow_id, CAST(ready AS INT) AS ueba_ready, CAST(hot AS INT) AS ueba_alert, CASE WHEN hot THEN {ladder_sql('abs(max_z)', 'zscore')} ELSE 'BENIGN' END AS ueba_severity,
 round(CASE WHEN ready THEN round(least(abs(max_z) * CASE WHEN hot THEN 10 ELSE 2 END, 100), 2) ELSE 0 END, 6) + 0.0 AS ueba_risk, round(CASE WHEN ready THEN round(least(abs(max_z)/10, 1), 4) ELSE 0 END, 6) + 0.0 AS ueba_anomaly FROM ul""",
      lambda spark, sf: D.ueba_long_result(running_z(spark, sf).withColumn("ts", F.timestamp_micros(F.lit(START_US) + F.col("t_us"))))
      .select("flow_id", F.col("ueba_ready").cast("int"), F.col("ueba_alert").cast("int"), "ueba_severity", "ueba_risk", "ueba_anomaly"), extra=UL)


# Two specialists, one behind a gate of its own.
_SPECS = {"spec2_botnet": ("p1", 0.80), "spec9": ("p2", 0.70)}
_at = {s: f"({p} >= 0.6 AND {p} >= {g})" for s, (p, g) in _SPECS.items()}
_nat = "(" + " + ".join(f"CAST({a} AS INT)" for a in _at.values()) + ")"
_conf = "greatest(" + ", ".join(f"CASE WHEN {a} THEN {_SPECS[s][0]} ELSE 0 END" for s, a in _at.items()) + ")"
_add = f"CASE WHEN {_nat} >= 2 THEN 0.3 WHEN {_nat} = 1 AND {_conf} >= 0.9 THEN 0.15 WHEN {_nat} = 1 AND {_conf} >= 0.75 THEN 0.05 ELSE 0 END"
_named = f"CAST({_nat} >= 2 OR ({_nat} = 1 AND {_conf} >= 0.9) AS INT)"
_calm = "(p1 < 0.6 AND p2 < 0.6 AND ((1 - p1) + (1 - p2)) / 2 > 0.9)"


def behaviour(spark, sf):
    """All inputs of the ten checks, on real time."""
    verdicts = F.array(*[F.struct(F.lit(s).alias("source"), (F.col(p) >= 0.6).alias("is_attack"), F.col(p).alias("confidence"), (F.lit(1.0) - F.col(p)).alias("benign_prob")) for s, (p, _) in _SPECS.items()])
    f = dealt(real(spark, sf), "flows")
    one = F.lit(1).cast("long")
    first = F.struct("t_us", "flow_id")
    windowed = cut(f.transform(Wn.ueba_60s_features), "windowed")
    d = windowed.transform(Wn.beacon_cv).transform(Wn.hour_profile, need=40)
    # first use of each port by the source, and of each protocol
    ports = f.groupBy("src_ip", "dst_port").agg(F.min(first).alias("_pf"))
    d = d.join(ports, ["src_ip", "dst_port"])
    d = d.withColumn("port_is_new", F.col("_pf.flow_id") == F.col("flow_id")).drop("_pf")
    d = running_totals(d, specs=[("src_ip", {"flow_idx": one, "_np": F.col("port_is_new").cast("long")}), (["src_ip", "protocol"], {"_pc": one})])
    same = sliding(f.select("flow_id", "t_us", "src_ip", "protocol"), key=["src_ip", "protocol"], horizon_us=60_000_000)
    d = d.join(same.select("flow_id", F.col("win_n").alias("proto_in_window")), "flow_id")
    e = Wn.expected_fallback(keyed(spark, sf, windowed), slots(spark, sf, windowed)).transform(Wn.zscore_slot, current={"fpm": "w_fpm", "unique_dst": "w_unique_dst", "bytes_pf": "flow_bytes"})
    d = d.join(e.select("flow_id", "flow_bytes", "mean_fpm", "z_fpm", "z_unique_dst", "z_bytes_pf"), "flow_id")
    return d.withColumns({"known_ports": F.col("_np") - F.col("port_is_new").cast("long"), "proto_share": F.col("_pc") / F.col("flow_idx"),
                          "mature": F.col("flow_idx") >= 30, "verdicts": verdicts})


_chk = {"rate": "CASE WHEN z_fpm >= 8 THEN 0.5 WHEN z_fpm >= 5 THEN 0.35 WHEN z_fpm >= 3 THEN 0.2 END",
        "dst": "CASE WHEN z_dst >= 8 AND ud >= 20 THEN 0.4 WHEN z_dst >= 4 AND ud >= 10 THEN 0.2 END",
        "port": f"CASE WHEN fi > 100 AND pnew AND kp >= 3 THEN CASE WHEN dst_port IN {inlist(V.BEHAVIOUR_THREAT_PORTS)} THEN 0.4 ELSE 0.1 END END",
        "fail": "CASE WHEN w_fpm >= 5 THEN CASE WHEN w_failed_ratio > 0.8 THEN 0.45 WHEN w_failed_ratio > 0.5 THEN 0.25 WHEN w_failed_ratio > 0.2 THEN 0.1 END END",
        "asym": "CASE WHEN w_bytes > 500000 THEN CASE WHEN w_send_ratio > 0.95 THEN 0.5 WHEN w_send_ratio > 0.85 THEN 0.3 END WHEN w_bytes > 50000 AND w_send_ratio > 0.9 THEN 0.15 END",
        "beac": "CASE WHEN beacon_n >= 15 THEN CASE WHEN beacon_cv < 0.05 AND beacon_mean > 10 THEN 0.4 WHEN beacon_cv < 0.15 AND beacon_mean > 30 THEN 0.2 END END",
        "hour": "CASE WHEN hour_dev >= 1 AND w_fpm > greatest(mf, 0.1) * 2 THEN 0.25 WHEN hour_dev >= 0.5 AND w_fpm > greatest(mf, 0.1) * 3 THEN 0.12 END",
        "vol": "CASE WHEN flow_bytes > 0 THEN CASE WHEN z_b >= 8 THEN 0.35 WHEN z_b >= 5 THEN 0.25 END END",
        "prot": "CASE WHEN fi > 50 AND pc / fi < 0.02 AND pw >= 3 THEN 0.2 END"}
_w = "(PARTITION BY {} ORDER BY t_us, flow_id ROWS UNBOUNDED PRECEDING)"
TENX = {**EXPX, **BEACON, "beac": BEACON_SQL, "hprof": hp_sql(40),
        "ten0": f"""SELECT uf.*, b.beacon_n, b.beacon_mean, b.beacon_cv, h.hour_dev, row_number() OVER {_w.format('uf.src_ip').replace('t_us, flow_id', 'uf.t_us, uf.flow_id')} AS fi, uf.protocol AS pr,
 row_number() OVER (PARTITION BY uf.src_ip, uf.dst_port ORDER BY uf.t_us, uf.flow_id) = 1 AS pnew, row_number() OVER (PARTITION BY uf.src_ip, uf.protocol ORDER BY uf.t_us, uf.flow_id) AS pc,
 count(*) OVER (PARTITION BY uf.src_ip, uf.protocol ORDER BY uf.t_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS pw FROM uf JOIN beac b USING (flow_id) JOIN hprof h USING (flow_id)""",
        "ten1": f"""SELECT t.*, sum(CAST(pnew AS INT)) OVER (PARTITION BY t.src_ip ORDER BY t.t_us, t.flow_id ROWS UNBOUNDED PRECEDING) - CAST(pnew AS INT) AS kp, e.flow_bytes, e.w_unique_dst AS ud, {_pick['mean_fpm']} AS mf,
 abs(e.w_fpm - {_pick['mean_fpm']}) / greatest({_pick['std_fpm']}, 0.01) AS z_fpm, abs(e.w_unique_dst - {_pick['mean_unique_dst']}) / greatest({_pick['std_unique_dst']}, 0.01) AS z_dst,
 abs(e.flow_bytes - {_pick['mean_bytes_pf']}) / greatest({_pick['std_bytes_pf']}, 0.01) AS z_b FROM ten0 t JOIN expd e USING (flow_id)""",
        "ten": "SELECT flow_id, fi >= 30 AS mature, " + " + ".join(f"coalesce({e}, 0)" for e in _chk.values()) + " AS s, " + " + ".join(f"CASE WHEN {e} IS NULL THEN 0 ELSE 1 END" for e in _chk.values()) + " AS k FROM ten1",
        "tenv": f"SELECT flow_id, mature, CASE WHEN {_calm} AND s + {_add} < 0.6 AND k + {_named} < 3 THEN greatest(0, s + {_add} - 0.15) ELSE s + {_add} END AS s, k + {_named} AS k FROM ten JOIN (SELECT flow_id, p1, p2 FROM uf) USING (flow_id)"}
named("anomaly_10_checks", "SELECT flow_id, round(CAST(CASE WHEN mature THEN least(s, 1.0) ELSE 0 END AS DOUBLE), 6) + 0.0 AS behaviour_score, CASE WHEN mature THEN k ELSE 0 END AS n_reasons FROM tenv",
      lambda spark, sf: D.anomaly_10_checks(behaviour(spark, sf), verdicts="verdicts").select("flow_id", "behaviour_score", F.size("behaviour_reasons").alias("n_reasons")), compress=1, extra=TENX)

# behaviour columns drawn from the flow for the gate tests
_BS, _BN = "CAST((flow_id * 29) % 100 AS DOUBLE) / 100", "(flow_id % 4)"
_g1, _g2, _g3 = "(a1 AND c1 >= 0.75)", "(a2 AND c2 >= 0.80)", "(a3 AND c3 >= 0.75)"
_gm = f"greatest(CASE WHEN {_g1} THEN c1 ELSE 0 END, CASE WHEN {_g2} THEN c2 ELSE 0 END, CASE WHEN {_g3} THEN c3 ELSE 0 END)"
G7 = {**SPEC, "g70": f"""SELECT *, flow_id % 10 <> 0 AS mature, {_BS} AS bs, {_BN} AS bn, CAST((flow_id * 7) % 100 AS DOUBLE) AS rep, CAST((flow_id * 3) % 100 AS DOUBLE) AS risk, CAST((flow_id * 11) % 50 AS DOUBLE) / 100 AS wr, flow_id % 9 AS wn,
 {_gm} AS sc, CASE WHEN {_g1} AND c1 = {_gm} THEN l1 WHEN {_g2} AND c2 = {_gm} THEN l2 ELSE l3 END AS sl FROM spec""",
      "g71": "SELECT *, sc > 0 AS sp, bs >= 0.4 AND bn >= 2 AS bh, CAST(sc > 0 AS INT) + CAST(bs >= 0.4 AND bn >= 2 AS INT) + CAST(bs >= 0.6 AS INT) AS n, greatest(sc, bs) AS cc FROM g70",
      "g72": f"SELECT *, {ladder_sql('cc', 'confidence')} AS sv, CASE WHEN n >= 3 THEN least(cc * 1.15, 1.0) WHEN n >= 2 THEN least(cc * 1.10, 1.0) ELSE cc END AS c22 FROM g71",
      "g73": f"""SELECT *, CASE WHEN NOT mature THEN 'G2' WHEN NOT sp AND NOT bh THEN 'G3' WHEN n < CASE WHEN sv IN ('CRITICAL', 'HIGH') THEN 2 ELSE 1 END AND sc < 0.97 THEN 'G4' WHEN NOT (sv = 'CRITICAL' AND sc >= 0.95) AND wn >= 5 AND wr < 0.15 THEN 'G5'
 WHEN rep < 25 AND sv <> 'CRITICAL' AND cc < 0.85 THEN 'G6' ELSE '' END AS blocked, CASE WHEN n >= 2 THEN {ladder_sql('c22', 'confidence')} ELSE sv END AS s2 FROM g72"""}


def gate_rows(spark, sf):
    names = F.array(*[F.lit(f"reason{i}") for i in range(3)])
    return verdicts(scored(spark, sf)).withColumns({
        "mature": F.col("flow_id") % 10 != 0, "behaviour_score": F.expr(_BS), "behaviour_reasons": F.slice(names, 1, (F.col("flow_id") % 4).cast("int")),
        "reputation": ((F.col("flow_id") * 7) % 100).cast("double"), "risk": ((F.col("flow_id") * 3) % 100).cast("double"),
        "window_ratio": ((F.col("flow_id") * 11) % 50).cast("double") / 100, "window_n": F.col("flow_id") % 9}).transform(D.seven_gates)


named("seven_gates", """SELECT flow_id, blocked AS gate_blocked_by, CASE WHEN blocked <> '' THEN 'BENIGN' WHEN risk >= 80 AND s2 <> 'CRITICAL' THEN CASE WHEN c22 >= 0.8 THEN 'CRITICAL' ELSE 'HIGH' END WHEN risk >= 60 AND s2 = 'MEDIUM' THEN 'HIGH' ELSE s2 END AS alert_severity,
 CASE WHEN blocked <> '' THEN '' WHEN sp AND bh THEN 'CONFIRMED' WHEN sp THEN 'SPECIALIST' ELSE 'UEBA_OVERRIDE' END AS alert_tag, CASE WHEN sp THEN sl WHEN bn > 0 THEN 'reason0' ELSE 'unknown' END AS alert_type FROM g73""",
      lambda spark, sf: gate_rows(spark, sf).select("flow_id", "gate_blocked_by", "alert_severity", "alert_tag", "alert_type"), extra=G7)

# ── confidence engine ────────────────────────────────────────────────────────
CONF = {"cf0": """SELECT flow_id, t_us, src_ip, p AS ml_score, family, p >= 0.5 AS is_attack, CAST((flow_id * 13) % 101 AS DOUBLE) / 101 AS ue, flow_id % 3 <> 0 AS ur, CAST((flow_id * 17) % 89 AS DOUBLE) / 88 AS ru, flow_id % 23 = 0 AS wl FROM scored""",
        "cf1": f"""SELECT *, is_attack AND ml_score >= 0.55 AS o1, ur AND ue > 0.5 AS o2, ru >= 0.65 AS o3, least(ue, 0.95) AS uc, {ladder_sql('least(ue, 0.95)', 'confidence')} AS us FROM cf0""",
        "cf2": "SELECT *, greatest(CASE WHEN o1 THEN ml_score ELSE 0 END, CASE WHEN o2 THEN uc ELSE 0 END, CASE WHEN o3 THEN ru ELSE 0 END) AS raw, CAST(o1 AS INT) + CAST(o2 AND us <> 'BENIGN' AS INT) + CAST(o3 AS INT) AS k FROM cf1",
        "cf3": f"""SELECT *, CASE WHEN k >= 3 THEN least(least(raw * 1.1, 1.0) * 1.15, 1.0) WHEN k >= 2 THEN least(raw * 1.1, 1.0) ELSE raw END AS cc, CASE WHEN o1 AND ml_score = raw THEN 'ml_ensemble' WHEN o2 AND uc = raw THEN 'ueba' WHEN o3 THEN 'rules' ELSE 'consensus' END AS src FROM cf2""",
        "cf4": f"""SELECT *, CASE WHEN NOT o1 AND NOT o2 AND NOT o3 THEN 'benign-consensus' WHEN raw < 0.55 THEN 'benign-gated' ELSE 'candidate' END AS v, CASE WHEN k >= 2 THEN {ladder_sql('cc', 'confidence')} WHEN src = 'ml_ensemble' THEN {ladder_sql('ml_score', 'confidence')} WHEN src = 'ueba' THEN us WHEN ru >= 0.85 THEN 'CRITICAL' ELSE 'HIGH' END AS sv FROM cf3 WHERE NOT wl""",
        "cf5": f"""SELECT *, v = 'candidate' AS att, CASE WHEN v = 'candidate' THEN sv ELSE 'BENIGN' END AS severity, CASE v WHEN 'benign-consensus' THEN 1 - ml_score WHEN 'benign-gated' THEN raw ELSE cc END AS p FROM cf4""",
        "cf6": f"SELECT *, count(*) {win(60_000_001)} AS n, sum(CAST(att AS INT)) {win(60_000_001)} AS na FROM cf5",
        "cf7": """SELECT flow_id, CASE WHEN NOT att THEN v WHEN (severity = 'CRITICAL' AND p > 0.95) OR na / n >= 0.55 OR (n < 5 AND p > 0.85) THEN 'attack' ELSE 'benign-suppressed' END AS final_verdict, p, src, severity, na / n AS wr, att FROM cf6"""}


def classified(spark, sf):
    d = scored(spark, sf).select("flow_id", "t_us", "src_ip", F.col("p").alias("ml_score"), F.col("family").alias("ml_type"), (F.col("p") >= 0.5).alias("is_attack"),
                                 (((F.col("flow_id") * 13) % 101) / 101.0).alias("ueba_score"), (F.col("flow_id") % 3 != 0).alias("ueba_ready"),
                                 (((F.col("flow_id") * 17) % 89) / 88.0).alias("rule_score"), (F.col("flow_id") % 23 == 0).alias("whitelisted"))
    return D.confidence_classify(d, alert_ratio=0.55)


named("confidence_classify", """SELECT flow_id, final_verdict, CASE WHEN final_verdict = 'attack' THEN severity ELSE 'BENIGN' END AS final_severity, round(p, 6) + 0.0 AS attack_conf, src AS class_source, round(wr, 6) + 0.0 AS window_ratio FROM cf7
 UNION ALL SELECT flow_id, 'benign-whitelist', 'BENIGN', 1.0, 'whitelist', 0.0 FROM cf0 WHERE wl""",
      lambda spark, sf: classified(spark, sf).select("flow_id", "final_verdict", "final_severity", "attack_conf", "class_source", "window_ratio"), extra=CONF)
named("agg_alert_stats", "SELECT count(*) AS total, count(*) FILTER (v = 'benign-whitelist') AS whitelisted, count(*) FILTER (v = 'benign-gated') AS gated, count(*) FILTER (v = 'benign-suppressed') AS suppressed, count(*) FILTER (v = 'attack') AS fired, round(round(count(*) FILTER (v IN ('benign-whitelist', 'benign-gated', 'benign-suppressed')) * 100.0 / count(*), 1), 6) + 0.0 AS fp_reduction_rate FROM (SELECT final_verdict AS v FROM cf7 UNION ALL SELECT 'benign-whitelist' FROM cf0 WHERE wl)",
      lambda spark, sf: A.fp_reduction(classified(spark, sf).drop("verdict").withColumnRenamed("final_verdict", "verdict")), extra=CONF)

# ── fusion ───────────────────────────────────────────────────────────────────
_FS = {"violation": "flow_id % 5 = 0", "policy_severity": "CASE flow_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'CRITICAL' END", "policy_category": "'tor'", "ueba_alert": "flow_id % 7 = 0",
       "ueba_severity": "CASE flow_id % 2 WHEN 0 THEN 'LOW' ELSE 'CRITICAL' END", "is_attack": "p >= 0.04", "ml_score": "p", "ml_severity": ladder_sql("p", "cascade"),
       "rule_score": "CASE WHEN flow_id % 11 = 0 THEN 0.9 WHEN flow_id % 13 = 0 THEN 1.0 ELSE 0.0 END", "ti_boost": "CASE WHEN flow_id % 6 = 0 THEN 0.15 ELSE 0.0 END", "ti_severity": "CASE WHEN flow_id % 6 = 0 THEN 'MEDIUM' ELSE '' END",
       "eta_pure": "CASE WHEN flow_id % 9 = 0 THEN 0.25 ELSE 0.0 END", "eta_anomaly_count": "CASE WHEN flow_id % 9 = 0 THEN 2 ELSE 0 END", "peer_score": "CASE WHEN flow_id % 17 = 0 THEN 0.75 WHEN flow_id % 19 = 0 THEN 0.45 ELSE 0.0 END"}
_rk = lambda c: f"CASE {c} WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"


def fuse_sql(src):
    """Signals as (rank, order, tag) rows, reduced by plain SQL."""
    arms = [("violation", _rk("policy_severity"), "concat('POLICY_', upper(policy_category))"), ("ueba_alert", _rk("ueba_severity"), "'UEBA_LONG'"), ("is_attack AND ml_score >= 0.5", _rk("ml_severity"), "'SPECIALIST'"),
            ("rule_score >= 0.85", "CASE WHEN rule_score >= 1 THEN 4 ELSE 3 END", "'RULE_MATCH'"), ("ti_boost > 0 AND ti_severity IN ('MEDIUM', 'LOW')", _rk("ti_severity"), "'THREAT_INTEL_SOFT'"),
            ("eta_pure >= 0.2 AND eta_anomaly_count >= 2", "CASE WHEN eta_pure >= 0.35 THEN 3 ELSE 2 END", "'ETA_TLS_ANOMALY'"), ("peer_score >= 0.4", "CASE WHEN peer_score >= 0.7 THEN 3 ELSE 2 END", "'PEER_DEVIATION'")]
    u = " UNION ALL ".join(f"SELECT flow_id, {r} AS rank, {i} AS ord, {t} AS tag FROM {src} WHERE {c}" for i, (c, r, t) in enumerate(arms))
    return f"SELECT flow_id, {SEVN}[CASE WHEN n >= 2 AND r > 0 THEN least(r + 1, 4) ELSE r END + 1] AS severity, tag, n AS n_signals FROM (SELECT flow_id, count(*) AS n, max(rank) AS r, min_by(tag, struct_pack(a := -rank, b := ord)) AS tag FROM ({u}) GROUP BY 1)"


FUSE = {"fs": "SELECT flow_id, " + ", ".join(f"{e} AS {n}" for n, e in _FS.items()) + " FROM scored", "fused": fuse_sql("fs")}


@query("fuse_signals", vw("SELECT * FROM fused", extra=FUSE))
def _(spark, sf):
    s = scored(spark, sf)
    d = spark.sql(f"SELECT flow_id, {', '.join(f'{e} AS {n}' for n, e in _FS.items())} FROM {{s}}", s=s)
    return D.fuse_signals(d).filter("alert").select("flow_id", "severity", "tag", F.col("n_signals").cast("long"))


TUNE = {"tl": "SELECT family AS source, p, CASE WHEN p1 + p2 > 1.2 THEN 1 ELSE 0 END AS label FROM scored",
        "th": "SELECT source, p, sum(label) AS np, count(*) - sum(label) AS nn FROM tl GROUP BY 1, 2",
        "tc": "SELECT *, sum(np) OVER w AS tp, sum(nn) OVER w AS fp, sum(np) OVER (PARTITION BY source) AS tot, sum(nn) OVER (PARTITION BY source) AS neg FROM th WINDOW w AS (PARTITION BY source ORDER BY p DESC ROWS UNBOUNDED PRECEDING)",
        "tf": "SELECT *, 2 * tp / (tp + fp + tot) AS f1, fp / greatest(neg, 1) AS fpr FROM tc WHERE fp / greatest(neg, 1) <= 0.01"}


named("tune_threshold", "SELECT source, " + sql_round({"tau": "p", "f1": "f1", "fpr": "fpr"}) + " FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(f1, 9) DESC, p DESC) AS r FROM tf) WHERE r = 1",
      lambda spark, sf: D.tune_threshold(scored(spark, sf).withColumn("label", F.when(F.col("p1") + F.col("p2") > 1.2, 1).otherwise(0)), source="family"), extra=TUNE)

# ── alert shaping and formats ────────────────────────────────────────────────
_RS = "CASE id % 3 WHEN 0 THEN ['Peer deviation: rate', 'Rule: Port Sweep', 'UEBA spike'] WHEN 1 THEN ['UEBA spike'] ELSE ['a', 'b', 'c', 'd'] END"


def reasoned(spark, sf):
    a = alerts(spark, sf)
    rs = "CASE id % 3 WHEN 0 THEN array('Peer deviation: rate', 'Rule: Port Sweep', 'UEBA spike') WHEN 1 THEN array('UEBA spike') ELSE array('a', 'b', 'c', 'd') END"
    return a.drop("rule_names").withColumns({"reasons": F.expr(rs), "department": F.lit("IT")})


@query("snk_alerts", vw("SELECT id, severity, strftime(ts, '%Y-%m-%d') AS alert_date, round(greatest(ml_score, ueba_score, rule_score, eta_score), 6) + 0.0 AS final_score, CAST(id % 3 = 0 AND (ml_score >= 0.5 OR ueba_score >= 0.5) AS INT) AS correlated, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS n_rules FROM alerts", compress=1))
def _(spark, sf):
    from flowlens.session import scratch_path
    from flowlens.sources import sinks
    a = alerts(spark, sf, 1).drop("rule_names")
    rs = "CASE id % 3 WHEN 0 THEN array('Peer deviation: rate', 'Rule: Port Sweep', 'UEBA spike') WHEN 1 THEN array('UEBA spike') ELSE array('a', 'b', 'c', 'd') END"
    path = scratch_path(spark, "alerts")
    sinks.snk_alerts(a.withColumn("reasons", F.expr(rs)), path)
    d = spark.read.parquet(path)
    return d.select("id", "severity", F.date_format("alert_date", "yyyy-MM-dd").alias("alert_date"), "final_score", F.col("correlated").cast("int"), F.size("rule_names").alias("n_rules"))


named("cef_format", f"""SELECT id, concat('<', 32 + s, '>CEF:0|flowlens|flowlens|1.0|', attack_type, '|', severity, '|', s, '|src=', src_ip, ' dst=', dst_ip, ' dpt=', dst_port, ' cs1=', tag, ' cs2=IT cfp1=', CAST(CAST(id % 50 AS DOUBLE) AS VARCHAR), ' msg=', array_to_string(({_RS})[1:3], '; ')) AS line
 FROM (SELECT *, CASE severity WHEN 'CRITICAL' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 4 ELSE 6 END AS s FROM alerts)""",
      lambda spark, sf: (lambda d: d.select("id", O.cef_format(d).alias("line")))(reasoned(spark, sf).withColumn("confidence", (F.col("id") % 50).cast("double"))))
_IT = casemap("attack_type", {k: v for k, v in V.INCIDENT_TYPES.items()}, f"'{V.INCIDENT_DEFAULT}'")
_ACT = " ".join([f"WHEN severity = 'CRITICAL' THEN '{V.ACTION_CRITICAL}'", f"WHEN attack_type = 'Ransomware' THEN '{V.ACTION_RANSOMWARE}'", f"WHEN severity = 'HIGH' THEN '{V.ACTION_HIGH}'"])
_HITS = "CASE WHEN id % 3 = 0 THEN dst_ip || ',feed' ELSE '' END"
named("certin_report", f"""SELECT id, {_IT} AS type, CASE {_ACT} ELSE '{V.ACTION_DEFAULT}' END AS action, src_ip AS src, dst_ip AS dst, dst_port AS port, severity, f.ja3 AS ja3_hash, {_HITS.replace('dst_ip', 'alerts.dst_ip')} AS hits,
 round(ml_score, 6) + 0.0 AS ml_score, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS detected, '2024-02-01T00:00:00' AS reported, 'Org' AS organization, array_to_string({_RS}, ';') AS reasons
 FROM (SELECT *, id AS fid FROM alerts) alerts JOIN (SELECT flow_id AS jid, ja3 FROM flows) f ON f.jid = alerts.fid""".replace("SELECT id, ", "SELECT alerts.id, ", 1),
      lambda spark, sf: O.certin_report(
          reasoned(spark, sf).join(flows(spark, sf).select(F.col("flow_id").alias("id"), "ja3"), "id").withColumn("threat_intel_hits", F.when(F.col("id") % 3 == 0, F.array("dst_ip", F.lit("feed")))),
          organization="Org", reported_at=F.lit("2024-02-01 00:00:00").cast("timestamp"), name="j").select(
          "id", *[F.get_json_object("j", f"$.{path}").cast(kind).alias(n) for n, path, kind in (
              ("type", "incident.type", "string"), ("action", "recommended_action", "string"), ("src", "affected_systems[0].ip", "string"), ("dst", "affected_systems[1].ip", "string"),
              ("port", "affected_systems[1].port", "int"), ("severity", "incident.severity", "string"), ("ja3_hash", "indicators.ja3_hash", "string"), ("ml_score", "indicators.ml_score", "double"),
              ("detected", "incident.detection_timestamp", "string"), ("reported", "incident.reporting_timestamp", "string"), ("organization", "reporting_entity.organization", "string"))],
          F.array_join(F.from_json(F.get_json_object("j", "$.indicators.threat_intel_hits"), "array<string>"), ",").alias("hits"),
          F.array_join(F.from_json(F.get_json_object("j", "$.indicators.reasons"), "array<string>"), ";").alias("reasons")))
named("alert_text", "SELECT id, concat('[', severity, '] flowlens: ', attack_type, ' from ', src_ip) AS mail_subject, concat('[', severity, '] ', attack_type) AS chat_title, array_to_string(list_transform((" + _RS + ")[1:5], lambda r: concat('- ', r)), chr(10)) AS chat_evidence FROM alerts",
      lambda spark, sf: O.alert_text(reasoned(spark, sf)).select("id", "mail_subject", "chat_title", "chat_evidence"))
named("json_lists", "SELECT id, CASE WHEN id % 4 = 0 THEN 0 ELSE 2 END AS n FROM alerts",
      lambda spark, sf: alerts(spark, sf).select("id", F.size(O.json_lists(F.when(F.col("id") % 4 == 0, F.lit("not json")).otherwise(F.concat(F.lit('["x","'), "src_ip", F.lit('"]'))))).alias("n")))
named("route_alerts", "SELECT severity, channel, count(*) AS n FROM (SELECT severity, unnest(CASE severity WHEN 'CRITICAL' THEN ['slack', 'syslog'] WHEN 'HIGH' THEN ['slack', 'syslog'] WHEN 'MEDIUM' THEN ['syslog'] ELSE [] END) AS channel FROM alerts) GROUP BY 1, 2",
      lambda spark, sf: A.agg_alert_stats(O.route_alerts(alerts(spark, sf), enabled=["slack", "syslog"])))

# ── the whole cascade ────────────────────────────────────────────────────────
_sub = {**GATE, **POL, **PDX, **{k: v for k, v in ZX.items()},
        "gatn": GATE["gat"],
        "cin": f"""SELECT g.flow_id, g.gate_action, g.gate_severity, g.gate_attack, CAST(g.ti_boost AS DOUBLE) AS ti_boost, g.ti_severity, CAST(g.eta_pure AS DOUBLE) AS eta_pure, g.n_anom, s.p, s.family, g.src_ip, g.dst_ip, g.dst_port, g.t_us FROM gatn g JOIN scored s USING (flow_id) WHERE g.src_ip NOT IN (SELECT ip FROM rwl) AND g.dst_ip NOT IN (SELECT ip FROM rwl)""",
        "rwl": "SELECT '93.184.5.6' AS ip"}


# one external address sends every 23rd flow of the cascade's input
_AWAY = "CASE WHEN flow_id % 23 = 0 THEN '93.184.0.1' ELSE src_ip END"
_HOME = "(SELECT * FROM c2 WHERE NOT starts_with(src_ip, '93.184.'))"


def cascade_alerts(spark, sf):
    # events are dealt evenly and worked out once: few files must not mean few tasks, and no layer or table parses them again
    own = cut(tls_flows(spark, sf, parts=int(spark.conf.get("spark.sql.shuffle.partitions"))), "flows")
    f = own.withColumns({"ts": F.timestamp_micros(F.lit(START_US) + F.col("t_us")), "src_ip": F.expr(_AWAY)})

    def table(text):
        """Written first, so that Spark knows its size: flows are dealt by its keys only where it is large."""
        return cut(dim(spark, sf, text, own), "dim")

    ja3 = table(BAD_JA3)
    dims = {"devices": table(KNOWN), "bad_ips": table(BAD_IPS), "bad_ja3": ja3.filter("ja3 <> ''"), "bad_ja3_names": ja3,
            "bad_domains": table(BAD_DOM), "allowed": allowed(spark), "runtime_whitelist": J.frame(spark, [("93.184.5.6",)], "ip string"),
            "whitelist": {"ports": [123]}, "suppressions": table(SUPP), "peer_baseline": cut(peer_baseline(spark, sf, own), "dim"),
            "fp_patterns": J.frame(spark, PATS, "id int, attack_type string, src_pattern string, dst_pattern string, dst_port int, confidence double")}
    return cascade(f, dims, probability=S.score_stage1(["p1", "p2", "p3"]))


# Oracle: the same layers in SQL. The run has no fingerprint-pair columns and no whitelist rows.
CASX = {"xflows": f"SELECT * REPLACE ({_AWAY} AS src_ip) FROM flows", "xtls": f"SELECT * REPLACE ({_AWAY} AS src_ip) FROM tls",
        **{k: re.sub(r"\b(FROM|JOIN) (flows|tls)\b( [a-z]+)?", lambda m: f"{m[1]} x{m[2]}{m[3] or ' ' + m[2]}", v) for k, v in {**HITS, **ETA, **IDENT}.items()}, **PEERX,
        "rwl": "SELECT '93.184.5.6' AS ip",
        "c0": "SELECT e.*, h.m, h.best_severity, CASE WHEN best_type = 'ip' THEN dc WHEN best_type = 'ja3' THEN jc ELSE 'malware_distribution' END AS best_cat, h.dc FROM eta e JOIN (SELECT flow_id, m, best_severity, best_type, dc, jc FROM hits) h USING (flow_id) WHERE e.src_ip NOT IN (SELECT ip FROM rwl) AND e.dst_ip NOT IN (SELECT ip FROM rwl)",
        "now": "SELECT flow_id, t_us, src_ip, dst_ip, dst_port, best_severity AS severity, 'INTEL_GATE' AS tag, best_cat AS attack_type FROM c0 WHERE m >= 3",
        "c1": f"""SELECT c0.* EXCLUDE (p1), i.department, i.device_type, round((SELECT 1), 0) AS one, s.p, CASE WHEN m > 0 THEN 0.15 ELSE 0 END AS ti_boost, CASE WHEN m > 0 THEN best_severity ELSE '' END AS ti_severity, CASE WHEN n_anom > 0 AND eta_score > 0 THEN least(n_anom * 0.1, 0.25) ELSE 0 END AS eta_pure
 FROM c0 JOIN ident i USING (flow_id) JOIN (SELECT flow_id, p FROM scored) s USING (flow_id) WHERE m < 3""",
        "c2": f"""SELECT *, p >= 0.04 OR p + least(ti_boost + eta_pure, 0.5) > 0.5 AS is_attack, p AS ml_score, CASE WHEN p >= 0.04 THEN {ladder_sql('p', 'cascade')} WHEN p + least(ti_boost + eta_pure, 0.5) > 0.5 THEN 'MEDIUM' ELSE 'BENIGN' END AS ml_severity,
 CASE WHEN p >= 0.04 THEN family WHEN p + least(ti_boost + eta_pure, 0.5) > 0.5 THEN 'TLS_Suspicious' ELSE 'BENIGN' END AS ml_type FROM c1""",
        "pol0": "SELECT c2.*, fwd_bytes AS fb, CASE WHEN dc IS NOT NULL THEN dc END AS dcat FROM c2",
        "pol1": POL["pol1"].replace("t_us * 3600", "t_us"), **{k: POL[k] for k in ("pol2", "pol3", "pol4", "pol5", "pol", "polr")},
        "um": ZX["um"].replace("FROM flows", f"FROM {_HOME} c2").replace(f"{__import__('flowlens.plans.q_windows', fromlist=['DEPT_SQL']).DEPT_SQL} AS department", "department"),
        **{k: ZX[k] for k in ("z1", "z2", "z3", "z4", "zz")},
        "em2": EM_SQL.replace("FROM flows", f"FROM {_HOME} c2"),
        "pzz": "SELECT em2.flow_id, p.mean_fpm IS NOT NULL AND fpm IS NOT NULL AS known, em2.send_ratio, " + ", ".join(f"{_z(m)} AS z_{m}" for m in A.PEER) + " FROM em2 LEFT JOIN (SELECT * FROM peerm WHERE is_ready) p USING (department)",
        "pdv": PDX["pdev"].replace("FROM pz", "FROM pzz"),
        "sg": f"""SELECT p.flow_id, p.violation, p.policy_severity, p.policy_category, coalesce(abs(zz.max_z) >= 3, false) AS ueba_alert, {ladder_sql('abs(zz.max_z)', 'zscore')} AS ueba_severity, p.is_attack, p.ml_score, p.ml_severity, 0.0 AS rule_score, p.ti_boost, p.ti_severity, p.eta_pure, p.n_anom AS eta_anomaly_count, coalesce(pdv.peer_score, 0) AS peer_score
 FROM polr p LEFT JOIN zz USING (flow_id) LEFT JOIN pdv USING (flow_id)""",
        "fu": fuse_sql("sg"),
        "al": "SELECT fu.flow_id, c2.t_us, c2.src_ip, c2.dst_ip, c2.dst_port, fu.severity, fu.tag, c2.ml_type AS attack_type FROM fu JOIN c2 USING (flow_id) UNION ALL SELECT * FROM now",
        "al2": "SELECT * FROM al a WHERE NOT EXISTS (SELECT 1 FROM supp s WHERE s.src_ip = a.src_ip AND s.attack_type = a.attack_type AND s.expires_us > a.t_us)",
        "pats": PAT_SQL,
        "fpa": "SELECT a.flow_id, min_by(CASE WHEN conf >= 0.8 THEN 'suppress' ELSE 'downgrade' END, pid) AS act FROM al2 a JOIN pats ON conf >= 0.5 AND (pa = '' OR pa = attack_type) AND (pp = 0 OR pp = dst_port) AND starts_with(src_ip, rtrim(ps, '*')) AND starts_with(dst_ip, rtrim(pd, '*')) GROUP BY 1"}
named("cascade_batch", "SELECT flow_id, tag, CASE WHEN act = 'downgrade' THEN 'LOW' ELSE severity END AS severity, CASE WHEN act = 'downgrade' THEN 'Other' ELSE attack_type END AS attack_type FROM al2 LEFT JOIN fpa USING (flow_id) WHERE act IS DISTINCT FROM 'suppress'",
      lambda spark, sf: cascade_alerts(spark, sf).select("flow_id", "tag", "severity", "attack_type"), extra=CASX)
named("build_alert", "SELECT tag, severity, count(*) AS n FROM (SELECT tag, CASE WHEN act = 'downgrade' THEN 'LOW' ELSE severity END AS severity FROM al2 LEFT JOIN fpa USING (flow_id) WHERE act IS DISTINCT FROM 'suppress') GROUP BY 1, 2",
      lambda spark, sf: cascade_alerts(spark, sf).groupBy("tag", "severity").agg(F.count(F.lit(1)).alias("n")), extra=CASX)
named("log_scoring", f"SELECT h.flow_id, s.p, CASE WHEN s.p < 0.04 THEN 'benign' ELSE 'attack' END AS label, h.host_flow_count_60s, c.flag_entropy FROM ({HOST_SQL}) h JOIN scored s USING (flow_id) JOIN ({CANON_SQL}) c USING (flow_id)",
      lambda spark, sf: scored_features(flows(spark, sf)).select("flow_id", "p", "label", "host_flow_count_60s", "flag_entropy"))
