"""Queries: aggregations, reports, tops and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens import values as V
from flowlens.operators import aggregates as A, features as X, joins as J, setops as So, windows as Wn
from flowlens.plans.flowview import START_US, alerts, flows, scored, tls_flows, with_views
from flowlens.plans.q_features import _RK, casemap, inlist
from flowlens.plans.q_joins import BAD_IPS, DIMS, ENRICH, dim, enriched, triage
from flowlens.plans.q_windows import (DEPT_SQL, EMX, TS, ZX, _RISKX, pushes, recursive, risk_rows, with_dept)
from flowlens.plans.registry import query, sql_round
from flowlens.session import cut

SEV = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
SEVN = "['BENIGN','LOW','MEDIUM','HIGH','CRITICAL']"
_sev = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in SEV)


def vw(sql, **kw):
    return with_views(sql, extra={**DIMS, **kw.pop("extra", {})}, **kw)


def named(name, sql, fn, **kw):
    query(name, vw(sql, **kw) if sql else None)(fn)


# ── peers ────────────────────────────────────────────────────────────────────
PEERX = {**EMX, "pd": f"SELECT *, {DEPT_SQL} AS department FROM push",
         "pk": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY department ORDER BY t_us DESC, flow_id DESC) AS r FROM pd) WHERE r <= 50",
         "peer": "SELECT department, count(*) AS n_samples, " + ", ".join(f"avg({c}) AS mean_{c}, greatest(stddev_pop({c}), 0.01) AS std_{c}" for c in A.PEER)
                 + " FROM pk GROUP BY 1 HAVING count(*) >= 3",
         "peerm": "SELECT peer.*, members, n_samples >= 10 AND members >= 2 AS is_ready FROM peer JOIN (SELECT department, count(DISTINCT src_ip) AS members FROM pd GROUP BY 1) USING (department)"}


def peer_baseline(spark, sf, f=None):
    return A.agg_peer_baseline(cut(with_dept(pushes(spark, sf, f)), "pushes"), last=50)


named("agg_peer_baseline", "SELECT department, n_samples, members, CAST(is_ready AS INT) AS is_ready, " + sql_round({f"{k}_{c}": f"{k}_{c}" for k in ("mean", "std") for c in A.PEER}) + " FROM peerm",
      lambda spark, sf: peer_baseline(spark, sf).withColumn("is_ready", F.col("is_ready").cast("int")), extra=PEERX)
_held = " UNION ALL ".join(f"SELECT DISTINCT pd.flow_id, department, '{c}' AS kind, f.{c} AS value FROM pd JOIN flows f ON f.src_ip = pd.src_ip AND f.t_us > pd.t_us - 60000000 AND (f.t_us < pd.t_us OR (f.t_us = pd.t_us AND f.flow_id <= pd.flow_id)) WHERE f.{c} > 0" for c in ("dst_port", "protocol"))


def group_norms(spark, sf):
    samples, f = with_dept(pushes(spark, sf)), flows(spark, sf)
    norms = [A.agg_group_norms(samples, Wn.window_values(f, samples, c, bucket_us=90_000_000), top=4).withColumn("kind", F.lit(c)).withColumn("value", F.col("value").cast("long")) for c in ("dst_port", "protocol")]
    return norms[0].unionByName(norms[1]).withColumn("rank", F.col("rank").cast("long"))


named("agg_group_norms", f"SELECT * FROM (SELECT department, kind, CAST(value AS BIGINT) AS value, n, row_number() OVER (PARTITION BY department, kind ORDER BY n DESC, value) AS rank FROM (SELECT department, kind, value, count(*) AS n FROM ({_held}) GROUP BY ALL)) WHERE rank <= 4",
      group_norms, extra=PEERX)

# ── baselines ────────────────────────────────────────────────────────────────
_wf = lambda ent, typ: " UNION ALL ".join(
    f"SELECT '{typ}' AS entity_type, {ent} AS entity, min(t_us) AS first_us, max(t_us) AS last_us, '{m}' AS metric, count({m}) AS n, avg({m}) AS mean, var_pop({m}) * count({m}) AS m2 FROM um GROUP BY {ent}" for m in V.UEBA_METRICS)
WFX = {"um": ZX["um"], "wdev": _wf("src_ip", "device"), "wdep": _wf("department", "department")}


def metrics(spark, sf):
    return flows(spark, sf).transform(with_dept).transform(X.ueba_metrics)


def spread(base):
    """Compare the deviation, not the squared sum, whose size would outgrow six decimals."""
    return base.withColumn("spread", F.sqrt(F.col("m2") / F.col("n"))).drop("m2")


def device_baseline(spark, sf):
    return A.agg_welford(metrics(spark, sf), entity="src_ip", entity_type="device")


named("agg_welford", f"SELECT entity_type, entity, metric, n, first_us, last_us, {sql_round({'mean': 'mean', 'spread': 'sqrt(m2 / n)'})} FROM wdev", lambda spark, sf: spread(device_baseline(spark, sf)), extra=WFX)


@query("udaf_welford_merge", vw(f"SELECT entity_type, entity, metric, n, first_us, last_us, {sql_round({'mean': 'mean', 'spread': 'sqrt(m2 / n)'})} FROM wdep", extra=WFX))
def _(spark, sf):
    m = metrics(spark, sf)
    parts = [A.agg_welford(m.filter(F.pmod("t_us", F.lit(3)) == i), entity="department", entity_type="department") for i in range(3)]
    return spread(A.merge_welford(*parts))


_dr = ", ".join(f"round(max(mean) FILTER (metric = '{m}'), 6) + 0.0 AS {m}_mean, round(max(CASE WHEN n > 1 THEN sqrt(m2/n) ELSE 0 END) FILTER (metric = '{m}'), 6) + 0.0 AS {m}_stdev_pop" for m in V.UEBA_METRICS)
named("agg_device_report", f"""SELECT entity, max(n) AS total_flows, min(first_us) AS first_us, max(last_us) AS last_us, {_dr}, round((max(last_us) - min(first_us))/1e6, 6) + 0.0 AS observed_seconds,
 round(round(least(100.0, (max(last_us) - min(first_us))/1e6*100.0/1209600), 1), 6) + 0.0 AS coverage_pct, round(any_value(sp), 6) + 0.0 AS dataset_span_seconds FROM wdev, (SELECT greatest((max(last_us) - min(first_us))/1e6, 1.0) AS sp FROM wdev) GROUP BY entity""",
      lambda spark, sf: A.agg_device_report(device_baseline(spark, sf)), extra=WFX)
named("agg_dept_baselines", f"SELECT department, metric, n, {sql_round({'mean': 'mean', 'std': 'CASE WHEN n >= 2 THEN sqrt(m2/(n-1)) ELSE 0 END'})}, CAST(bool_and(n >= 30) OVER (PARTITION BY department) AS INT) AS mature FROM (SELECT entity AS department, * FROM wdep)",
      lambda spark, sf: A.agg_dept_baselines(A.agg_welford(metrics(spark, sf), entity="department", entity_type="department")).withColumn("mature", F.col("mature").cast("int")), extra=WFX)

# ── devices and domains ──────────────────────────────────────────────────────
_MACS = "CASE flow_id % 4 WHEN 0 THEN '3C:07:54:00:00:01' WHEN 1 THEN 'B8-27-EB-11-22-33' ELSE '' END"
_DH = "CASE WHEN flow_id % 50 = 0 THEN '1,3,6,15,119,252' ELSE '' END"
_pc = "CASE port " + " ".join(f"WHEN {p} THEN '{c}'" for p, (c, _) in V.PORT_EVIDENCE.items()) + " END"
_pw = "CASE port " + " ".join(f"WHEN {p} THEN {w}" for p, (_, w) in V.PORT_EVIDENCE.items()) + " END"
DEVX = {"ends": f"SELECT dst_ip AS ip, t_us, dst_port AS port, CASE WHEN flow_id % 4 = 1 THEN 'B8-27-EB-11-22-33' ELSE '' END AS mac, ja3, {_DH} AS dhcp FROM flows WHERE dst_ip LIKE '192.168.%' UNION ALL SELECT src_ip, t_us, NULL, {_MACS}, ja3, {_DH} FROM flows",
        "votes": f"""SELECT DISTINCT ip, {_pc} AS cls, {_pw} AS w, concat('port:', port) AS sig FROM ends WHERE {_pc} IS NOT NULL
 UNION SELECT DISTINCT ip, CASE WHEN mac LIKE '3C%' THEN 'laptop' ELSE 'server' END, 0.55, mac FROM ends WHERE mac <> '' UNION SELECT DISTINCT ip, 'laptop', 0.10, 'ja3' FROM ends WHERE ja3 <> ''
 UNION SELECT DISTINCT ip, 'personal_mobile', 0.75, dhcp FROM ends WHERE dhcp <> ''""",
        "cls": "SELECT ip, cls, sum(CAST(w AS DOUBLE)) AS w FROM votes WHERE cls <> 'unknown' GROUP BY 1, 2",
        "scores": "SELECT ip, string_agg(cls || '=' || CAST(round(w * 10000) AS BIGINT), ';' ORDER BY cls) AS scores FROM (SELECT ip, cls, sum(CAST(w AS DOUBLE)) AS w FROM votes GROUP BY 1, 2) GROUP BY 1",
        "best": "SELECT ip, max_by(cls, struct_pack(w := round(w, 9), c := cls)) AS device_class, max(w) / sum(w) AS confidence FROM cls GROUP BY 1"}


def evidence(spark, sf):
    # half of the hardware addresses are the flow's, half of the DHCP lists stand in the other column
    f = flows(spark, sf).withColumns({"src_mac": F.expr(f"IF(flow_id % 4 = 0, {_MACS}, '')"), "mac": F.expr(f"IF(flow_id % 4 = 1, {_MACS}, NULL)"),
                                      "dhcp_option_55": F.expr(f"IF(flow_id % 100 = 0, {_DH}, '')"), "dhcp_fp": F.expr(f"IF(flow_id % 100 = 50, {_DH}, '')")})
    return A.agg_device_evidence(f)


@query("agg_device_evidence", vw("""SELECT ip, coalesce(device_class, 'unknown') AS device_class, round(round(coalesce(confidence, 0), 4), 6) + 0.0 AS confidence, flow_count, first_us, last_us, n_ports, coalesce(scores, '') AS scores
 FROM (SELECT ip, count(*) AS flow_count, min(t_us) AS first_us, max(t_us) AS last_us, count(DISTINCT CASE WHEN """ + _pc + """ IS NOT NULL THEN port END) AS n_ports FROM ends GROUP BY 1) LEFT JOIN best USING (ip) LEFT JOIN scores USING (ip)""", extra=DEVX))
def _(spark, sf):
    return evidence(spark, sf).withColumn("n_ports", F.coalesce(F.size(F.map_keys("observed_ports")), F.lit(0)).cast("long")).withColumn(
        "scores", F.coalesce(F.array_join(F.transform(F.map_entries("class_scores"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 10000).cast("long").cast("string"))), ";"), F.lit(""))).drop(
        "class_scores", "observed_ports")


OBSX = {"obs": f"""SELECT array_to_string(string_split(sni, '.')[-2:], '.') AS domain, count(DISTINCT src_ip) AS distinct_hosts, count(*) AS total_queries, min(t_us) AS first_us, max(t_us) AS last_us,
 count(DISTINCT CAST({TS} AS DATE)) AS days_seen FROM flows WHERE sni <> '' AND len(string_split(sni, '.')) >= 2 GROUP BY 1"""}


def observations(spark, sf):
    f = flows(spark, sf, 1).withColumn("ts", F.timestamp_micros(F.col("t_us") + F.lit(START_US)))
    return A.agg_domain_observations(f)


_us = lambda c: (F.unix_micros(c) - F.lit(START_US))
named("agg_domain_observations", "SELECT * FROM obs", lambda spark, sf: observations(spark, sf).select(
    "domain", "distinct_hosts", "total_queries", _us("first_seen").alias("first_us"), _us("last_seen").alias("last_us"), "days_seen"), compress=1, extra=OBSX)
_LEARN = [("google.com",), ("evil.test",)]
for _nm, _lrn in (("agg_promote_domains", None), ("anti_already_promoted", _LEARN)):
    named(_nm, "SELECT domain, distinct_hosts, days_seen, total_queries FROM obs WHERE distinct_hosts >= 3 AND days_seen >= 3 AND total_queries >= 10" + ("" if _lrn is None else " AND domain NOT IN ('google.com', 'evil.test')"),
          lambda spark, sf, lrn=_lrn: A.agg_promote_domains(observations(spark, sf), None if lrn is None else J.frame(spark, lrn, "domain string")).select("domain", "distinct_hosts", "days_seen", "total_queries"), compress=1, extra=OBSX)

_pat = lambda c: f"CASE WHEN {c} LIKE '192.168.%' THEN concat(string_split({c}, '.')[1], '.', string_split({c}, '.')[2], '.', string_split({c}, '.')[3], '.*') ELSE concat(string_split({c}, '.')[1], '.', string_split({c}, '.')[2], '.*') END"
FPXX = {"fpp": f"""SELECT attack_type, {_pat('src_ip')} AS src_pattern, {_pat('dst_ip')} AS dst_pattern, dst_port, count(*) FILTER (verdict = 'FP') AS learned_from_n, count(*) FILTER (verdict = 'TP') AS tp
 FROM alerts WHERE verdict IN ('TP', 'FP') GROUP BY 1, 2, 3, 4"""}


def fp_patterns(spark, sf, allow=False):
    return A.agg_learn_fp(J.join_triage(alerts(spark, sf), triage(spark, sf)), allow_tp=allow)


named("agg_learn_fp", "SELECT attack_type, src_pattern, dst_pattern, dst_port, learned_from_n, tp, round(learned_from_n / (learned_from_n + tp), 6) + 0.0 AS confidence FROM fpp WHERE tp = 0 AND learned_from_n > 0", lambda spark, sf: fp_patterns(spark, sf), extra=FPXX)
named("top_fp_patterns", "SELECT attack_type, src_pattern, dst_pattern, dst_port, learned_from_n, tp, round(learned_from_n / (learned_from_n + tp), 6) + 0.0 AS confidence FROM fpp WHERE learned_from_n > 0 ORDER BY learned_from_n DESC, learned_from_n / (learned_from_n + tp) DESC, 1, 2, 3, 4 LIMIT 10",
      lambda spark, sf: A.top_fp_patterns(fp_patterns(spark, sf, True)), extra=FPXX)

# ── alert reports ────────────────────────────────────────────────────────────
_sc = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}_count" for s in SEV)
BEN = {"benign": "SELECT * REPLACE (CASE WHEN id % 13 = 0 THEN 'benign-gated' ELSE '' END AS verdict, CASE WHEN id % 29 = 0 THEN 'BENIGN' ELSE attack_type END AS attack_type) FROM alerts"}


def with_benign(spark, sf):
    return alerts(spark, sf).withColumns({"verdict": F.when(F.col("id") % 13 == 0, "benign-gated").otherwise(""),
                                          "attack_type": F.when(F.col("id") % 29 == 0, "BENIGN").otherwise(F.col("attack_type"))})


_nb = "NOT (verdict LIKE 'benign-%' OR attack_type = 'BENIGN')"
named("agg_severity_counts", f"SELECT count(*) AS total_alerts, {', '.join(f'count(*) FILTER (severity = {chr(39)}{s}{chr(39)} AND {_nb}) AS {s.lower()}_count' for s in SEV)}, count(*) FILTER (NOT ({_nb})) AS benign_count, (SELECT count(*) FROM dev) AS total_devices FROM benign",
      lambda spark, sf: A.agg_severity_counts(with_benign(spark, sf), dim(spark, sf, DIMS["dev"])), extra=BEN)
named("agg_dept_rollup", f"SELECT department, count(*) AS device_count, sum(alert_count)::BIGINT AS alert_count, round(max(risk_score), 6) + 0.0 AS risk_score, min(CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 99 END) AS priority_rank FROM (SELECT * REPLACE (CASE WHEN department = '' THEN 'Unmapped' ELSE department END AS department) FROM enr) GROUP BY 1",
      lambda spark, sf: A.agg_dept_rollup(enriched(spark, sf)), extra={"enr": ENRICH})
named("agg_hour_severity", f"SELECT CAST(h AS INT) AS hour, {', '.join(f'coalesce({s.lower()}, 0) AS {s.lower()}' for s in SEV)} FROM range(24) r(h) LEFT JOIN (SELECT hour(ts) AS h, {_sev} FROM alerts GROUP BY 1) USING (h)",
      lambda spark, sf: A.agg_hour_severity(alerts(spark, sf, 1)), compress=1)
named("agg_timeseries", f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS bucket, {_sev} FROM alerts GROUP BY 1",
      lambda spark, sf: A.agg_timeseries(alerts(spark, sf, 1)).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH")), compress=1)
named("agg_range_summary", f"SELECT count(*) AS total, {_sev}, count(DISTINCT src_ip) AS unique_src_ips FROM alerts", lambda spark, sf: A.agg_range_summary(alerts(spark, sf)))
_RULE = "CASE id % 3 WHEN 0 THEN 'Rule: Port Sweep' WHEN 1 THEN 'Rule:DNS Tunneling Suspected' ELSE 'Rule:  ' END"
named("agg_rule_stats", f"""SELECT rule_name, fires, last_us, unique_src_ips, unique_dst_ips, correlated, worst_severity, row_number() OVER (ORDER BY rule_name) AS rule_id FROM (SELECT trim(replace(r, 'Rule:', '')) AS rule_name, count(*) AS fires, max(t_us) AS last_us,
 count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips, count(*) FILTER (id % 2 = 0) AS correlated, {SEVN}[max({_RK}) + 1] AS worst_severity
 FROM (SELECT *, unnest(CASE WHEN id % 5 = 0 THEN [{_RULE}, 'Rule: Horizontal Scan'] ELSE [{_RULE}] END) AS r FROM alerts) WHERE trim(replace(r, 'Rule:', '')) <> '' GROUP BY 1)""",
      lambda spark, sf: A.agg_rule_stats(alerts(spark, sf).withColumns({"rule_names": F.expr(f"CASE WHEN id % 5 = 0 THEN array({_RULE}, 'Rule: Horizontal Scan') ELSE array({_RULE}) END"), "correlated": F.col("id") % 2 == 0}))
      .withColumn("last_us", _us("last_fired")).drop("last_fired"))
_oth = lambda i: "CASE dst_port " + " ".join(f"WHEN {p} THEN '{v[i]}'" for p, v in V.OTHER_BY_PORT.items()) + f" ELSE '{V.OTHER_DEFAULT[i]}' END"
TACX = {**BEN, "td": "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{i}', {o}, {1 if t in V.TACTICS_COVERED else 0})" for t, i, o in V.TACTIC_META) + ") t(tactic, tactic_id, ord, covered)",
        "tg": f"SELECT CASE WHEN attack_type = 'Other' THEN {_oth(0)} ELSE {casemap('attack_type', V.FAMILY_TACTIC, chr(39) + 'Unclassified' + chr(39))} END AS tactic, CASE WHEN attack_type = 'Other' THEN {_oth(1)} ELSE attack_type END AS family, count(*) AS n FROM benign WHERE {_nb} GROUP BY 1, 2"}
named("agg_tactic_distribution", "SELECT tactic, tactic_id, ord, covered, coalesce(family, '') AS family, coalesce(n, 0) AS n FROM td LEFT JOIN tg USING (tactic)",
      lambda spark, sf: A.agg_tactic_distribution(with_benign(spark, sf)).withColumn("covered", F.col("covered").cast("int")), extra=TACX)
_tm = ", ".join(f"('{k}', '{t}')" for k, ts in V.ATTACK_TACTICS.items() for t in ts)
named("agg_tactic_multi", f"""SELECT ord, tactic_id, tactic, coalesce(n, 0) AS n FROM (VALUES {', '.join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(V.TACTICS))}) d(ord, tactic_id, tactic)
 LEFT JOIN (SELECT tid AS tactic_id, count(*) AS n FROM alerts JOIN (VALUES {_tm}) m(k, tid) ON k = attack_type GROUP BY 1) USING (tactic_id)""", lambda spark, sf: A.agg_tactic_multi(alerts(spark, sf)))
named("agg_score_histogram", "SELECT CAST(b AS INT) AS bin, round(round(b / 20.0, 3), 6) + 0.0 AS lower_edge, coalesce(n, 0) AS n FROM range(20) r(b) LEFT JOIN (SELECT CAST(least(floor(ml_score * 20), 19) AS BIGINT) AS b, count(*) AS n FROM alerts GROUP BY 1) USING (b)",
      lambda spark, sf: A.agg_score_histogram(alerts(spark, sf)))
ENT = f"""SELECT src_ip AS ip, count(*) AS total_flows, CAST(floor(avg(p) * 120) AS DOUBLE) AS risk_score, count(*) >= 60 AS baseline_ready, CAST(count(*) % 4 AS INT) - 1 AS peer_group_id,
 CASE WHEN src_ip LIKE '192.168.10.%' THEN 'IT' WHEN src_ip LIKE '192.168.20.%' THEN 'Finance' ELSE 'Rest' END AS department FROM scored GROUP BY src_ip"""


def entities(spark, sf):
    s = scored(spark, sf)
    return spark.sql(ENT.replace("FROM scored", "FROM {s}"), s=s)


_es = "count(*) AS entities, count(*) FILTER (baseline_ready) AS ready, count(*) FILTER (risk_score >= 65) AS high_risk, count(*) FILTER (risk_score >= 80) AS critical_risk, max(risk_score) AS max_risk, sum(total_flows)::BIGINT AS total_flows, round(avg(risk_score), 6) + 0.0 AS avg_risk"
named("agg_entity_stats", f"SELECT department, {_es} FROM ent GROUP BY 1 UNION ALL SELECT '*', {_es} FROM ent", lambda spark, sf: A.agg_entity_stats(entities(spark, sf)), extra={"ent": ENT})
named("agg_peer_group_summary", "SELECT peer_group_id, department, count(*) AS member_count, round(avg(risk_score), 6) + 0.0 AS avg_risk, max(risk_score) AS max_risk FROM ent WHERE peer_group_id >= 0 GROUP BY 1, 2",
      lambda spark, sf: A.agg_peer_group_summary(entities(spark, sf)), extra={"ent": ENT})
named("high_risk_entities", "SELECT ip, department, risk_score FROM ent WHERE risk_score >= 60 ORDER BY risk_score DESC, ip LIMIT 25",
      lambda spark, sf: A.high_risk_entities(entities(spark, sf), min_risk=60, n=25).select("ip", "department", "risk_score"), extra={"ent": ENT})
named("agg_engine_contribution", "SELECT count(*) FILTER (m AND u AND r) AS combined, count(*) FILTER (m AND NOT u AND NOT r) AS ml_only, count(*) FILTER (u AND NOT m) AS ueba_only, count(*) FILTER (r AND NOT m AND NOT u) AS rule_only FROM (SELECT ml_score >= 0.5 AS m, ueba_score >= 0.65 AS u, eta_score >= 0.65 AS r FROM alerts)",
      lambda spark, sf: A.agg_engine_contribution(alerts(spark, sf).withColumn("rule_score", F.col("eta_score"))))
INCX = {"inc": f"SELECT src_ip, time_bucket(INTERVAL 1 HOUR, ts) AS o, count(*) AS alert_count, {SEVN}[max({_RK}) + 1] AS severity, min(id) AS first_alert_id, max(id) AS last_alert_id, count(DISTINCT attack_type) AS attack_types FROM alerts GROUP BY 1, 2"}
named("agg_incidents", "SELECT src_ip, strftime(o, '%Y-%m-%d %H') AS opened, alert_count, severity, first_alert_id, last_alert_id, attack_types, 'open' AS status, concat('Alerts from ', src_ip) AS title FROM inc",
      lambda spark, sf: A.agg_incidents(alerts(spark, sf, 1))[0].withColumn("opened", F.date_format("opened_at", "yyyy-MM-dd HH")).drop("incident_id", "opened_at"), compress=1, extra=INCX)

# ── model quality ────────────────────────────────────────────────────────────
_PF = ["duration", "fwd_bytes", "bwd_bytes", "p1"]
_edges = ", ".join(str(e) for e in V.NORMAL_DECILES)
_pz = " UNION ALL ".join(f"SELECT '{c}' AS feature, ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z FROM flows" for c in _PF)
PSIX = {"pz": _pz, "pb": f"SELECT feature, len(list_filter([{_edges}], lambda e: e <= z)) AS b FROM pz", "pn": "SELECT feature, count(*) AS n FROM pb GROUP BY 1",
        "pa": "SELECT pn.feature, pn.n, i, greatest(count(pb.b) / pn.n, 1e-6) AS a FROM pn CROSS JOIN range(10) r(i) LEFT JOIN pb ON pb.feature = pn.feature AND pb.b = i GROUP BY 1, 2, 3",
        "psi": "SELECT feature, n, sum((a - 0.1) * ln(a / 0.1)) AS psi FROM pa GROUP BY 1, 2"}


def psi(spark, sf):
    f = flows(spark, sf)
    return A.agg_psi(f, stats=X.scale_stats(f, _PF), min_rows=100)


named("agg_psi", "SELECT feature, n, round(psi, 6) + 0.0 AS psi, CAST(psi > 0.2 AS INT) AS drifted FROM psi", lambda spark, sf: psi(spark, sf).withColumn("drifted", F.col("drifted").cast("int")), extra=PSIX)
named("top_drifted", "SELECT feature, round(psi, 6) + 0.0 AS psi FROM psi WHERE psi > 0.2 ORDER BY psi DESC, feature LIMIT 2", lambda spark, sf: A.top_drifted(psi(spark, sf), n=2).select("feature", "psi"), extra=PSIX)
LBX = {"lb": "SELECT *, CASE WHEN p1 + p2 > 1.2 THEN 1 ELSE 0 END AS label, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS predicted FROM scored",
       "l20": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY t_us DESC, flow_id DESC) AS r FROM lb) WHERE r <= 20"}


def labelled(spark, sf):
    return scored(spark, sf).withColumns({"label": F.when(F.col("p1") + F.col("p2") > 1.2, 1).otherwise(0), "predicted": F.when(F.col("p") >= 0.5, 1).otherwise(0)})


_bm = "count(*) FILTER (predicted = 1 AND label = 1) AS tp, count(*) FILTER (predicted = 1 AND label = 0) AS fp, count(*) FILTER (predicted = 0 AND label = 1) AS fn"
_bmx = sql_round({"precision": "tp / greatest(tp + fp, 1)", "recall": "tp / greatest(tp + fn, 1)", "f1": "2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-9)"})
named("agg_binary_metrics", f"SELECT family, tp, fp, fn, {_bmx} FROM (SELECT family, {_bm} FROM lb GROUP BY 1)", lambda spark, sf: A.agg_binary_metrics(labelled(spark, sf), keys=["family"]), extra=LBX)
named("sample_last_n_per_source", "SELECT family, flow_id FROM l20", lambda spark, sf: A.newest_per(labelled(spark, sf), "family", 20, [F.col("t_us").desc(), F.col("flow_id").desc()]).select("family", "flow_id"), extra=LBX)
named("agg_latency_percentiles", "SELECT " + sql_round({"p50": "quantile_cont(duration, 0.5)", "p95": "quantile_cont(duration, 0.95)", "p99": "quantile_cont(duration, 0.99)", "max": "max(duration)", "mean": "avg(duration)"}) + " FROM flows",
      lambda spark, sf: A.agg_latency_percentiles(flows(spark, sf), column="duration"))
named("agg_class_weights", f"SELECT family, n, round(t / (k * n), 6) + 0.0 AS class_weight, CAST(round(t / (k * (t / (k * n)))) AS BIGINT) AS implied_count, {casemap('family', V.FAMILY_TACTIC, chr(39) + 'Unclassified' + chr(39))} AS tactic FROM (SELECT family, count(*) AS n FROM flows GROUP BY 1), (SELECT count(*) AS t, count(DISTINCT family) AS k FROM flows)",
      lambda spark, sf: A.agg_class_weights(flows(spark, sf)))
_SRC = "CASE flow_id % 5 WHEN 0 THEN 'CTU-IoT' WHEN 1 THEN 'ctu-iot' WHEN 2 THEN 'MAWI-heldout' WHEN 3 THEN 'UGR16' ELSE 'CTU-13' END"
_al = "CASE s WHEN 'CTU-IoT' THEN 'CTU-IoT-23' WHEN 'ctu-iot' THEN 'CTU-IoT-23' WHEN 'MAWI-heldout' THEN 'MAWI' WHEN 'UGR16' THEN 'UGR-16' ELSE s END"
named("agg_training_composition", f"""SELECT source, train_count, heldout_count, coalesce(train_count, heldout_count, 0) AS n FROM (SELECT {_al} AS source, count(*) AS train_count FROM (SELECT {_SRC} AS s FROM flows WHERE p1 < 0.7 AND flow_id % 5 <> 3) GROUP BY 1)
 FULL JOIN (SELECT {_al} AS source, count(*) AS heldout_count FROM (SELECT {_SRC} AS s FROM flows WHERE p1 >= 0.7) GROUP BY 1) USING (source)""",
      lambda spark, sf: A.agg_training_composition(flows(spark, sf).filter("p1 < 0.7 AND flow_id % 5 <> 3").groupBy(F.expr(_SRC).alias("source")).agg(F.count("*").alias("n")), flows(spark, sf).filter("p1 >= 0.7").groupBy(F.expr(_SRC).alias("source")).agg(F.count("*").alias("n"))))

# ── tops ─────────────────────────────────────────────────────────────────────
for _nm, _col, _blank, _n in (("top_attack_types", "attack_type", "", 20), ("top_src_ips", "src_ip", "", 10), ("top_dst_ports", "dst_port", 0, 10), ("top_tags", "tag", "", 10)):
    _b = f"'{_blank}'" if isinstance(_blank, str) else _blank
    named(_nm, f"SELECT {_col} AS value, count(*) AS n FROM alerts WHERE {_col} <> {_b} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {_n}",
          lambda spark, sf, c=_col, b=_blank, n=_n: A.top_n(alerts(spark, sf), c, n=n, blank=b))
TOPX = {"top": f"SELECT src_ip, count(*) AS n, {SEVN}[max({_RK}) + 1] AS worst_severity, max(t_us) AS last_us FROM alerts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"}
TOP_SQL = "SELECT top.*, (SELECT array_to_string(list(attack_type ORDER BY attack_type)[1:5], ',') FROM (SELECT DISTINCT src_ip, attack_type FROM alerts) a WHERE a.src_ip = top.src_ip) AS attacks FROM top"


def offenders(al):
    return A.top_offenders(al).withColumns({"last_us": _us("last_seen"), "attacks": F.array_join("attacks", ",")}).drop("last_seen")


named("top_offenders", TOP_SQL, lambda spark, sf: offenders(alerts(spark, sf)), extra=TOPX)


@query("flagship_offenders", vw(TOP_SQL, extra=TOPX))
def _(spark, sf):
    """Flow view, 45 features, host windows, fused score, severity, alerts, top offenders."""
    from flowlens.functions import scores as S
    f = flows(spark, sf).transform(Wn.host_rolling_60s)
    c = f.transform(X.canonical_45, keep=["flow_id", "t_us", "src_ip", "dst_ip", "family", "p1", "p2", "p3", *V.HOST_AGGREGATES])
    c = c.withColumn("p", F.round(S.score_stage1(["p1", "p2", "p3"]), 6)).withColumn("severity", S.severity_of("p"))
    a = c.filter(F.col("p") >= 0.20).withColumn("ts", F.timestamp_micros(F.col("t_us") + F.lit(START_US)))
    return offenders(a.withColumnRenamed("family", "attack_type"))


named("latest_per_key", "SELECT src_ip, max_by(id, struct_pack(t := t_us, i := id)) AS id, max_by(severity, struct_pack(t := t_us, i := id)) AS severity FROM alerts GROUP BY 1",
      lambda spark, sf: A.latest_per_key(alerts(spark, sf), keys="src_ip", by=F.struct("t_us", "id"), columns=["id", "severity"]))
named("recent_alerts", f"SELECT id, severity, attack_type, round(round(greatest(ml_score, ueba_score, rule_score, eta_score), 4), 6) + 0.0 AS final_score, {casemap('attack_type', V.FAMILY_TACTIC, chr(39) + 'Unclassified' + chr(39))} AS mitre_tactic, CAST(rule_name <> '' AS INT) AS correlated FROM alerts ORDER BY id DESC LIMIT 50",
      lambda spark, sf: A.recent_alerts(alerts(spark, sf)).select("id", "severity", "attack_type", "final_score", "mitre_tactic", F.col("correlated").cast("int")))
named("device_alert_history", "SELECT id, severity, attack_type FROM alerts WHERE src_ip = '192.168.10.1' ORDER BY id DESC LIMIT 50",
      lambda spark, sf: A.device_alert_history(alerts(spark, sf), ip="192.168.10.1").select("id", "severity", "attack_type"))
query("risk_timeline", recursive("SELECT flow_id, src_ip, t_us, round(risk, 6) + 0.0 AS risk FROM (SELECT rr.t_us, walk.* FROM walk JOIN rr USING (flow_id)) WHERE t_us > 400000000 ORDER BY t_us DESC, flow_id DESC LIMIT 500", _RISKX, "walk"))(
    lambda spark, sf: A.risk_timeline(risk_rows(spark, sf), since_us=400_000_000).select("flow_id", "src_ip", "t_us", "risk"))

# ── sets ─────────────────────────────────────────────────────────────────────
_F2 = "SELECT DISTINCT dst_ip AS ip, 'seen' AS category, 'LOW' AS severity, 'feed_b' AS feed FROM flows WHERE dst_port IN (22, 80) AND dst_ip LIKE '93.%'"
UNX = {"f2": _F2, "un": "SELECT * FROM f2 UNION ALL SELECT * FROM bad_ips WHERE ip NOT IN (SELECT ip FROM f2)"}
named("union_iocs", "SELECT * FROM un", lambda spark, sf: So.union_iocs(dim(spark, sf, BAD_IPS), dim(spark, sf, _F2), key="ip"), extra=UNX)
named("except_whitelist", "SELECT * FROM bad_ips WHERE ip NOT IN (SELECT ip FROM f2)", lambda spark, sf: So.except_whitelist(dim(spark, sf, BAD_IPS), dim(spark, sf, _F2), key="ip"), extra=UNX)
_H1 = "SELECT DISTINCT sni AS domain, src_ip AS host FROM flows WHERE sni <> '' AND t_us < 300000000"
named("union_hosts", "SELECT DISTINCT sni AS domain, src_ip AS host FROM flows WHERE sni <> ''",
      lambda spark, sf: So.union_hosts(dim(spark, sf, _H1), dim(spark, sf, "SELECT sni AS domain, src_ip AS host FROM flows WHERE sni <> '' AND t_us >= 200000000")))
_ps = lambda ps: f"bool_or(dst_port IN {inlist(ps)})"
named("port_set_intersect", f"""SELECT src_ip, count(DISTINCT dst_port) AS n_ports, CASE WHEN {_ps(V.INFRA_PORTS)} THEN 'Infrastructure' WHEN {_ps(V.PRINTER_PORTS)} THEN 'Printer' WHEN {_ps(V.IOT_PORTS)} THEN 'IoT'
 WHEN {_ps(V.SERVER_PORTS)} AND count(DISTINCT dst_port) > 5 THEN 'Server' ELSE 'Workstation' END AS role FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY t_us, flow_id) AS i FROM flows) WHERE i <= 4 GROUP BY 1""",
      lambda spark, sf: So.port_set_intersect(flows(spark, sf), at=4))
_AV = "CASE flow_id % 4 WHEN 0 THEN array('Dur', 'x') WHEN 1 THEN array('tcp.len', 'Dst Port') WHEN 2 THEN array('y') ELSE array('TotBytes', 'udp.port', 'Flow Byts/s') END"
named("intersect_features", "SELECT flow_id, CASE flow_id % 4 WHEN 0 THEN 'spec2_botnet' WHEN 1 THEN 'spec1_cic,spec3_iot' ELSE 'spec1_cic,spec2_botnet,spec3_iot' END AS routes FROM flows",
      lambda spark, sf: So.route_per_row(flows(spark, sf).withColumn("avail", F.expr(_AV)), available="avail").select("flow_id", F.array_join("routes", ",").alias("routes")))
