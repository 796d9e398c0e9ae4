"""Queries: windows, baselines and order-dependent folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens import values as V
from flowlens.functions import scores as S
from flowlens.operators import features as X, recurrence as R, windows as Wn
from flowlens.operators.aggregates import agg_cold_start_median
from flowlens.operators.segments import row_index
from flowlens.plans.flowview import START_US, alerts, flows, ladder_sql, scored, with_views
from flowlens.plans.q_features import UM, _RK
from flowlens.plans.registry import query, sql_round
from flowlens.session import cut

EARLIER = "(b.t_us < a.t_us OR (b.t_us = a.t_us AND b.flow_id < a.flow_id))"
HOST_SQL = f"""SELECT a.flow_id, round(count(b.flow_id), 6) + 0.0 AS host_flow_count_60s, round(count(DISTINCT b.dst_ip), 6) + 0.0 AS host_distinct_dst_60s,
 round(count(DISTINCT b.dst_port), 6) + 0.0 AS host_distinct_port_60s,
 round(coalesce(sum(CASE WHEN b.syn_flag = 1 AND b.ack_flag = 0 THEN 1 ELSE 0 END), 0), 6) + 0.0 AS host_syn_no_ack_count_60s,
 round(count(b.flow_id) / 60.0, 6) + 0.0 AS host_flow_rate_60s, round(coalesce(sum(CAST(b.total_bytes AS DOUBLE)), 0), 6) + 0.0 AS host_bytes_out_60s,
 round(coalesce(avg(b.gap), 0), 6) + 0.0 AS host_inter_flow_mean_60s, round(coalesce(stddev_pop(b.gap), 0), 6) + 0.0 AS host_inter_flow_std_60s
FROM flows a LEFT JOIN (SELECT a2.flow_id AS aid, b.*, (b.t_us - lag(b.t_us) OVER (PARTITION BY a2.flow_id ORDER BY b.t_us, b.flow_id)) / 1e6 AS gap
  FROM flows a2 JOIN flows b ON a2.src_ip = b.src_ip AND b.t_us BETWEEN a2.t_us - 60000000 AND a2.t_us AND {EARLIER.replace('a.', 'a2.')}) b ON b.aid = a.flow_id
GROUP BY a.flow_id"""


@query("host_rolling_60s", with_views(HOST_SQL))
def _(spark, sf):
    return flows(spark, sf).transform(Wn.host_rolling_60s).select("flow_id", *V.HOST_AGGREGATES)


@query("agg_cold_start_median", with_views("SELECT " + ", ".join(f"round(median({c}), 6) + 0.0 AS {c}" for c in V.HOST_AGGREGATES) + " FROM (" + HOST_SQL.replace("round(", "(").replace(", 6) + 0.0", ")") + ")"))
def _(spark, sf):
    return agg_cold_start_median(flows(spark, sf).transform(Wn.host_rolling_60s))


def win(h, part="src_ip"):
    return f"OVER (PARTITION BY {part} ORDER BY t_us RANGE BETWEEN {h - 1} PRECEDING AND CURRENT ROW)"


W60 = win(60_000_000)


@query("asym_capture_1h", with_views(f"""SELECT flow_id, CAST(count(*) {win(3600_000_000)} >= 4 AND avg(CASE WHEN bwd_bytes = 0 THEN 1.0 ELSE 0.0 END) {win(3600_000_000)} > 0.15 AS INT) AS asymmetric FROM flows""", compress=60))
def _(spark, sf):
    d = flows(spark, sf, 60).transform(Wn.asym_capture_1h, threshold=0.15, min_rows=4)
    return d.select("flow_id", F.col("asymmetric").cast("int"))


@query("suppress_directional", with_views(f"""SELECT flow_id, {sql_round({c: f"CASE WHEN asym THEN 0 ELSE {e} END" for c, e in
 {'fwd_bwd_pkt_ratio': 'fwd_packets/greatest(bwd_packets,1)', 'fwd_bwd_byte_ratio': 'fwd_bytes/greatest(bwd_bytes,1)', 'fwd_byte_ratio': 'fwd_bytes/greatest(total_bytes,1)'}.items()})}
 FROM (SELECT *, count(*) {win(3600_000_000)} >= 4 AND avg(CASE WHEN bwd_bytes = 0 THEN 1.0 ELSE 0.0 END) {win(3600_000_000)} > 0.15 AS asym FROM flows)""", compress=60))
def _(spark, sf):
    d = flows(spark, sf, 60).transform(Wn.asym_capture_1h, threshold=0.15, min_rows=4).transform(X.group_b)
    return d.transform(X.suppress_directional, when=F.col("asymmetric")).select("flow_id", "fwd_bwd_pkt_ratio", "fwd_bwd_byte_ratio", "fwd_byte_ratio")


EM = {"fpm": "n * 1.0", "unique_dst": "ud", "bytes_per_flow": "tb / n", "send_ratio": "CASE WHEN tb > 0 THEN fb / tb ELSE 0.5 END"}
EM_SQL = f"""SELECT *, {', '.join(f'CASE WHEN n >= 5 THEN {e} END AS {c}' for c, e in EM.items())} FROM (SELECT *, count(*) {W60} AS n, count(DISTINCT dst_ip) {W60} AS ud,
 CAST(sum(total_bytes) {W60} AS DOUBLE) AS tb, CAST(sum(fwd_bytes) {W60} AS DOUBLE) AS fb FROM flows)"""


@query("entity_metrics_60s", with_views(f"SELECT flow_id, {sql_round({c: c for c in EM})} FROM ({EM_SQL})"))
def _(spark, sf):
    return flows(spark, sf).transform(Wn.entity_metrics_60s).select("flow_id", *EM)


PUSH_SQL = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY t_us, flow_id) AS push_idx FROM em WHERE fpm IS NOT NULL) WHERE push_idx % 10 = 0"
EMX = {"em": EM_SQL, "push": PUSH_SQL}


def pushes(spark, sf, f=None):
    # rows are numbered in two passes over windows that are worked out once
    f = (flows(spark, sf) if f is None else f).select("flow_id", "t_us", "src_ip", "dst_ip", "total_bytes", "fwd_bytes")
    return cut(f.transform(Wn.entity_metrics_60s).select("flow_id", "t_us", "src_ip", *EM), "metrics").transform(Wn.peer_push, every=10)


@query("peer_push_every_100", with_views(f"SELECT flow_id, push_idx, {sql_round({c: c for c in EM})} FROM push", extra=EMX))
def _(spark, sf):
    return pushes(spark, sf).select("flow_id", F.col("push_idx").cast("long"), *EM)


UF = {"w_fpm": "n", "w_unique_dst": "ud", "w_failed_ratio": "CASE WHEN n >= 3 THEN fail / n ELSE 0 END",
      "w_send_ratio": "CASE WHEN fb + bb > 100 THEN fb / (fb + bb) ELSE 0.5 END", "w_bytes": "fb + bb"}


def uf_sql():
    return f"""SELECT *, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in UF.items())} FROM (SELECT *, count(*) {W60} AS n, count(DISTINCT dst_ip) {W60} AS ud,
 CAST(sum(rst_flag + CASE WHEN syn_flag > 0 AND ack_flag = 0 AND fin_flag = 0 THEN 1 ELSE 0 END) {W60} AS DOUBLE) AS fail,
 CAST(sum(fwd_bytes) {W60} AS DOUBLE) AS fb, CAST(sum(bwd_bytes) {W60} AS DOUBLE) AS bb FROM flows)"""


@query("ueba_60s_features", with_views(f"SELECT flow_id, {sql_round({c: c for c in UF})} FROM uf", extra={"uf": uf_sql()}))
def _(spark, sf):
    return flows(spark, sf).transform(Wn.ueba_60s_features).select("flow_id", *UF)


BEACON = {"g1": "SELECT *, t_us - lag(t_us) OVER (PARTITION BY src_ip ORDER BY t_us, flow_id) AS gap FROM flows",
          "g2": "SELECT *, count(CASE WHEN gap > 0 AND gap <= 60000000 THEN 1 END) OVER (PARTITION BY src_ip ORDER BY t_us, flow_id ROWS UNBOUNDED PRECEDING) AS gi FROM g1",
          "g3": "SELECT src_ip, gi, avg(gap/1e6) OVER w AS m, stddev_pop(gap/1e6) OVER w AS s FROM g2 WHERE gap > 0 AND gap <= 60000000 WINDOW w AS (PARTITION BY src_ip ORDER BY gi ROWS 49 PRECEDING)"}
BEACON_SQL = "SELECT g2.*, g2.gi AS beacon_n, CASE WHEN gi >= 10 THEN m ELSE 0 END AS beacon_mean, CASE WHEN gi >= 10 AND m >= 0.1 THEN s/m ELSE 1 END AS beacon_cv FROM g2 LEFT JOIN g3 USING (src_ip, gi)"


@query("beacon_cv", with_views(f"SELECT flow_id, beacon_n, {sql_round({'beacon_mean': 'beacon_mean', 'beacon_cv': 'beacon_cv'})} FROM ({BEACON_SQL})", extra=BEACON))
def _(spark, sf):
    return flows(spark, sf).transform(Wn.beacon_cv).select("flow_id", "beacon_n", "beacon_mean", "beacon_cv")


TS = f"make_timestamp(t_us + {START_US})"


def real(spark, sf):
    return flows(spark, sf, 1).withColumn("ts", F.timestamp_micros(F.col("t_us") + F.lit(START_US)))


def hp_sql(need):
    return f"""SELECT *, CASE WHEN na < {need} THEN 0.0 WHEN nh * 1.0 / na < 0.01 THEN 1.0 WHEN nh * 1.0 / na < 0.03 THEN 0.5 ELSE 0.0 END AS hour_dev FROM
 (SELECT *, count(*) OVER (PARTITION BY src_ip ORDER BY t_us, flow_id ROWS UNBOUNDED PRECEDING) AS na,
 count(*) OVER (PARTITION BY src_ip, hour({TS}) ORDER BY t_us, flow_id ROWS UNBOUNDED PRECEDING) AS nh FROM flows)"""


@query("hour_profile", with_views(f"SELECT flow_id, round(hour_dev, 6) + 0.0 AS hour_dev FROM ({hp_sql(40)})", compress=1))
def _(spark, sf):
    return real(spark, sf).transform(Wn.hour_profile, need=40).select("flow_id", "hour_dev")


SNAPX = {"uf": uf_sql(),
         "snap": f"""SELECT src_ip, CAST({TS} AS DATE) AS date, hour({TS}) AS hour, isodow(min({TS})) - 1 AS dow, avg(w_fpm) AS fpm, avg(w_unique_dst) AS unique_dst,
 avg(fwd_bytes + bwd_bytes) AS bytes_pf, avg(fwd_bytes / greatest(fwd_bytes + bwd_bytes, 1)) AS send_ratio, count(*) AS n_flows, max(t_us) AS last_us,
 count(*) FILTER (protocol = 6) AS proto_6, count(*) FILTER (protocol = 17) AS proto_17, count(*) FILTER (protocol = 1) AS proto_1,
 array_to_string(list_sort(list(DISTINCT dst_port) FILTER (dst_port > 0)), ',') AS ports FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY t_us, flow_id) AS i FROM uf) WHERE i >= 20 GROUP BY 1, 2, 3""",
         "latest": "SELECT max(last_us) AS m FROM snap",
         "wsnap": "SELECT snap.*, CASE WHEN (m - last_us)/86400e6 <= 3 THEN 0.5 WHEN (m - last_us)/86400e6 <= 7 THEN 0.3 ELSE 0.2 END AS w FROM snap JOIN latest ON true WHERE (m - last_us)/86400e6 <= 14"}
_sb = ", ".join(f"sum(w*{m})/sum(w) AS mean_{m}, sum(w*{m}*{m})/sum(w) AS q_{m}" for m in Wn.SNAP)
_sd = ", ".join(f"mean_{m}, CASE WHEN n < 2 THEN greatest(mean_{m}*0.2, 1.0) ELSE greatest(sqrt(greatest(q_{m} - mean_{m}*mean_{m}, 0)), 0.01) END AS std_{m}" for m in Wn.SNAP)
SNAPX["slots"] = f"SELECT src_ip, dow, hour, n, {_sd} FROM (SELECT src_ip, dow, hour, count(*) AS n, {_sb} FROM wsnap GROUP BY 1, 2, 3)"
SNAP_COLS = [f"{k}_{m}" for k in ("mean", "std") for m in Wn.SNAP]


def snapshots(spark, sf, rows=None):
    """rows: flows with the columns of `ueba_60s_features`, where a query has them already."""
    rows = real(spark, sf).transform(Wn.ueba_60s_features) if rows is None else rows
    return rows.transform(Wn.hourly_snapshot)


def slots(spark, sf, rows=None):
    snap = cut(snapshots(spark, sf, rows), "snapshots")  # read for its newest row and for its slots
    return Wn.slot_baseline(snap, as_of_us=snap.select(F.max("last_us")).scalar())


@query("hourly_snapshot", with_views(f"SELECT src_ip, strftime(date, '%Y-%m-%d') AS date, hour, dow, {sql_round({m: m for m in Wn.SNAP})}, n_flows, proto_6, proto_17, proto_1, ports FROM snap", compress=1, extra=SNAPX))
def _(spark, sf):
    return snapshots(spark, sf).withColumns({"date": F.date_format("date", "yyyy-MM-dd"), "ports": F.array_join("ports", ",")}).drop("last_us")


@query("slot_baseline", with_views(f"SELECT src_ip, dow, hour, n, {sql_round({c: c for c in SNAP_COLS})} FROM slots", compress=1, extra=SNAPX))
def _(spark, sf):
    return slots(spark, sf)


_lvl = lambda p: ", ".join(f"avg(mean_{m}) AS {p}_mean_{m}, greatest(stddev_pop(mean_{m}), 0.01) AS {p}_std_{m}" for m in Wn.SNAP)
_const = {"mean_fpm": 1, "std_fpm": 1, "mean_unique_dst": 1, "std_unique_dst": 1, "mean_bytes_pf": 1, "std_bytes_pf": 1, "mean_send_ratio": 0.5, "std_send_ratio": 0.1}
_pick = {c: f"CASE source WHEN 'slot' THEN {c} WHEN 'weekday' THEN d_{c} WHEN 'global' THEN g_{c} ELSE {_const[c]} END" for c in SNAP_COLS}
EXPX = {**SNAPX, "dd": f"SELECT src_ip, dow, count(*) AS d_n, {_lvl('d')} FROM slots GROUP BY 1, 2",
        "gg": f"SELECT src_ip, count(*) AS g_n, {_lvl('g')} FROM slots GROUP BY 1",
        "keyed": f"SELECT flow_id, t_us, src_ip, w_fpm, w_unique_dst, CAST(total_bytes AS DOUBLE) AS flow_bytes, w_send_ratio, isodow({TS}) - 1 AS dow, hour({TS}) AS hour FROM uf",
        "expd": """SELECT keyed.*, slots.* EXCLUDE (src_ip, dow, hour), dd.* EXCLUDE (src_ip, dow), gg.* EXCLUDE (src_ip),
 CASE WHEN n >= 2 THEN 'slot' WHEN d_n >= 2 THEN 'weekday' WHEN g_n >= 1 THEN 'global' ELSE 'none' END AS source
 FROM keyed LEFT JOIN slots USING (src_ip, dow, hour) LEFT JOIN dd USING (src_ip, dow) LEFT JOIN gg USING (src_ip)"""}


def keyed(spark, sf, rows=None):
    d = real(spark, sf).transform(Wn.ueba_60s_features) if rows is None else rows
    return d.select("flow_id", "src_ip", "w_fpm", "w_unique_dst", F.col("total_bytes").cast("double").alias("flow_bytes"), "w_send_ratio",
                    F.weekday("ts").alias("dow"), F.hour("ts").alias("hour"))


_HB = f"OVER (PARTITION BY src_ip, CAST({TS} AS DATE), hour({TS}) ORDER BY t_us, flow_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_HM = {"fpm": "w_fpm", "unique_dst": "w_unique_dst", "bytes_pf": "CAST(fwd_bytes + bwd_bytes AS DOUBLE)", "send_ratio": "fwd_bytes / greatest(fwd_bytes + bwd_bytes, 1)"}
HOURX = {**EXPX, "hb0": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY t_us, flow_id) AS i FROM uf) WHERE i >= 2",
         "hb": f"SELECT flow_id, count(*) {_HB} AS hour_n, " + ", ".join(f"avg({e}) {_HB} AS hour_mean_{m}, CASE WHEN count(*) {_HB} < 2 THEN greatest(avg({e}) {_HB} * 0.2, 1.0) ELSE greatest(stddev_pop({e}) {_HB}, 0.01) END AS hour_std_{m}" for m, e in _HM.items()) + " FROM hb0",
         "hexp": "SELECT expd.* REPLACE (CASE WHEN source = 'none' AND coalesce(hour_n, 0) > 0 THEN 'hour' ELSE source END AS source), hb.* EXCLUDE (flow_id) FROM expd LEFT JOIN hb USING (flow_id)"}
_hpick = {c: e.replace("CASE source ", f"CASE source WHEN 'hour' THEN hour_{c} ") for c, e in _pick.items()}


@query("expected_fallback", with_views(f"SELECT flow_id, source, {sql_round(_hpick)} FROM hexp", compress=1, extra=HOURX))
def _(spark, sf):
    d = real(spark, sf).transform(Wn.ueba_60s_features).transform(Wn.hour_buffer, warmup=2)
    d = d.select("flow_id", "src_ip", F.weekday("ts").alias("dow"), F.hour("ts").alias("hour"), *[c for c in d.columns if c.startswith("hour_")])
    return Wn.expected_fallback(d, slots(spark, sf)).drop("src_ip", "dow", "hour")


_CUR = {"fpm": "w_fpm", "unique_dst": "w_unique_dst", "bytes_pf": "flow_bytes", "send_ratio": "w_send_ratio"}


@query("zscore_slot", with_views("SELECT flow_id, " + sql_round({f"z_{m}": f"abs({c} - {_pick['mean_' + m]}) / greatest({_pick['std_' + m]}, {0.001 if m == 'send_ratio' else 0.01})" for m, c in _CUR.items()}) + " FROM expd", compress=1, extra=EXPX))
def _(spark, sf):
    d = Wn.expected_fallback(keyed(spark, sf), slots(spark, sf)).transform(Wn.zscore_slot, current=_CUR)
    return d.select("flow_id", *[f"z_{m}" for m in _CUR])


_ANX = {**SNAPX, "rk": "SELECT *, CASE WHEN row_number() OVER (PARTITION BY src_ip, dow, hour ORDER BY last_us) = 1 THEN 1 ELSE 0 END AS nw FROM snap",
        "cum": "SELECT *, sum(nw) OVER w AS ns, min(last_us) OVER w AS f FROM rk WINDOW w AS (PARTITION BY src_ip ORDER BY last_us ROWS UNBOUNDED PRECEDING)",
        "anc": "SELECT src_ip, min(last_us) AS anchor_us FROM cum WHERE (last_us - f)/86400e6 >= 14 AND ns >= 20 GROUP BY 1",
        "psl": "SELECT src_ip, anchor_us, dow, hour, avg(fpm) fpm, avg(unique_dst) unique_dst, avg(bytes_pf) bytes_pf, avg(send_ratio) send_ratio FROM snap JOIN anc USING (src_ip) WHERE last_us <= anchor_us GROUP BY 1, 2, 3, 4"}


@query("anchor_capture", with_views(f"SELECT src_ip, anchor_us, {sql_round({'anchor_' + m: f'avg({m})' for m in Wn.SNAP})} FROM psl GROUP BY 1, 2", compress=1, extra=_ANX))
def _(spark, sf):
    return Wn.anchor_capture(snapshots(spark, sf), min_slots=20)


TEMP = {"att": f"SELECT flow_id, t_us, src_ip, p, p >= 0.5 AS is_attack, {ladder_sql('p', 'cascade')} AS severity FROM scored",
        "tw": f"""SELECT *, count(*) {win(60_000_001)} AS n, sum(CASE WHEN is_attack THEN 1 ELSE 0 END) {win(60_000_001)} AS na,
 max(CASE WHEN is_attack THEN {_RK} ELSE 0 END) {win(60_000_001)} AS top FROM att"""}


def judged(spark, sf):
    d = scored(spark, sf)
    return d.select("flow_id", "t_us", "src_ip", "p", (F.col("p") >= 0.5).alias("is_attack"), F.col("p").alias("confidence"),
                    S.severity_of("p").alias("severity"))


_TA = """CASE WHEN NOT is_attack THEN na/n > 0.5 AND top >= 3 WHEN severity = 'CRITICAL' AND p > 0.95 THEN true WHEN na/n >= 0.55 THEN true WHEN n < 5 THEN p > 0.85 ELSE false END"""
_TSV = """CASE WHEN NOT is_attack THEN CASE WHEN na/n > 0.5 AND top >= 3 THEN ['BENIGN','LOW','MEDIUM','HIGH','CRITICAL'][top+1] ELSE 'BENIGN' END
 WHEN severity = 'CRITICAL' AND p > 0.95 THEN 'CRITICAL' WHEN na/n >= 0.55 OR n < 5 THEN severity ELSE 'BENIGN' END"""


@query("temporal_ratio_60s", with_views(f"SELECT flow_id, n AS window_n, round(na/n, 6) + 0.0 AS window_ratio, CAST({_TA} AS INT) AS temporal_alert, {_TSV} AS effective_severity FROM tw", extra=TEMP))
def _(spark, sf):
    d = judged(spark, sf).transform(Wn.temporal_ratio_60s, alert_ratio=0.55)
    return d.select("flow_id", "window_n", "window_ratio", F.col("temporal_alert").cast("int"), "effective_severity")


# the newest-rows bound, small enough to bite
@query("temporal_ratio_max_rows", with_views("""SELECT flow_id, least(n, 3) AS window_n, round(CAST(list_sum(l[greatest(1, len(l) - 2):]) AS DOUBLE) / least(n, 3), 6) + 0.0 AS window_ratio
 FROM (SELECT flow_id, count(*) OVER w AS n, list(CASE WHEN is_attack THEN 1 ELSE 0 END) OVER w AS l FROM att WINDOW w AS (PARTITION BY src_ip ORDER BY t_us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW))""", extra=TEMP))
def _(spark, sf):
    return judged(spark, sf).transform(Wn.temporal_ratio_60s, max_rows=3).select("flow_id", "window_n", "window_ratio")


# ── long-term z ──────────────────────────────────────────────────────────────
DEPT_SQL = "CASE string_split(src_ip, '.')[3] WHEN '1' THEN 'Infrastructure' WHEN '10' THEN 'IT' WHEN '20' THEN 'Finance' WHEN '30' THEN 'Marketing' WHEN '40' THEN 'Sales' WHEN '50' THEN 'IoT' ELSE 'Guest' END"


def with_dept(df):
    return df.withColumn("department", S.lookup(F.element_at(F.split("src_ip", r"\."), 3), {
        "1": "Infrastructure", "10": "IT", "20": "Finance", "30": "Marketing", "40": "Sales", "50": "IoT", "60": "Guest"}, "Unknown"))


def _rw(m, part):
    w = f"OVER (PARTITION BY {part} ORDER BY t_us, flow_id ROWS UNBOUNDED PRECEDING)"
    return f"avg({m}) {w} AS {part[0]}a_{m}, var_pop({m}) {w} * count(*) {w} AS {part[0]}v_{m}"


_M = V.UEBA_METRICS
_seed = ", ".join(f"first_value(pa_{m}) OVER dv AS qa_{m}, first_value(pv_{m}) OVER dv AS qv_{m}" for m in _M)
_prev = ", ".join(f"avg({m}) OVER pv AS pa_{m}, var_pop({m}) OVER pv * count(*) OVER pv AS pv_{m}" for m in _M)
ZX = {"um": f"SELECT flow_id, t_us, src_ip, {DEPT_SQL} AS department, {', '.join(f'{e} AS {n}' for n, e in UM.items())} FROM flows",
      "z1": f"""SELECT *, count(*) OVER (PARTITION BY src_ip ORDER BY t_us, flow_id ROWS UNBOUNDED PRECEDING) AS sn, count(*) OVER (PARTITION BY department ORDER BY t_us, flow_id ROWS UNBOUNDED PRECEDING) AS dn,
 {', '.join(_rw(m, p) for m in _M for p in ('src_ip', 'department'))}, {_prev} FROM um WINDOW pv AS (PARTITION BY department ORDER BY t_us, flow_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
      "z2": f"SELECT *, first_value(dn - 1) OVER dv AS qn, {_seed} FROM z1 WINDOW dv AS (PARTITION BY src_ip ORDER BY t_us, flow_id)",
      "z3": "SELECT *, CASE WHEN qn >= 30 THEN qn + sn ELSE sn END AS mn, " + ", ".join(
          f"CASE WHEN qn >= 30 THEN (qn*qa_{m} + sn*sa_{m})/(qn + sn) ELSE sa_{m} END AS ma_{m}, CASE WHEN qn >= 30 THEN qv_{m} + sv_{m} + (sa_{m}-qa_{m})*(sa_{m}-qa_{m})*qn*sn/(qn+sn) ELSE sv_{m} END AS mv_{m}" for m in _M) + " FROM z2",
      "z4": "SELECT *, " + ", ".join(f"CASE WHEN mn >= 30 THEN CASE WHEN mv_{m} > 0 THEN ({m} - ma_{m})/sqrt(mv_{m}/(mn-1)) ELSE 0 END ELSE CASE WHEN dv_{m} > 0 THEN ({m} - da_{m})/sqrt(dv_{m}/(dn-1)) ELSE 0 END END AS z_{m}" for m in _M) + " FROM z3 WHERE true"}
_best = "greatest(" + ", ".join(f"abs(z_{m})" for m in _M) + ")"
Z_SQL = f"""SELECT *, CASE WHEN mn >= 30 THEN mn ELSE dn END AS score_n, CASE WHEN mn >= 30 OR dn >= 30 THEN CASE {' '.join(f'WHEN abs(z_{m}) = {_best} THEN z_{m}' for m in _M)} END END AS max_z,
 CASE WHEN mn >= 30 OR dn >= 30 THEN CASE {' '.join(f"WHEN abs(z_{m}) = {_best} THEN '{m}'" for m in _M)} END END AS max_metric FROM z4"""
ZX["zz"] = Z_SQL


def running_z(spark, sf):
    return flows(spark, sf).transform(with_dept).transform(X.ueba_metrics).transform(Wn.ueba_running_z)


@query("ueba_running_z", with_views("SELECT flow_id, score_n, round(max_z, 6) + 0.0 AS max_z, max_metric FROM zz", extra=ZX))
def _(spark, sf):
    return running_z(spark, sf).select("flow_id", "score_n", "max_z", "max_metric")


# ── folds ────────────────────────────────────────────────────────────────────
_RISKX = {"rr": "SELECT flow_id, t_us, src_ip, (flow_id * 13) % 101 / 101.0 AS s, row_number() OVER (PARTITION BY src_ip ORDER BY t_us, flow_id) AS rn, CASE WHEN flow_id % 3 = 0 THEN 'IoT' ELSE 'Server' END AS role FROM flows",
          "walk": """SELECT src_ip, rn, flow_id, CASE WHEN s > 0.6 THEN least(100.0, s * 15.0 * (CASE role WHEN 'IoT' THEN 1.3 ELSE 0.7 END)) ELSE 0.0 END::DOUBLE AS risk FROM rr WHERE rn = 1
 UNION ALL SELECT b.src_ip, b.rn, b.flow_id, CASE WHEN s > 0.6 THEN least(100.0, walk.risk + s * 15.0 * (CASE role WHEN 'IoT' THEN 1.3 ELSE 0.7 END)) ELSE walk.risk * (CASE role WHEN 'IoT' THEN 0.995 ELSE 0.999 END) END::DOUBLE
 FROM walk JOIN rr b ON b.src_ip = walk.src_ip AND b.rn = walk.rn + 1"""}


def risk_rows(spark, sf):
    f = flows(spark, sf).select("flow_id", "t_us", "src_ip", (((F.col("flow_id") * 13) % 101) / 101.0).alias("anomaly_score"),
                                F.when(F.col("flow_id") % 3 == 0, "IoT").otherwise("Server").alias("role"))
    return R.risk_accumulator(f, threshold=0.6, bucket_us=120_000_000)


def recursive(sql, ctes, loop, **kw):
    """with_views for a CTE that refers to itself: it must not be MATERIALIZED."""
    text = with_views(sql, extra=ctes, **kw)
    return text.replace(f"{loop} AS MATERIALIZED (", f"{loop} AS (")


@query("risk_accumulator", recursive("SELECT flow_id, round(risk, 6) + 0.0 AS risk FROM walk", _RISKX, "walk"))
def _(spark, sf):
    return risk_rows(spark, sf).select("flow_id", "risk")


_REPX = {"vv": "SELECT src_ip, verdict, row_number() OVER (PARTITION BY src_ip ORDER BY t_us, flow_id) AS rn FROM flows WHERE verdict IS NOT NULL",
         "rep": """SELECT src_ip, rn, CASE verdict WHEN 'TP' THEN 52.0 ELSE 45.0 END::DOUBLE AS r FROM vv WHERE rn = 1 UNION ALL SELECT b.src_ip, b.rn,
 CASE b.verdict WHEN 'TP' THEN least(100.0, rep.r + 2) ELSE greatest(0.0, rep.r - 5) END::DOUBLE FROM rep JOIN vv b ON b.src_ip = rep.src_ip AND b.rn = rep.rn + 1"""}


@query("reputation", recursive("SELECT v.src_ip, round(max_by(rep.r, rep.rn), 6) + 0.0 AS reputation, any_value(v.tp) AS tp, any_value(v.fp) AS fp FROM rep JOIN (SELECT src_ip, count(*) FILTER (verdict = 'TP') AS tp, count(*) FILTER (verdict = 'FP') AS fp FROM vv GROUP BY 1) v ON v.src_ip = rep.src_ip GROUP BY v.src_ip", _REPX, "rep"))
def _(spark, sf):
    return R.reputation(flows(spark, sf), bucket_us=120_000_000)


def _gate(keys, value, cond, force="false"):
    cond = f"({cond} OR b.f)"
    on = " AND ".join(f"b.{k} = e.{k}" for k in keys)
    k = ", ".join(keys)
    bk = ", ".join(f"b.{x}" for x in keys)
    return {"aa": f"SELECT id, flow_id, t_us, src_ip, attack_type, {value} AS v, {force} AS f, row_number() OVER (PARTITION BY {k} ORDER BY t_us, flow_id) AS rn FROM alerts",
            "e": f"""SELECT {k}, rn, id, true AS hit, t_us AS lt, v AS lv FROM aa WHERE rn = 1 UNION ALL
 SELECT {bk}, b.rn, b.id, {cond}, CASE WHEN {cond} THEN b.t_us ELSE e.lt END, CASE WHEN {cond} THEN b.v ELSE e.lv END FROM e JOIN aa b ON {on} AND b.rn = e.rn + 1"""}


@query("dedup_alert_60s", recursive("SELECT id FROM e WHERE hit", _gate(["src_ip", "attack_type"], _RK, "(b.t_us - e.lt >= 60000000 OR b.v > e.lv)", "id % 7 = 0"), "e"))
def _(spark, sf):
    d = alerts(spark, sf).drop("rule_names", "ts").withColumn("correlated", F.col("id") % 7 == 0)
    return R.dedup_alert_60s(d, bucket_us=120_000_000, correlated="correlated").select("id")


@query("dedup_cooldown_300s", recursive("SELECT id FROM e WHERE hit", _gate(["src_ip"], "attack_type", "(b.t_us - e.lt >= 300000000 OR b.v <> e.lv)"), "e"))
def _(spark, sf):
    # three attack types only, so that runs of one type occur
    d = alerts(spark, sf).drop("rule_names", "ts")
    return R.dedup_cooldown_300s(d, bucket_us=600_000_000).select("id")


@query("chrono_sort", with_views("SELECT flow_id, row_number() OVER (PARTITION BY src_ip ORDER BY t_us, flow_id) AS pos FROM flows"))
def _(spark, sf):
    return row_index(flows(spark, sf), keys="src_ip", name="pos").select("flow_id", "pos")
