"""Queries: feature derivation and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens import values as V
from flowlens.functions import ip as IP, scores as S, tls as L
from flowlens.operators import features as X
from flowlens.plans.flowview import (START_US, alerts, flows, fused_sql, ladder_sql, scored, tls_flows, with_views)
from flowlens.plans.registry import query, sql_round

# ── Zeek-shaped view of the flows, one text for both engines ─────────────────
CONN = """SELECT flow_id, t_us, concat('C', flow_id) AS uid, src_ip AS orig_h, src_port AS orig_p, dst_ip AS resp_h,
 dst_port AS resp_p, CASE WHEN protocol = 17 THEN 'udp' WHEN flow_id % 19 = 0 THEN 'ICMP' WHEN flow_id % 23 = 0 THEN 'gre' ELSE 'tcp' END AS proto,
 duration, fwd_bytes AS orig_bytes, bwd_bytes AS resp_bytes,
 CASE flow_id % 8 WHEN 0 THEN 'S0' WHEN 1 THEN 'S1' WHEN 2 THEN 'SF' WHEN 3 THEN 'REJ' WHEN 4 THEN 'RSTO' WHEN 5 THEN 'RSTR' WHEN 6 THEN 'SH' ELSE 'OTH' END AS conn_state,
 CASE flow_id % 6 WHEN 0 THEN 'ShADadfF' WHEN 1 THEN 'S' WHEN 2 THEN 'Dd' WHEN 3 THEN 'SR' WHEN 4 THEN NULL ELSE '^hR' END AS history,
 fwd_packets AS orig_pkts, 0 AS orig_ip_bytes, bwd_packets AS resp_pkts, bwd_bytes + 40 * bwd_packets AS resp_ip_bytes,
 CASE flow_id % 5 WHEN 0 THEN ' benign' WHEN 1 THEN 'Malicious' WHEN 2 THEN 'Benign' WHEN 3 THEN 'Background' ELSE 'malicious ' END AS label,
 CASE flow_id % 4 WHEN 0 THEN 'PartOfAHorizontalPortScan' WHEN 1 THEN '-' WHEN 2 THEN 'Mirai' ELSE '(empty)' END AS detailed
FROM flows"""
ZEEK_NAMES = {"orig_h": "id.orig_h", "orig_p": "id.orig_p", "resp_h": "id.resp_h", "resp_p": "id.resp_p",
              "detailed": "detailed-label"}


def conn(spark, sf):
    f = flows(spark, sf)
    df = spark.sql(CONN.replace("FROM flows", "FROM {f}"), f=f)
    return df.withColumn("ts", F.col("t_us") / 1e6).withColumnsRenamed(ZEEK_NAMES)


def vw(sql, **kw):
    return with_views(sql, extra={"conn": CONN}, **kw)


def inlist(xs):
    return "(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in xs) + ")"


def casemap(col, table, default):
    whens = " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in table.items())
    return f"CASE {col} {whens} ELSE {default} END"


B = {"bytes_per_sec": "greatest(total_bytes,0)/greatest(duration,1e-6)", "packets_per_sec": "total_packets/greatest(duration,1e-6)",
     "fwd_packets_per_sec": "greatest(fwd_packets,0)/greatest(duration,1e-6)",
     "bwd_packets_per_sec": "greatest(bwd_packets,0)/greatest(duration,1e-6)",
     "pkt_size_mean": "greatest(total_bytes,0)/greatest(total_packets,1)",
     "fwd_byte_ratio": "fwd_bytes/greatest(total_bytes,1)", "bytes_per_packet": "greatest(total_bytes,0)/greatest(total_packets,1)",
     "fwd_bwd_pkt_ratio": "fwd_packets/greatest(bwd_packets,1)", "fwd_bwd_byte_ratio": "fwd_bytes/greatest(bwd_bytes,1)",
     "duration_per_packet": "duration/greatest(total_packets,1)"}
_f = lambda c: f"CASE WHEN {c} THEN 1 ELSE 0 END"
C = {"is_well_known_port": _f("dst_port > 0 AND dst_port < 1024"), "is_http": _f(f"dst_port IN {inlist(V.HTTP_PORTS)}"),
     "is_https": _f(f"dst_port IN {inlist(V.HTTPS_PORTS)}"), "is_dns": _f("dst_port = 53 OR src_port = 53"),
     "is_ssh": _f("dst_port = 22"), "is_threat_port": _f(f"dst_port IN {inlist(V.C2_PORTS)}")}
D = {"syn_ratio": "syn_flag", "rst_ratio": "rst_flag", "fin_ratio": "fin_flag"}
_fs = "(syn_flag+fin_flag+rst_flag+ack_flag+psh_flag)"
_ent = " + ".join(f"CASE WHEN {x}_flag > 0 THEN ({x}_flag/{_fs})*ln({x}_flag/{_fs}) ELSE 0 END" for x in ("syn", "fin", "rst", "ack", "psh"))
E = {"syn_without_ack": _f("syn_flag = 1 AND ack_flag = 0"), "rst_without_established": _f("rst_flag = 1 AND syn_flag + ack_flag = 0"),
     "flag_entropy": f"CASE WHEN {_fs} > 0 THEN -({_ent}) ELSE 0 END",
     "traffic_asymmetry": "abs(fwd_bytes-bwd_bytes)/greatest(total_bytes,1e-6)",
     "protocol_port_mismatch": _f(f"protocol = 6 AND dst_port NOT IN {inlist(V.COMMON_TCP_PORTS)}"),
     "short_session_flag": _f("duration < 1"), "long_session_flag": _f("duration > 600"),
     "small_packet_flag": _f("total_bytes/greatest(total_packets,1) < 64"),
     "large_packet_flag": _f("total_bytes/greatest(total_packets,1) > 1400")}
INTS = {"syn_without_ack", "rst_without_established", "protocol_port_mismatch", "short_session_flag", "long_session_flag",
        "small_packet_flag", "large_packet_flag"} | set(C)


def cols_sql(d):
    return ", ".join(f"{e} AS {n}" if n in INTS else f"round(CAST({e} AS DOUBLE), 6) + 0.0 AS {n}" for n, e in d.items())


@query("coerce_numeric", vw(f"""SELECT flow_id, {sql_round({'x': "CASE flow_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE duration END",
                                                           'y': "CASE flow_id % 2 WHEN 0 THEN -1 ELSE duration END"})} FROM flows"""))
def _(spark, sf):
    f = flows(spark, sf)
    bad = F.expr("CASE flow_id % 5 WHEN 0 THEN 'abc' WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' WHEN 3 THEN CAST(NULL AS STRING) ELSE CAST(duration AS STRING) END")
    d = f.select("flow_id", bad.alias("x"), F.expr("CASE flow_id % 2 WHEN 0 THEN '-' ELSE CAST(duration AS STRING) END").alias("y"))
    return d.transform(X.coerce_numeric, columns=["x"]).transform(X.coerce_numeric, columns=["y"], default=-1)


@query("proto_to_number", vw(f"SELECT flow_id, {casemap('lower(proto)', V.PROTO_NUMBERS, 0)} AS protocol, "
                             f"{casemap('lower(proto)', V.PROTO_NUMBERS_LIVE, 0)} AS protocol_live FROM conn"))
def _(spark, sf):
    return conn(spark, sf).select("flow_id", X.proto_to_number("proto").alias("protocol"),
                                  X.proto_to_number("proto", V.PROTO_NUMBERS_LIVE).alias("protocol_live"))


@query("zeek_to_flow", vw(f"""SELECT uid, orig_h AS src_ip, resp_h AS dst_ip, orig_p AS src_port, resp_p AS dst_port,
 {casemap('lower(proto)', V.PROTO_NUMBERS_LIVE, 0)} AS protocol, orig_pkts AS fwd_packets, resp_pkts AS bwd_packets,
 orig_pkts + resp_pkts AS total_packets, {_f(f"conn_state IN {inlist(V.SYN_STATES)}")} AS syn_flag,
 {_f(f"conn_state IN {inlist(V.ACK_STATES)}")} AS ack_flag, {_f("contains(conn_state,'R')")} AS rst_flag,
 {_f("contains(conn_state,'F')")} AS fin_flag, 0 AS psh_flag, conn_state, {sql_round({'duration': 'duration', 'fwd_bytes': 'orig_bytes',
 'bwd_bytes': 'resp_bytes', 'total_bytes': 'orig_bytes + resp_bytes', 'bytes_per_sec': '(orig_bytes + resp_bytes)/greatest(duration,0.001)',
 'packets_per_sec': '(orig_pkts + resp_pkts)/greatest(duration,0.001)', 'pkt_size_mean': '(orig_bytes+resp_bytes)/greatest(orig_pkts+resp_pkts,1)'})} FROM conn"""))
def _(spark, sf):
    return conn(spark, sf).transform(X.zeek_to_flow).drop("t_us")


GA = f"""SELECT flow_id, orig_p AS src_port, resp_p AS dst_port, {casemap('lower(proto)', V.PROTO_NUMBERS, 0)} AS protocol,
 round(duration, 6) + 0.0 AS duration, orig_pkts AS fwd_packets, resp_pkts AS bwd_packets, orig_pkts + resp_pkts AS total_packets,
 CAST(orig_bytes AS DOUBLE) AS fwd_bytes, CAST(resp_ip_bytes AS DOUBLE) AS bwd_bytes, CAST(orig_bytes + resp_ip_bytes AS DOUBLE) AS total_bytes,
 CAST(0 AS DOUBLE) AS pkt_size_min, CAST(0 AS DOUBLE) AS pkt_size_max,
 {_f("regexp_matches(upper(coalesce(history,'')), 'S|H')")} AS syn_flag, {_f("contains(upper(coalesce(history,'')), 'F')")} AS fin_flag,
 {_f("contains(upper(coalesce(history,'')), 'R')")} AS rst_flag, {_f("regexp_matches(upper(coalesce(history,'')), 'A|H')")} AS ack_flag, 0 AS psh_flag
FROM conn"""


@query("group_a", vw(GA))
def _(spark, sf):
    return conn(spark, sf).transform(X.group_a).select("flow_id", *V.GROUP_A)


_LAB = "CASE lower(trim(label)) WHEN 'benign' THEN 0 WHEN 'malicious' THEN 1 ELSE -1 END"
_FAM = "CASE WHEN lower(trim(label)) = 'malicious' AND detailed NOT IN ('-','(empty)','') THEN detailed END"


@query("extract_labels", vw(f"SELECT flow_id, {_LAB} AS label, {_FAM} AS attack_family FROM conn"))
def _(spark, sf):
    return conn(spark, sf).transform(X.extract_labels).select("flow_id", "label", "attack_family")


@query("drop_unlabeled", vw(f"SELECT flow_id, {_LAB} AS label FROM conn WHERE {_LAB} <> -1"))
def _(spark, sf):
    return conn(spark, sf).transform(X.extract_labels).transform(X.drop_unlabeled).select("flow_id", "label")


@query("extract_identity", vw("SELECT flow_id, round(t_us/1e6, 6) + 0.0 AS \"timestamp\", orig_h AS src_ip, resp_h AS dst_ip FROM conn"))
def _(spark, sf):
    return conn(spark, sf).transform(X.extract_identity).select("flow_id", "timestamp", "src_ip", "dst_ip")


for _name, _fn, _cols in (("group_b", X.group_b, B), ("group_c", X.group_c, C), ("group_d", X.group_d, D)):
    query(_name, with_views(f"SELECT flow_id, {cols_sql(_cols)} FROM flows"))(
        lambda spark, sf, fn=_fn, cols=_cols: flows(spark, sf).transform(fn).select("flow_id", *cols))


@query("group_e", with_views(f"SELECT flow_id, {cols_sql(E)} FROM flows"))
def _(spark, sf):
    return flows(spark, sf).transform(X.group_b).transform(X.group_e).select("flow_id", *E)


_A45 = ["src_port", "dst_port", "protocol", "syn_flag", "fin_flag", "rst_flag", "ack_flag", "psh_flag"]
_A45R = {c: c for c in ("duration", "fwd_packets", "bwd_packets", "total_packets", "fwd_bytes", "bwd_bytes", "total_bytes")}
CANON_SQL = (f"SELECT flow_id, {', '.join(_A45)}, {sql_round(_A45R)}, CAST(0 AS DOUBLE) AS pkt_size_min, "
             f"CAST(0 AS DOUBLE) AS pkt_size_max, {cols_sql({**B, **C, **D, **E})} FROM flows")


@query("canonical_45", with_views(CANON_SQL))
def _(spark, sf):
    # totals are left out, so the fallback to forward plus backward applies
    return flows(spark, sf).drop("total_packets", "total_bytes").transform(X.canonical_45, keep=["flow_id"])


CIC = {"src_ip": "Src IP", "dst_ip": "Dst IP", "src_port": "Src Port", "dst_port": "Dst Port", "protocol": "Protocol",
       "duration": "Flow Duration", "fwd_packets": "Tot Fwd Pkts", "bwd_packets": "Tot Bwd Pkts",
       "fwd_bytes": "TotLen Fwd Pkts", "bwd_bytes": "TotLen Bwd Pkts", "syn_flag": "SYN Flag Cnt", "fin_flag": "FIN Flag Cnt",
       "rst_flag": "RST Flag Cnt", "ack_flag": "ACK Flag Cnt", "psh_flag": "PSH Flag Cnt"}
_DEF = {k: v for k, v in V.UNIVERSAL_DEFAULTS.items() if k not in CIC}
_defs = ", ".join((f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)) + f" AS {k}" for k, v in _DEF.items())
NORM_SQL = (f"SELECT flow_id AS \"Row Tag\", {', '.join(c for c in CIC if c != 'duration')}, round(duration, 6) + 0.0 AS duration, {_defs} FROM flows")


def cic(spark, sf):
    return flows(spark, sf).select(F.col("flow_id").alias("Row Tag"), *[F.col(k).alias(v) for k, v in CIC.items()])


@query("normalize_universal", with_views(NORM_SQL))
def _(spark, sf):
    return cic(spark, sf).transform(X.normalize_universal)


def _ratio_sql(http, threat):
    tp, tb = "greatest(total_packets,1)", "total_bytes"
    return {"bytes_per_packet": f"{tb}/{tp}", "fwd_bwd_pkt_ratio": "fwd_packets/greatest(bwd_packets,1)",
            "fwd_bwd_byte_ratio": "fwd_bytes/greatest(bwd_bytes,1)", "header_payload_ratio": "0", "iat_cv": "0", "pkt_size_cv": "0",
            "duration_per_packet": f"duration/{tp}", "syn_ratio": f"syn_flag/{tp}", "rst_ratio": f"rst_flag/{tp}", "fin_ratio": f"fin_flag/{tp}",
            "pkt_size_mean": f"{tb}/{tp}", "fwd_byte_ratio": f"fwd_bytes/greatest({tb},1)"}, {
            "is_well_known_port": C["is_well_known_port"], "is_http": _f(f"dst_port IN {inlist(http)}"), "is_https": C["is_https"],
            "is_dns": _f("dst_port = 53"), "is_ssh": C["is_ssh"], "is_threat_port": _f(f"dst_port IN {inlist(threat)}")}


_R, _P = _ratio_sql(V.HTTP_PORTS_UNIVERSAL, V.THREAT_PORTS_UNIVERSAL)
_RU = {**_R, "total_packets": "total_packets", "total_bytes": "total_bytes",
       "bytes_per_sec": "CASE WHEN duration > 0.001 THEN total_bytes/duration ELSE 0 END",
       "packets_per_sec": "CASE WHEN duration > 0.001 THEN total_packets/duration ELSE 0 END",
       "fwd_byte_ratio": "CASE WHEN total_bytes > 0 THEN fwd_bytes/total_bytes ELSE 0 END"}


@query("derive_universal", with_views(f"SELECT flow_id, {sql_round(_RU)}, {', '.join(f'{e} AS {n}' for n, e in _P.items())}, 0 AS is_multicast FROM flows"))
def _(spark, sf):
    d = cic(spark, sf).transform(X.normalize_universal).transform(X.derive_universal)
    return d.select(F.col("Row Tag").alias("flow_id"), *_RU, *_P, "is_multicast")


_R4, _P4 = _ratio_sql(V.HTTP_PORTS_48, V.THREAT_PORTS_48)
_R48 = {**{c: "0" for c in V.NUMERIC_48}, **{c: c for c in CIC if c in V.NUMERIC_48}, **_R4, **_P4, "total_packets": "total_packets",
        "total_bytes": "total_bytes", "bytes_per_sec": "total_bytes/greatest(duration,0.001)",
        "packets_per_sec": "total_packets/greatest(duration,0.001)"}


@query("extract_48", with_views(f"SELECT flow_id, {sql_round(_R48)} FROM flows"))
def _(spark, sf):
    d = cic(spark, sf).transform(X.normalize_universal)
    return d.transform(X.extract_48, keep=[F.col("Row Tag").alias("flow_id")])


@query("to_vector", with_views("SELECT flow_id, 5 AS n, round(duration + fwd_bytes + bwd_bytes + dst_port + 6*0 + protocol, 6) + 0.0 AS total, round(duration, 6) + 0.0 AS first FROM flows"))
def _(spark, sf):
    d = flows(spark, sf).transform(X.to_vector, columns=["duration", "fwd_bytes", "bwd_bytes", "dst_port", "protocol"])
    return d.select("flow_id", F.size("features").alias("n"),
                    F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("total"), F.element_at("features", 1).alias("first"))


@query("add_metadata", with_views("SELECT flow_id, 'CTU-IoT-23' AS source_dataset, 'day1' AS scenario_id, 'binary' AS flag_ratio_mode, 'camera' AS device_profile FROM flows"))
def _(spark, sf):
    return flows(spark, sf).transform(X.add_metadata, source_dataset="CTU-IoT-23", scenario_id="day1",
                                      device_profile="camera").select("flow_id", "source_dataset", "scenario_id", "flag_ratio_mode", "device_profile")


_SC = ["duration", "fwd_bytes", "bwd_bytes", "dst_port", "syn_flag"]


@query("standard_scale", with_views("SELECT flow_id, " + sql_round({c: f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()" for c in _SC}) + " FROM flows"))
def _(spark, sf):
    f = flows(spark, sf)
    return f.transform(X.standard_scale, stats=X.scale_stats(f, _SC)).select("flow_id", *_SC)


UM = {"log1p_bytes": "ln(1+total_bytes)", "log1p_packets": "ln(1+total_packets)", "log1p_duration": "ln(1+duration)",
      "bytes_per_packet": "total_bytes/greatest(total_packets,1)", "log1p_bytes_per_sec": "ln(1+total_bytes/greatest(duration,0.001))",
      "log1p_packets_per_sec": "ln(1+total_packets/greatest(duration,0.001))"}


@query("ueba_metrics", with_views(f"SELECT flow_id, {sql_round(UM)} FROM flows"))
def _(spark, sf):
    return flows(spark, sf).transform(X.ueba_metrics).select("flow_id", *V.UEBA_METRICS)


# ── addresses of many kinds, made from the events ────────────────────────────
ADDR = """SELECT flow_id, CASE flow_id % 20 WHEN 0 THEN concat('10.1.', flow_id % 250, '.7') WHEN 1 THEN concat('172.', 10 + flow_id % 30, '.1.2')
 WHEN 2 THEN concat('203.0.113.', flow_id % 250) WHEN 3 THEN concat('100.', 60 + flow_id % 80, '.0.1') WHEN 4 THEN '169.254.9.9' WHEN 5 THEN '127.0.0.1'
 WHEN 6 THEN concat('239.1.1.', flow_id % 250) WHEN 7 THEN 'abc' WHEN 8 THEN '999.1.1.1' WHEN 9 THEN concat('8.8.', flow_id % 250, '.8')
 WHEN 10 THEN '192.168.1.255' WHEN 11 THEN concat('fe80::', flow_id % 10) WHEN 12 THEN concat('fd00::', flow_id % 10, ':1')
 WHEN 13 THEN concat('2404:6800:4004::', flow_id % 100) WHEN 14 THEN '::1' WHEN 15 THEN '' WHEN 16 THEN '0.0.0.0' WHEN 17 THEN '198.19.0.1'
 WHEN 18 THEN 'ff02::1' ELSE src_ip END AS ip FROM flows"""
_q = "string_split(ip, '.')"
_n = f"(CASE WHEN regexp_full_match(ip, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){{3}}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])') THEN CAST({_q}[1] AS BIGINT)*16777216+CAST({_q}[2] AS BIGINT)*65536+CAST({_q}[3] AS BIGINT)*256+CAST({_q}[4] AS BIGINT) END)"


def rng(*cidrs):
    return "(" + " OR ".join("n BETWEEN {1} AND {2}".format(*IP._bounds(c)) for c in cidrs) + ")"


ADDR_N = f"SELECT *, {_n} AS n FROM addr"
_int6 = "ip LIKE 'fe80%' OR ip LIKE 'fd00%' OR ip = '::1'"
_scope = f"CASE WHEN {rng(*V.INTERNAL_CIDRS_V4)} OR {_int6} THEN 'internal' WHEN n IS NOT NULL OR ip LIKE '%:%' THEN 'external' ELSE 'invalid' END"
AX = {"addr": ADDR, "addrn": ADDR_N}
_pub = f"CASE WHEN n IS NOT NULL THEN NOT {rng(*V.SPECIAL_CIDRS_V4, '224.0.0.0/4')} ELSE ip LIKE '2404%' END"
_nonuni = f"coalesce({rng('224.0.0.0/4', '169.254.0.0/16', '127.0.0.0/8', '0.0.0.0/32')}, false) OR ip LIKE 'ff0%' OR ip LIKE 'fe80%' OR ip = '::1' OR (n IS NOT NULL AND ip LIKE '%.255')"


def addr(spark, sf):
    f = flows(spark, sf)
    return spark.sql(ADDR.replace("FROM flows", "FROM {f}"), f=f)


@query("ip_scope", with_views(f"SELECT flow_id, ip, {_scope} AS scope FROM addrn", extra=AX))
def _(spark, sf):
    return addr(spark, sf).select("flow_id", "ip", IP.ip_scope("ip").alias("scope"))


@query("ip_is_public", with_views(f"SELECT flow_id, ip, CAST({_pub} AS INT) AS is_public FROM addrn", extra=AX))
def _(spark, sf):
    return addr(spark, sf).select("flow_id", "ip", IP.ip_is_public("ip").cast("int").alias("is_public"))


@query("subnet_pattern", with_views(f"""SELECT flow_id, ip, CASE WHEN len({_q}) <> 4 THEN '' WHEN {_q}[1] = '10' OR ({_q}[1] = '192' AND {_q}[2] = '168')
 OR ({_q}[1] = '172' AND CAST({_q}[2] AS INT) BETWEEN 16 AND 31) THEN concat({_q}[1], '.', {_q}[2], '.', {_q}[3], '.*') ELSE concat({_q}[1], '.', {_q}[2], '.*') END AS pattern FROM addr""", extra=AX))
def _(spark, sf):
    return addr(spark, sf).select("flow_id", "ip", IP.subnet_pattern("ip").alias("pattern"))


@query("pseudonymize_ip", with_views("SELECT flow_id, substr(sha256(concat('salt', src_ip)), 1, 16) AS pseudo FROM flows"))
def _(spark, sf):
    return flows(spark, sf).select("flow_id", IP.pseudonymize_ip("src_ip", "salt").alias("pseudo"))


@query("flt_non_unicast", with_views(f"SELECT flow_id, ip FROM addrn WHERE NOT ({_nonuni})", extra=AX))
def _(spark, sf):
    return addr(spark, sf).filter(~IP.is_non_unicast("ip"))


@query("flt_internal_src", with_views(f"SELECT flow_id, ip FROM addrn WHERE {_scope} = 'internal'", extra=AX))
def _(spark, sf):
    return addr(spark, sf).filter(IP.is_internal("ip"))


@query("flt_device_endpoint", with_views(f"""SELECT flow_id, ip FROM addrn WHERE {_scope} = 'internal' AND NOT (ip LIKE '127.%' OR ip LIKE '169.254%'
 OR ip LIKE '::%' OR ip LIKE 'fe80%' OR ip LIKE '%.255')""", extra=AX))
def _(spark, sf):
    return addr(spark, sf).filter(IP.is_device_endpoint("ip"))


# ── names and TLS ────────────────────────────────────────────────────────────
_PG = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"


@query("domain_suffixes", f"""SELECT page_id, array_to_string([array_to_string(p[i:], '.') FOR i IN range(1, len(p) + 1)], ' ') AS suffixes,
 CASE WHEN len(p) >= 2 THEN array_to_string(p[-2:], '.') END AS sld FROM (SELECT page_id, string_split(lower({_PG}), '.') AS p FROM pages)""")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"))
    return d.select("page_id", F.array_join(L.domain_suffixes("host"), " ").alias("suffixes"), L.sld("host").alias("sld"))


_HELLO = """SELECT flow_id, 771 AS ver, array(4865, 2570, CAST(dst_port AS INT)) AS cs, array(0, 23, CAST(flow_id % 7 AS INT)) AS ex, array(29, 23) AS cu, array(0) AS pf FROM {f}"""


@query("ja3_hash", with_views("""SELECT flow_id, md5(concat('771,4865-', dst_port, ',0-23-', flow_id % 7, ',29-23,0')) AS ja3,
 md5(concat('771,4865-2570-', dst_port, ',0-23-', flow_id % 7, ',29-23,0')) AS ja3_raw FROM flows"""))
def _(spark, sf):
    d = spark.sql(_HELLO, f=flows(spark, sf))
    return d.select("flow_id", L.ja3_hash("ver", "cs", "ex", "cu", "pf").alias("ja3"), L.ja3_hash("ver", "cs", "ex", "cu", "pf", False).alias("ja3_raw"))


@query("ja3s_hash", with_views("SELECT flow_id, md5(concat('771,', dst_port, ',0-23-', flow_id % 7)) AS ja3s FROM flows"))
def _(spark, sf):
    return spark.sql(_HELLO, f=flows(spark, sf)).select("flow_id", L.ja3s_hash("ver", F.element_at("cs", 3), "ex").alias("ja3s"))


@query("sni_is_ip", with_views("SELECT flow_id, CASE WHEN sni = '' OR regexp_matches(sni, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') THEN 1 ELSE 0 END AS hit FROM flows"))
def _(spark, sf):
    return flows(spark, sf).select("flow_id", L.sni_is_ip("sni").cast("int").alias("hit"))


TLSV = "CASE lower(tls_version) WHEN 'sslv3' THEN 0.40 WHEN 'tlsv10' THEN 0.25 WHEN '1.1' THEN 0.15 ELSE 0 END"


@query("tls_version_score", with_views(f"SELECT flow_id, CAST({TLSV} AS DOUBLE) AS score FROM tls"))
def _(spark, sf):
    return tls_flows(spark, sf).select("flow_id", L.tls_version_score("tls_version").alias("score"))


@query("byte_entropy", with_views("""SELECT flow_id, round(CASE WHEN sum(c) > 0 THEN -sum(CASE WHEN c > 0 THEN c / t * log2(c / t) ELSE 0 END) ELSE 0 END, 6) + 0.0 AS entropy
 FROM (SELECT flow_id, c, sum(c) OVER (PARTITION BY flow_id) AS t FROM (SELECT flow_id, CAST((flow_id % 5) * ((flow_id + i * i) % 17) AS DOUBLE) AS c FROM flows, range(256) r(i))) GROUP BY flow_id"""))
def _(spark, sf):
    d = flows(spark, sf).select("flow_id", F.expr("transform(sequence(0, 255), i -> (flow_id % 5) * ((flow_id + i * i) % 17))").alias("counts"))
    return d.select("flow_id", L.byte_entropy("counts").alias("entropy"))


# packet lengths and times: regular for some ids, growing for others
_SP_L = "CASE WHEN flow_id % 3 = 0 THEN 100 + (i % 2) WHEN flow_id % 3 = 1 THEN CASE WHEN i % 2 = 0 THEN 1400 + flow_id % 50 ELSE 90 END ELSE 60 + (flow_id * i) % 700 END"
_SP_T = "CASE WHEN flow_id % 4 = 0 THEN i * 12.0 WHEN flow_id % 4 = 1 THEN i * 11.0 + (i % 2) * 1.5 ELSE ((flow_id * i) % 13) * 1.0 END"


@query("splt_score", with_views(f"""WITH a AS (SELECT flow_id, i, CAST({_SP_L} AS DOUBLE) AS l, CAST({_SP_T} AS DOUBLE) AS t FROM flows, range(8) r(i)),
 g AS (SELECT flow_id, t - lag(t) OVER (PARTITION BY flow_id ORDER BY i) AS gap FROM a),
 ls AS (SELECT flow_id, avg(l) m, stddev_pop(l) s, avg(l) FILTER (i % 2 = 0) oa, avg(l) FILTER (i % 2 = 1) ia FROM a GROUP BY flow_id),
 gs AS (SELECT flow_id, count(*) n, avg(gap) m, stddev_pop(gap) s FROM g WHERE gap > 0 GROUP BY flow_id)
 SELECT ls.flow_id, round(CAST(least(CASE WHEN ls.s/ls.m < 0.05 AND ls.m < 500 THEN 0.35 WHEN ls.s/ls.m < 0.10 AND ls.m < 200 THEN 0.20 ELSE 0 END
  + CASE WHEN gs.n >= 4 AND gs.m > 0.1 THEN CASE WHEN gs.s/gs.m < 0.05 AND gs.m > 5 THEN 0.30 WHEN gs.s/gs.m < 0.15 AND gs.m > 10 THEN 0.15 ELSE 0 END ELSE 0 END
  + CASE WHEN oa > 0 AND ia > 0 AND oa/ia > 10 AND oa > 1000 THEN 0.25 ELSE 0 END, 0.5) AS DOUBLE), 6) + 0.0 AS score FROM ls LEFT JOIN gs USING (flow_id)"""))
def _(spark, sf):
    d = flows(spark, sf).select("flow_id", F.expr(f"transform(sequence(0, 7), i -> CAST({_SP_L} AS DOUBLE))").alias("ln"),
                                F.expr(f"transform(sequence(0, 7), i -> CAST({_SP_T} AS DOUBLE))").alias("tm"))
    return d.select("flow_id", L.splt_score("ln", "tm").alias("score"))


@query("bank_lookalike", with_views("SELECT flow_id, CASE WHEN contains(lower(sni), 'hdfc-secure') THEN 'hdfc-secure' END AS pattern FROM flows"))
def _(spark, sf):
    return flows(spark, sf).select("flow_id", L.bank_lookalike("sni").alias("pattern"))


_HOST = "concat(CASE flow_id % 7 WHEN 0 THEN 'mesu.apple.com' WHEN 1 THEN 'x.ctldl.windowsupdate.com' WHEN 2 THEN 'n0.meraki.com' WHEN 3 THEN 'MTALK.google.com' WHEN 4 THEN 'esm.ubuntu.com' ELSE 'plain.example' END, '')"


@query("sni_device_hint", with_views("""SELECT flow_id, CASE flow_id % 7 WHEN 0 THEN 'Apple' WHEN 1 THEN '' WHEN 2 THEN 'Cisco-Meraki' WHEN 3 THEN '' WHEN 4 THEN '' END AS vendor,
 CASE flow_id % 7 WHEN 0 THEN 'macOS/iOS' WHEN 1 THEN 'Windows' WHEN 2 THEN '' WHEN 3 THEN 'Android' WHEN 4 THEN 'Linux' END AS os,
 CASE flow_id % 7 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'router' WHEN 3 THEN 'phone' WHEN 4 THEN '' END AS device_type FROM flows"""))
def _(spark, sf):
    d = flows(spark, sf).select("flow_id", L.sni_device_hint(F.expr(_HOST)).alias("h"))
    return d.select("flow_id", "h.vendor", "h.os", "h.device_type")


@query("ja3_client_hint", with_views(f"SELECT flow_id, {casemap('ja3', {k: v[0] for k, v in V.JA3_CLIENTS.items()}, 'NULL')} AS client, {casemap('ja3', {k: v[1] for k, v in V.JA3_CLIENTS.items()}, 'NULL')} AS os FROM flows"))
def _(spark, sf):
    return flows(spark, sf).select("flow_id", S.lookup("ja3", {k: v[0] for k, v in V.JA3_CLIENTS.items()}).alias("client"),
                                   S.lookup("ja3", {k: v[1] for k, v in V.JA3_CLIENTS.items()}).alias("os"))


_DESC = "CASE flow_id % 8 WHEN 0 THEN 'Cisco IOS Software' WHEN 1 THEN 'HP LaserJet 400' WHEN 2 THEN 'AXIS P1448' WHEN 3 THEN 'Synology DSM 7' WHEN 4 THEN 'Yealink T46' WHEN 5 THEN 'Linux host 5.4' WHEN 6 THEN 'Windows Server' ELSE 'mystery' END"


@query("sysdescr_class", with_views("SELECT flow_id, CASE flow_id % 8 WHEN 0 THEN 'router' WHEN 1 THEN 'printer' WHEN 2 THEN 'camera' WHEN 3 THEN 'nas' WHEN 4 THEN 'voip' WHEN 5 THEN 'server' WHEN 6 THEN 'laptop' END AS cls FROM flows"))
def _(spark, sf):
    return flows(spark, sf).select("flow_id", L.sysdescr_class(F.expr(_DESC)).alias("cls"))


# ── scores ───────────────────────────────────────────────────────────────────
def _lg(p):
    return f"ln(greatest(least({p},1-1e-6),1e-6)/(1-greatest(least({p},1-1e-6),1e-6)))"


@query("logit", with_views("SELECT flow_id, " + sql_round({"lo": _lg("p1"), "cal": f"1/(1+exp(-{_lg('p1')}/{V.TEMPERATURE}))"}) + " FROM flows"))
def _(spark, sf):
    return flows(spark, sf).select("flow_id", S.logit("p1").alias("lo"), S.temperature_scale("p1").alias("cal"))


@query("fuse_logit", with_views("SELECT flow_id, " + sql_round({"p": f"1/(1+exp(-(0.45*{_lg('p1')}+0.50*{_lg('p2')}+0.05*{_lg('p3')})))"}) + " FROM flows"))
def _(spark, sf):
    return flows(spark, sf).select("flow_id", S.fuse_logit(["p1", "p2", "p3"]).alias("p"))


@query("score_stage1", with_views(f"SELECT flow_id, {sql_round({'p': fused_sql()})} FROM flows"))
def _(spark, sf):
    return flows(spark, sf).select("flow_id", S.score_stage1(["p1", "p2", "p3"]).alias("p"))


@query("score_stage1_48", with_views(f"SELECT flow_id, p, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS is_attack, CASE WHEN p >= 0.5 THEN {ladder_sql('p', 'phase3')} ELSE 'BENIGN' END AS severity FROM (SELECT flow_id, {sql_round({'p': fused_sql(temperature=1.3, eps='1e-7')})} FROM flows)"))
def _(spark, sf):
    d = flows(spark, sf).select("flow_id", F.round(S.score_stage1(["p1", "p2", "p3"], temperature=1.3, eps=1e-7) + 1e-9, 6).alias("p"))
    return d.select("flow_id", "p", (F.col("p") >= 0.5).cast("int").alias("is_attack"),
                    F.when(F.col("p") >= 0.5, S.severity_of("p", "phase3")).otherwise("BENIGN").alias("severity"))


@query("severity_of", with_views("SELECT flow_id, " + ", ".join(f"{ladder_sql('p * 8' if n == 'zscore' else 'p', n)} AS s_{n}" for n in V.LADDERS) + " FROM scored"))
def _(spark, sf):
    return scored(spark, sf).select("flow_id", *[S.severity_of(F.col("p") * 8 if n == "zscore" else F.col("p"), n).alias(f"s_{n}") for n in V.LADDERS])


_RK = casemap("severity", V.SEVERITY_RANK, 0)


@query("severity_rank", with_views(f"SELECT id, r AS severity_rank, CASE r WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS bumped FROM (SELECT id, {_RK} AS r FROM alerts)"))
def _(spark, sf):
    from flowlens.plans.flowview import alerts
    return alerts(spark, sf).select("id", S.severity_rank("severity").alias("severity_rank"),
                                    S.severity_name(S.bump(S.severity_rank("severity"))).alias("bumped"))


_TS = f"make_timestamp({START_US} + t_us)"


@query("business_hours", with_views(f"SELECT flow_id, CASE WHEN isodow({_TS}) < 6 AND hour({_TS}) BETWEEN 8 AND 19 THEN 1 ELSE 0 END AS open FROM flows", compress=1))
def _(spark, sf):
    d = flows(spark, sf, 1)
    return d.select("flow_id", S.business_hours(F.timestamp_micros(F.col("t_us") + START_US)).cast("int").alias("open"))


_LT = f"(make_timestamp({START_US} + t_us) + INTERVAL 330 MINUTE)"
_HD = "('2024-01-05','2024-01-15')"


@query("post_holiday", with_views(f"""SELECT flow_id, CASE WHEN strftime({_LT}, '%Y-%m-%d') IN {_HD} OR (strftime({_LT} - INTERVAL 1 DAY, '%Y-%m-%d') IN {_HD} AND hour({_LT}) < 4) THEN 1 ELSE 0 END AS quiet FROM flows""", compress=1))
def _(spark, sf):
    d = flows(spark, sf, 1)
    return d.select("flow_id", S.post_holiday(F.timestamp_micros(F.col("t_us") + START_US), ("2024-01-05", "2024-01-15")).cast("int").alias("quiet"))


# ── expressions and checks by themselves ─────────────────────────────────────
query("sld", "SELECT page_id, CASE WHEN len(p) >= 2 THEN p[-2] || '.' || p[-1] END AS sld FROM (SELECT page_id, string_split(lower(regexp_extract(url, '://([^/?#]*)', 1)), '.') AS p FROM pages)")(
    lambda spark, sf: spark.read.parquet(f"{sf}/pages.parquet").select("page_id", L.sld(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("sld")))
_fe = {x: f"CASE WHEN {x}_flag > 0 THEN {x}_flag / t * ln({x}_flag / t) ELSE 0 END" for x in ("syn", "fin", "rst", "ack", "psh")}
query("flag_entropy", with_views(f"SELECT flow_id, round(CASE WHEN t > 0 THEN -({' + '.join(_fe.values())}) ELSE 0 END, 6) + 0.0 AS flag_entropy FROM (SELECT *, CAST(syn_flag + fin_flag + rst_flag + ack_flag + psh_flag AS DOUBLE) AS t FROM flows)"))(
    lambda spark, sf: flows(spark, sf).select("flow_id", X.flag_entropy().alias("flag_entropy")))
query("temperature_scale", with_views(f"SELECT flow_id, {sql_round({'warm': f'1/(1+exp(-{_lg('p1')}/2.5))', 'cold': f'1/(1+exp(-{_lg('p1')}/0.5))'})} FROM flows"))(
    lambda spark, sf: flows(spark, sf).select("flow_id", S.temperature_scale("p1", 2.5).alias("warm"), S.temperature_scale("p1", 0.5).alias("cold")))
query("bump", with_views(f"SELECT id, CASE {_RK} WHEN 0 THEN 0 WHEN 4 THEN 4 ELSE {_RK} + 1 END AS bumped FROM alerts"))(
    lambda spark, sf: alerts(spark, sf).select("id", S.bump(S.severity_rank("severity")).alias("bumped")))

# an exporter's spelling of the flow columns; `note` is none of ours
EXPORTER = {"src_ip": "Src IP", "dst_ip": "Destination_IP", "dst_port": "dst.port", "protocol": "PROTOCOL", "syn_flag": "SYN Flag Cnt", "psh_flag": "PSH Flag Count", "family": "note"}


@query("map_columns", with_views("SELECT src_ip, dst_port, sum(syn_flag)::BIGINT AS syn, sum(psh_flag)::BIGINT AS psh, count(*) AS n, 'note' AS unmapped FROM flows GROUP BY 1, 2"))
def _(spark, sf):
    d = flows(spark, sf).select(*[F.col(c).alias(n) for c, n in EXPORTER.items()])
    names = X.map_columns(d.columns)
    mapped = d.select(*[F.col(f"`{c}`").alias(names[c]) for c in d.columns if c in names])
    return mapped.groupBy("src_ip", "dst_port").agg(F.sum("syn_flag").alias("syn"), F.sum("psh_flag").alias("psh"), F.count(F.lit(1)).alias("n")).withColumn(
        "unmapped", F.lit(",".join(c for c in d.columns if c not in names)))


@query("validate_schema", with_views("SELECT dst_port, count(*) AS n, 1 AS refused FROM flows GROUP BY 1"))
def _(spark, sf):
    """Canonical rows pass unchanged; without a column they are refused."""
    d = flows(spark, sf).withColumn("ts", F.timestamp_micros(F.col("t_us"))).transform(X.canonical_45)
    d = d.select(*V.CANONICAL_45, *[F.lit("").alias(c) for c in V.METADATA])
    try:
        X.validate_schema(d.drop(V.METADATA[-1]))
        refused = 0
    except ValueError:
        refused = 1
    return X.validate_schema(d).groupBy("dst_port").agg(F.count(F.lit(1)).alias("n")).withColumn("refused", F.lit(refused))
