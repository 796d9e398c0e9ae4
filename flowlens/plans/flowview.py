"""The flow view: network flows derived from the `events` table, and views on it.

Every view exists twice, as a Spark DataFrame and as DuckDB SQL text, so that the
same rows feed a query and its oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens import values as V

START_US = 1704067200000000  # 2024-01-01 UTC

_COMMON = """
 value * 2.0 AS duration, CAST(1 + k % 17 AS BIGINT) AS fwd_packets, CAST((event_id * 7) % 13 AS BIGINT) AS bwd_packets,
 CAST(floor(value * 100) AS BIGINT) AS fwd_bytes, CAST(((event_id * 7) % 13) * (40 + k * 15) AS BIGINT) AS bwd_bytes,
 CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END ELSE 1 END AS syn_flag,
 CASE WHEN event_type IN ('view','click','purchase') THEN 1 ELSE 0 END AS ack_flag,
 CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS rst_flag,
 CASE WHEN event_type IN ('view','purchase') THEN 1 ELSE 0 END AS fin_flag,
 CASE WHEN event_type IN ('click','purchase') THEN 1 ELSE 0 END AS psh_flag
"""
_NETS = "'1','10','20','30','40','50','60'"
_PORTS = "443,443,443,80,53,22,445,3389,9001,1194,4444,8080,9100,554,1883,23"
_SNIS = ("'drive.google.com','a.b.bad-c2.example','hdfc-secure.example','','93.184.1.1',"
         "'portal.gov.in','cdn.shop.example','sub.evil.test'")
_JA3S = ("'b32309a26951912be7dba376398abc3b','72a589da586844d7f0818ce684948eea','',"
         "'51c64c77e60f3980eea90869b68c58a8','ec74a5c51106f0419184d0dd08fb05bc',"
         "'37f463bf4616ecd445d4a1937da06e19','0123456789abcdef0123456789abcdef'")
_FAMS = ("'Mirai','Recon','BruteForce','Okiru','Hajime','WannaCry','Other','Neris',"
         "'Unclassified','TLS_Suspicious'")


def _flow_select(pick, dbl: str) -> str:
    """Outer SELECT of the flow view; `pick` builds a list element access."""
    return f"""
SELECT flow_id, t_us, src_ip, dst_ip, dst_port, src_port, duration, fwd_packets, bwd_packets, fwd_bytes, bwd_bytes,
 syn_flag, ack_flag, rst_flag, fin_flag, psh_flag,
 CASE WHEN dst_port IN (53, 1194) THEN 17 ELSE 6 END AS protocol,
 CASE WHEN dst_port = 443 THEN {pick(_SNIS, 'flow_id % 8')} ELSE '' END AS sni,
 CASE WHEN dst_port = 443 THEN {pick(_JA3S, 'flow_id % 7')} ELSE '' END AS ja3,
 ((flow_id * 37) % 997 + {dbl}) / 997 AS p1, ((flow_id * 61) % 991 + {dbl}) / 991 AS p2,
 ((flow_id * 89) % 983 + {dbl}) / 983 AS p3,
 {pick(_FAMS, 'flow_id % 10')} AS family,
 CASE WHEN flow_id % 10 <> 0 THEN NULL WHEN flow_id % 30 = 0 THEN 'TP' ELSE 'FP' END AS verdict,
 fwd_packets + bwd_packets AS total_packets, fwd_bytes + bwd_bytes AS total_bytes"""


def _spark_pick(items, idx):
    return f"element_at(array({items}), CAST({idx} AS INT) + 1)"


def _duck_pick(items, idx):
    return f"([{items}])[CAST({idx} AS INT) + 1]"


def flows(spark: SparkSession, sf_dir: str, compress: int = 3600, parts: int | None = None) -> DataFrame:
    """Flow view; `compress=1` keeps real time (30 days). parts: events are dealt evenly to so many tasks before they are worked out."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = events if parts is None else events.repartition(parts)
    pick = _spark_pick
    t_us = f"(unix_micros(CAST(ts AS TIMESTAMP)) - {START_US}) DIV {compress}"
    return spark.sql(f"""
WITH base AS (
SELECT event_id AS flow_id, {t_us} AS t_us, event_id, k,
 concat('192.168.', {pick(_NETS, 'user_id % 7')}, '.', CAST(1 + (user_id DIV 7) % 250 AS STRING)) AS src_ip,
 CASE WHEN event_id % 5 = 0 THEN concat('192.168.1.', CAST(1 + k % 20 AS STRING))
      ELSE concat('93.184.', CAST(k % 16 AS STRING), '.', CAST(1 + k AS STRING)) END AS dst_ip,
 {pick(_PORTS, 'k % 16')} AS dst_port, CAST(1024 + (event_id * 7919) % 60000 AS BIGINT) AS src_port,
 {_COMMON}
FROM (SELECT *, CAST(get_json_object(props,'$.k') AS BIGINT) AS k FROM {{events}}))
{_flow_select(pick, '0.5D')} FROM base""", events=events)


def flows_sql(compress: int = 3600) -> str:
    """DuckDB text of the flow view."""
    pick = _duck_pick
    return f"""
SELECT * FROM (WITH base AS (
SELECT event_id AS flow_id, (epoch_us(ts) - {START_US}) // {compress} AS t_us, event_id, k,
 concat('192.168.', {pick(_NETS, 'user_id % 7')}, '.', CAST(1 + (user_id // 7) % 250 AS VARCHAR)) AS src_ip,
 CASE WHEN event_id % 5 = 0 THEN concat('192.168.1.', CAST(1 + k % 20 AS VARCHAR))
      ELSE concat('93.184.', CAST(k % 16 AS VARCHAR), '.', CAST(1 + k AS VARCHAR)) END AS dst_ip,
 {pick(_PORTS, 'k % 16')} AS dst_port, CAST(1024 + (event_id * 7919) % 60000 AS BIGINT) AS src_port,
 {_COMMON}
FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events))
{_flow_select(pick, '0.5::DOUBLE')} FROM base)"""


# ── TLS fields on port-443 flows; one text for both engines ──────────────────
_TLS = """
 CASE WHEN dst_port <> 443 THEN '' WHEN flow_id % 4 = 0 THEN 'TLSv10' WHEN flow_id % 4 = 1 THEN 'TLSv12'
      WHEN flow_id % 4 = 2 THEN 'sslv3' ELSE '1.1' END AS tls_version,
 CASE WHEN dst_port <> 443 THEN '' WHEN flow_id % 3 = 0 THEN 'eb1d94daa7e0344597e756a1fb6e5bce'
      WHEN flow_id % 3 = 1 THEN 'ae4edc6faf64d08308082ad26be60767' ELSE '51c64c77e60f3980eea90869b68c58a8' END AS ja3s,
 CASE WHEN dst_port <> 443 THEN 0 WHEN flow_id % 9 = 0 THEN 10 WHEN flow_id % 9 = 1 THEN 47
      WHEN flow_id % 9 = 2 THEN 4 ELSE 4865 END AS cipher_suite,
 CASE WHEN dst_port <> 443 THEN '' WHEN flow_id % 6 = 0 THEN 'CN=acme' WHEN flow_id % 6 < 3 THEN sni ELSE '' END AS cert_subject,
 CASE WHEN dst_port <> 443 THEN '' WHEN flow_id % 12 = 0 THEN 'CN=acme' ELSE 'CN=ca' END AS cert_issuer,
 CASE WHEN dst_port = 443 AND flow_id % 11 = 0 THEN 'expired' ELSE 'ok' END AS validation_status"""


def tls_flows(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Flows with certificate and handshake columns."""
    f = flows(spark, sf_dir, parts=parts)
    out = spark.sql(f"SELECT *, {_TLS} FROM {{f}}", f=f)
    return (out.withColumn("cert_self_signed", (F.col("cert_subject") == F.col("cert_issuer"))
                           & (F.col("cert_subject") != ""))
            .withColumn("cert_expired", F.col("validation_status") == "expired"))


TLS_SQL = f"""SELECT *, cert_subject = cert_issuer AND cert_subject <> '' AS cert_self_signed,
 validation_status = 'expired' AS cert_expired FROM (SELECT *, {_TLS} FROM flows)"""

# ── fused probability and alert view ─────────────────────────────────────────
_E = "1e-6"


def _lo(p, e=_E):
    c = f"least(greatest({p}, {e}), 1 - {e})"
    return f"ln({c} / (1 - {c}))"


def fused_sql(p1="p1", p2="p2", p3="p3", temperature=V.TEMPERATURE, eps=_E) -> str:
    """Logit-weighted mean of three probabilities, temperature scaled, as SQL."""
    w = V.ENSEMBLE_WEIGHTS
    ens = f"(1 / (1 + exp(-({w[0]} * {_lo(p1, eps)} + {w[1]} * {_lo(p2, eps)} + {w[2]} * {_lo(p3, eps)}))))"
    return f"(1 / (1 + exp(-({_lo(ens, eps)}) / {temperature})))"


def ladder_sql(p: str, name: str) -> str:
    """Severity ladder as SQL."""
    whens = " ".join(f"WHEN {p} >= {t} THEN '{s}'" for s, t in V.LADDERS[name])
    return f"CASE {whens} ELSE '{V.LADDER_FLOOR.get(name, 'BENIGN')}' END"


_ALERT_COLS = f"""
 flow_id AS id, flow_id, t_us, src_ip, dst_ip, dst_port, p AS ml_score, family AS attack_type,
 {ladder_sql('p', 'cascade')} AS severity, 'stage2' AS source, verdict,
 CASE WHEN flow_id % 4 = 0 THEN '' ELSE 'SPECIALIST' END AS tag,
 CASE WHEN flow_id % 9 = 0 THEN 'Rule: Port Sweep' ELSE '' END AS rule_name,
 (flow_id * 13) % 101 / 101.0 AS ueba_score, 0.0 AS rule_score, (flow_id * 17) % 89 / 100.0 AS eta_score,
 p * 100 AS confidence"""
# divisions above are written on integers; cast once so both engines divide as doubles
_ALERT_COLS = (_ALERT_COLS.replace("(flow_id * 13) % 101 / 101.0", "CAST((flow_id * 13) % 101 AS DOUBLE) / 101")
               .replace("(flow_id * 17) % 89 / 100.0", "CAST((flow_id * 17) % 89 AS DOUBLE) / 100")
               .replace("0.0 AS rule_score", "CAST(0 AS DOUBLE) AS rule_score"))


def scored(spark: SparkSession, sf_dir: str, compress: int = 3600) -> DataFrame:
    """Flows with the fused probability p, rounded to six places."""
    return flows(spark, sf_dir, compress).withColumn("p", F.round(F.expr(fused_sql()), 6))


SCORED_SQL = f"SELECT *, round({fused_sql()}, 6) AS p FROM flows"


def alerts(spark: SparkSession, sf_dir: str, compress: int = 3600) -> DataFrame:
    """Alert view: flows with p >= 0.20."""
    s = scored(spark, sf_dir, compress)
    out = spark.sql(f"SELECT {_ALERT_COLS} FROM {{s}} WHERE p >= 0.20", s=s)
    return (out.withColumn("ts", F.timestamp_micros(F.col("t_us") + F.lit(START_US)))
            .withColumn("rule_names", F.expr("CASE WHEN rule_name = '' THEN CAST(array() AS array<string>)"
                                             " ELSE array(rule_name) END")))


ALERTS_SQL = (f"SELECT *, make_timestamp(t_us + {START_US}) AS ts FROM "
              f"(SELECT {_ALERT_COLS} FROM scored WHERE p >= 0.20)")


def with_views(sql: str, compress: int = 3600, extra: dict[str, str] | None = None) -> str:
    """Prefix `sql` with the CTEs it names, so that it runs on the raw tables."""
    ctes = {"flows": flows_sql(compress), "tls": TLS_SQL, "scored": SCORED_SQL, "alerts": ALERTS_SQL}
    ctes.update(extra or {})
    need, text = set(), sql
    for _ in range(20):  # close over dependencies
        for name, body in ctes.items():
            if name not in need and _mentions(text, name):
                need.add(name)
                text += " " + body
    head = ", ".join(f"{n} AS MATERIALIZED ({b})" for n, b in ctes.items() if n in need)
    if not head:
        return sql
    body = sql.lstrip()
    if body.upper().startswith("WITH "):
        body = body[5:].lstrip()
        if body.upper().startswith("RECURSIVE "):
            body = body[10:]
        return f"WITH RECURSIVE {head}, {body}"
    return f"WITH RECURSIVE {head} {body}"


def _mentions(text: str, name: str) -> bool:
    import re
    return re.search(rf"\b(FROM|JOIN|from|join)\s+\(?{name}\b", text) is not None
