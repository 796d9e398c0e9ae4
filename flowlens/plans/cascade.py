"""The whole layered run on a flow table, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowlens import values as V
from flowlens.functions import scores as S
from flowlens.functions.ip import ip_scope
from flowlens.operators import detect as D, features as X, filters as Fl, joins as J, output as O, windows as Wn
from flowlens.session import cut

ROW = "_row_number"
HANDSHAKE = ["tls_version", "ja3s", "cipher_suite", "cert_subject", "cert_issuer", "cert_self_signed", "cert_expired", "validation_status"]


def enrich(df: DataFrame, dims: dict) -> DataFrame:
    """Filters, identity and threat-intelligence columns."""
    # names are judged ahead, as a table whose size is known: flows are not dealt by a few of them
    verdicts = cut(J.domain_verdicts(cut(J.domain_names(df), "names"), dims["bad_domains"], dims["allowed"]), "verdicts")
    d = Fl.flt_non_unicast(df)
    if "runtime_whitelist" in dims:
        d = Fl.flt_runtime_whitelist(d, listed=dims["runtime_whitelist"])
    d = Fl.flag_whitelist(d, **dims.get("whitelist", {}))
    d = J.join_identity(d, dims["devices"], dims.get("subnets"))
    return J.ioc_flow_hits(d, bad_ips=dims["bad_ips"], bad_ja3=dims["bad_ja3"], bad_domains=dims["bad_domains"], allowed=dims["allowed"], verdicts=verdicts)


def cascade(df: DataFrame, dims: dict, *, probability, family: str = "family", ueba_active=True,
            ml_threshold: float = 0.50, holidays=()) -> DataFrame:
    """Alert table of a flow table.

    `dims` names the tables: devices, bad_ips, bad_ja3, bad_domains, allowed, and optionally
    subnets, whitelist, runtime_whitelist, suppressions, fp_patterns, peer_baseline.
    `probability` is a column: the calibrated attack probability of the model stage.
    """
    d = enrich(df, dims)
    # what the gate stops and what goes on share these joins: they are worked out once, and columns that only the handshake score reads end here
    d = cut(D.eta_score(d, bad_ja3=dims["bad_ja3_names"]).transform(D.intel_gate).drop(*HANDSHAKE), "gated")
    now = O.immediate_alert(d)
    d = d.filter("gate_action = 'CONTINUE'").withColumns({"p": F.round(probability, 6), "rule_score": F.lit(0.0)})
    d = D.ml_result(d, family=family).transform(D.apply_intel_boost)
    first_ip = F.get(F.filter("threat_hits", lambda h: (h["type"] == "ip") & (h["direction"] == "dst")), F.lit(0))
    d = D.policy_eval(d.withColumn("dst_category", first_ip["category"]))
    # only what the behaviour layers and the alert rows need goes on, under a number of its own: ids need not be unique
    d = cut(X.ueba_metrics(d).select(
        F.monotonically_increasing_id().alias(ROW), "flow_id", "t_us", "ts", "src_ip", "dst_ip", "dst_port", "department", "total_bytes", "fwd_bytes", *V.UEBA_METRICS,
        "is_attack", "ml_score", "ml_type", "ml_severity", "ml_source", "rule_score", "eta_score", "eta_pure", "eta_anomaly_count",
        "ti_boost", "ti_severity", "violation", "policy_severity", "policy_category", "policy_reasons"), "judged")
    d = D.ueba_long_result(behaviour(d).drop(ROW), active=ueba_active, holidays=holidays)
    peers = dims.get("peer_baseline")
    if peers is not None:
        d = D.peer_deviation(d, peers)
    else:
        d = d.withColumns({"peer_score": F.lit(0.0), "peer_reasons": F.array().cast("array<string>")})
    alerts = O.build_alert(D.fuse_signals(d, ml_threshold=ml_threshold)).unionByName(now)
    if "suppressions" in dims:
        alerts = J.join_suppression(alerts, dims["suppressions"])
    if "fp_patterns" in dims:
        alerts = J.join_fp_pattern(alerts, dims["fp_patterns"])
    return O.shape_alerts(alerts)


def behaviour(d: DataFrame) -> DataFrame:
    """Append the running z and the 60 s metrics of internal sources.

    External sources have no baseline and no peers, and leave no trace in those of departments: their columns are null.
    Sources that are no address have a running z, but no peers. Only what the windows read goes through them; the rows
    meet their results by ROW.
    """
    scope = F.coalesce(ip_scope("src_ip"), F.lit("invalid"))
    rows = d.select(ROW, "flow_id", "t_us", "src_ip", "dst_ip", "department", "total_bytes", "fwd_bytes", *V.UEBA_METRICS).filter(scope != "external")
    found = rows.transform(Wn.ueba_running_z).drop("department", *V.UEBA_METRICS).transform(Wn.entity_metrics_60s)
    metrics = [F.when(scope == "internal", F.col(m)).alias(m) for m in ("fpm", "unique_dst", "bytes_per_flow", "send_ratio")]
    return d.join(found.select(ROW, "score_n", "scored_on_device", "inherited_from", "max_z", "max_metric", *metrics), ROW, "left")


def scored_features(df: DataFrame, *, probs=("p1", "p2", "p3")) -> DataFrame:
    """Log scoring run: 45 features, host windows, stage-1 probability, routing."""
    keep = ["flow_id", "t_us", "src_ip", "dst_ip", *probs]
    d = Wn.host_rolling_60s(df)
    extra = [c for c in d.columns if c.startswith("host_")]
    d = X.canonical_45(d, keep=[*keep, *extra])
    return d.withColumn("p", F.round(S.score_stage1(list(probs)), 6)).transform(D.route_stage2)
