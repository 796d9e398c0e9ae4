"""Detection, scoring and fusion as column expressions over enriched flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowlens import values as V
from flowlens.functions import scores as S, tls as L
from flowlens.functions.ip import ip_is_public, is_external, let
from flowlens.operators.joins import join_ja3_builtin, join_policy_ports
from flowlens.operators.segments import running_totals


def _has(df: DataFrame, name: str, default="") -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def _pack(*items: Column) -> Column:
    """Array of the non-null items, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


# ── encrypted traffic ────────────────────────────────────────────────────────
def eta_score(df: DataFrame, *, bad_ja3: DataFrame) -> DataFrame:
    """Append is_tls, eta_score, tls_anomalies, eta_reasons.

    Score adds fingerprint hits, old protocol versions, certificate faults, direct-to-address
    handshakes, weak ciphers, packet regularity and low byte entropy, at most 1.
    """
    cols = df.columns
    d = join_ja3_builtin(df, bad_ja3)
    if "ja3s" in cols:
        d = join_ja3_builtin(d, bad_ja3, ja3="ja3s", prefix="ja3s")
    sni, subj, port = _has(df, "sni"), _has(df, "cert_subject"), F.col("dst_port")
    on_port = port.isin(V.TLS_PORTS)
    tls = on_port | (_has(df, "ja3") != "") | (_has(df, "ja3s") != "") | (_has(df, "tls_version") != "") | (sni != "") | (subj != "")
    if "cipher_suite" in cols:
        tls = tls | (F.coalesce("cipher_suite", F.lit(0)) != 0)
    ver = L.tls_version_score("tls_version") if "tls_version" in cols else F.lit(0.0)
    selfs = F.coalesce(F.col("cert_self_signed"), F.lit(False)) if "cert_self_signed" in cols else F.lit(False)
    exp = F.coalesce(F.col("cert_expired"), F.lit(False)) if "cert_expired" in cols else F.lit(False)
    mismatch = (subj != "") & (sni != "") & (F.lower(subj) != F.lower(sni))
    direct = on_port & L.sni_is_ip(sni) & ip_is_public("dst_ip")
    weak = F.coalesce(F.col("cipher_suite").isin(list(V.WEAK_CIPHERS)), F.lit(False)) if "cipher_suite" in cols else F.lit(False)
    splt = L.splt_score("splt_lengths", "splt_times") if "splt_lengths" in cols else F.lit(0.0)
    low = (F.coalesce((F.size("byte_distribution") == 256) & (L.byte_entropy("byte_distribution") < 6.0), F.lit(False))
           if "byte_distribution" in cols else F.lit(False))
    ja3 = F.when(F.col("ja3_severity") == "CRITICAL", 0.60).when(F.col("ja3_severity").isNotNull(), 0.40).otherwise(0.0)
    ja3s = F.when(F.col("ja3s_severity").isNotNull(), 0.20).otherwise(0.0) if "ja3s" in cols else F.lit(0.0)
    pts = lambda c, p: F.when(c, p).otherwise(0.0)
    d = d.withColumns({"_ver": ver, "_direct": direct, "_splt": splt, "_low": low})
    total = (ja3 + ja3s + F.col("_ver") + pts(selfs, 0.25) + pts(exp, 0.15) + pts(mismatch, 0.20) + pts(F.col("_direct"), 0.15)
             + pts(weak, 0.15) + F.col("_splt") + pts(F.col("_low"), 0.20))
    name = lambda c, n: F.when(c, F.lit(n))
    anomalies = _pack(name(F.col("_ver") > 0, "old_version"), name(selfs, "self_signed_cert"), name(exp, "expired_cert"),
                      name(mismatch, "cert_sni_mismatch"), name(F.col("_direct"), "direct_to_ip_no_sni"), name(weak, "weak_cipher"))
    reasons = _pack(F.when(F.col("ja3_severity").isNotNull(), F.concat(F.lit("JA3 match: "), F.col("ja3_name"))),
                    name(ja3s > 0, "JA3S match"), name(F.col("_splt") > 0, "SPLT pattern"), name(F.col("_low"), "Low byte entropy"))
    none = F.array().cast("array<string>")
    return d.select(*cols, tls.alias("is_tls"), F.when(tls, F.round(F.least(total, F.lit(1.0)), 4)).otherwise(0.0).alias("eta_score"),
                    F.when(tls, anomalies).otherwise(none).alias("tls_anomalies"), F.when(tls, reasons).otherwise(none).alias("eta_reasons"))


def ja3_pair_match(df: DataFrame) -> DataFrame:
    """Append pair_name, pair_confidence, malware_name, malware_family, malware_severity and
    pair_mismatch (a known client with a server that is not its partner)."""
    pair = F.concat_ws("_", "ja3", "ja3s")
    pairs = V.JA3_PAIRS
    clients = sorted({k.split("_")[0] for k in pairs})
    d = df.withColumns({"pair_name": S.lookup(pair, {k: v[0] for k, v in pairs.items()}),
                        "pair_confidence": S.lookup(pair, {k: v[1] for k, v in pairs.items()}),
                        **{f"malware_{n}": S.lookup("ja3", {k: v[i] for k, v in V.JA3_MALWARE.items()})
                           for i, n in enumerate(("name", "family", "severity"))}})
    return d.withColumn("pair_mismatch", F.col("ja3").isin(clients) & (F.coalesce("ja3s", F.lit("")) != "") & F.col("pair_name").isNull())


def ja3_rarity(df: DataFrame, *, rare_below: int = 3) -> DataFrame:
    """Append ja3_entity_new (first use by the source) and ja3_network_rare (few sources use it).

    Both come from aggregates keyed by (source, fingerprint) and by fingerprint.
    """
    used = df.filter(F.col("ja3") != "")
    first = used.groupBy("src_ip", "ja3").agg(F.min(F.struct("t_us", "flow_id")).alias("_f"))
    rare = first.groupBy("ja3").agg(F.count(F.lit(1)).alias("_n"))
    d = df.join(first, ["src_ip", "ja3"], "left").join(rare, "ja3", "left")
    return d.select(*df.columns, F.coalesce(F.col("_f.flow_id") == F.col("flow_id"), F.lit(False)).alias("ja3_entity_new"),
                    F.coalesce(F.col("_n") < rare_below, F.lit(False)).alias("ja3_network_rare"))


def dns_tls_check(df: DataFrame, *, hardcoded_boost: float = 0.15, fronting_boost: float = 0.35) -> DataFrame:
    """Append hardcoded_ip, domain_fronting and dns_boost; needs dns_resolved of `join_dns_asof`."""
    tls = (F.col("dst_port").isin(V.TLS_PORTS)) & is_external("dst_ip")
    known = F.col("dns_resolved").isNotNull()
    hard = tls & ~known
    front = tls & known & (F.coalesce("sni", F.lit("")) != "") & (F.lower("sni") != F.lower("dns_resolved"))
    return df.withColumns({"hardcoded_ip": hard, "domain_fronting": front,
                           "dns_boost": F.when(front, fronting_boost).when(hard, hardcoded_boost).otherwise(0.0)})


def intel_gate(df: DataFrame) -> DataFrame:
    """Append gate_action, gate_severity, gate_source, gate_attack, ti_boost, ti_severity,
    eta_pure, eta_anomaly_count, intel_boost.

    Uses whitelisted, best_hit, tls_anomalies, eta_score, and where present the fingerprint
    pair and DNS columns. The first rule that fires decides.
    """
    c = df.columns
    best = F.col("best_hit.severity")
    hot = best.isin("CRITICAL", "HIGH")
    pair = (F.coalesce(F.col("pair_confidence") >= 0.95, F.lit(False)) if "pair_confidence" in c else F.lit(False))
    mal = (F.coalesce((F.col("malware_severity") == "CRITICAL") & ~F.col("pair_mismatch"), F.lit(False)) if "malware_severity" in c else F.lit(False))
    front = (F.col("domain_fronting") & (F.col("dns_boost") >= 0.35)) if "domain_fronting" in c else F.lit(False)
    dns = F.col("dns_boost") if "dns_boost" in c else F.lit(0.0)
    soft = F.col("ja3_boost") if "ja3_boost" in c else F.lit(0.0)
    white = F.col("whitelisted") if "whitelisted" in c else F.lit(False)
    hot = F.coalesce(hot, F.lit(False))
    now = hot | pair | mal | front
    n = F.size("tls_anomalies")
    go = ~white & ~now
    ti = F.when(go & best.isNotNull(), 0.15).otherwise(0.0)
    eta = F.when(go & (n > 0) & (F.col("eta_score") > 0), F.least(n * 0.10, F.lit(0.25))).otherwise(0.0)
    text = lambda name: F.col(name) if name in c else F.lit(None).cast("string")
    d = df.withColumns({
        "gate_action": F.when(white, "SKIP_BENIGN").when(now, "ALERT_IMMEDIATE").otherwise("CONTINUE"),
        "gate_severity": F.when(white, "BENIGN").when(hot, best).when(pair | mal, "CRITICAL").when(front, "HIGH").otherwise("BENIGN"),
        "gate_source": F.when(white, "whitelist").when(hot, "threat_intel").when(pair, "ja3_pair_match").when(mal, "ja3_match").when(front, "domain_fronting").otherwise(""),
        "gate_attack": F.when(white, "").when(hot, F.coalesce("best_hit.category", F.lit("Known_Threat"))).when(pair, text("pair_name"))
        .when(mal, text("malware_name")).when(front, "Domain_Fronting").otherwise(""),
        "gate_confidence": F.when(white | ~now, 0.0).when(hot, 0.99).when(pair, F.col("pair_confidence") if "pair_confidence" in c else F.lit(0.0)).when(mal, 0.95).otherwise(0.90),
        "ti_boost": ti, "ti_severity": F.when(ti > 0, best).otherwise(""), "eta_pure": eta,
        "eta_anomaly_count": F.when(eta > 0, n).otherwise(0)})
    return d.withColumn("intel_boost", F.when(go, F.least(F.col("ti_boost") + soft + dns + F.col("eta_pure"), F.lit(0.50))).otherwise(0.0))


# ── models on probability columns ────────────────────────────────────────────
def route_stage2(df: DataFrame, *, p="p", tau: float = V.TAU_LOW) -> DataFrame:
    """Append label and confidence: attack at or above the low threshold."""
    att = F.col(p) >= tau
    return df.withColumns({"label": F.when(att, "attack").otherwise("benign"),
                           "confidence": F.round(F.when(att, F.col(p)).otherwise(1.0 - F.col(p)), 6)})


def score_stage2(df: DataFrame, *, probs: str, classes=tuple(V.FAMILIES)) -> DataFrame:
    """Append family and family_confidence of the largest class probability (first wins)."""
    top = F.array_max(probs)
    names = F.array(*[F.lit(c) for c in classes])
    return df.withColumns({"family": F.element_at(names, F.array_position(probs, top).cast("int")), "family_confidence": top})


def ml_result(df: DataFrame, *, p="p", family="family", tau: float = V.TAU_LOW) -> DataFrame:
    """Append is_attack, ml_type, ml_severity, ml_source, ml_score."""
    att = F.col(p) >= tau
    fam = F.coalesce(F.col(family), F.lit("")) != ""
    return df.withColumns({
        "is_attack": att, "ml_type": F.when(att & fam, F.col(family)).when(att, "Unclassified").otherwise("BENIGN"),
        "ml_severity": F.when(att, S.severity_of(p, "cascade")).otherwise("BENIGN"),
        "ml_source": F.when(att & fam, "stage2_family").otherwise("stage1_binary"), "ml_score": F.round(F.col(p), 6)})


def apply_intel_boost(df: DataFrame) -> DataFrame:
    """A benign flow whose probability plus boost exceeds 0.50 becomes a MEDIUM TLS suspicion."""
    flip = ~F.col("is_attack") & (F.col("intel_boost") > 0) & (F.col("ml_score") + F.col("intel_boost") > 0.50)
    return df.withColumns({"is_attack": F.col("is_attack") | flip, "ml_severity": F.when(flip, "MEDIUM").otherwise(F.col("ml_severity")),
                           "ml_type": F.when(flip, "TLS_Suspicious").otherwise(F.col("ml_type")),
                           "ml_source": F.when(flip, "intel_boost").otherwise(F.col("ml_source"))})


def _best(arr: Column) -> Column:
    """Element of highest confidence, first on ties."""
    return F.aggregate(F.slice(arr, 2, F.greatest(F.size(arr), F.lit(1))), F.get(arr, F.lit(0)),
                       lambda a, x: F.when(x["confidence"] > a["confidence"], x).otherwise(a))


def binary_gate(df: DataFrame, *, p="p", verdicts="verdicts") -> DataFrame:
    """Specialist verdicts are only consulted above 0.5; benign rows get an empty list."""
    return df.withColumns({"gate_attack": F.col(p) > 0.50,
                           verdicts: F.when(F.col(p) > 0.50, F.col(verdicts)).otherwise(F.filter(verdicts, lambda x: F.lit(False)))})


def consensus_specialists(df: DataFrame, *, p="p", verdicts="verdicts") -> DataFrame:
    """Append consensus_type, consensus_probability, consensus_severity, consensus_source.

    Verdicts are STRUCT(source, label, is_attack, confidence, benign_prob). All benign: strong
    downgrade. One attacker: dampened when another says benign. Same label: boosted.
    Different labels: dampened.
    """
    d = df.withColumn("_at", F.filter(verdicts, lambda v: v["is_attack"] & (v["confidence"] >= 0.50)))
    d = d.withColumns({"_n": F.size("_at"), "_b": _best(F.col("_at")),
                       "_nb": F.size(F.filter(verdicts, lambda v: ~v["is_attack"])),
                       "_nl": F.size(F.array_distinct(F.transform("_at", lambda v: v["label"])))})
    bc, n = F.col("_b.confidence"), F.col("_n")
    prob = (F.when(F.size(verdicts) == 0, F.col(p)).when(n == 0, F.col(p) * 0.40)
            .when(n == 1, F.col(p) * bc * F.when(F.col("_nb") >= 1, 0.90).otherwise(1.0))
            .when(F.col("_nl") == 1, F.col(p) * F.least(bc * (n * 0.10 + 1.05), F.lit(1.0))).otherwise(F.col(p) * bc * 0.85))
    src = (F.when(F.size(verdicts) == 0, "binary_only").when(n == 0, "none_agreed").when(n == 1, F.col("_b.source"))
           .when(F.col("_nl") == 1, F.concat(F.lit("consensus("), F.array_join(F.transform("_at", lambda v: v["source"]), "+"), F.lit(")")))
           .otherwise(F.concat(F.lit("split("), F.col("_b.source"), F.lit(")"))))
    d = d.withColumn("_p", prob)
    return d.withColumns({
        "consensus_type": F.when(F.size(verdicts) == 0, "Unclassified").when(n == 0, "Unknown").otherwise(F.col("_b.label")),
        "consensus_probability": F.round(F.col("_p") + 1e-9, 6),
        "consensus_severity": F.when((F.size(verdicts) > 0) & (n == 0), "LOW").otherwise(S.severity_of("_p", "confidence")),
        "consensus_source": src}).drop("_at", "_n", "_b", "_nb", "_nl", "_p")


def specialist_features(df: DataFrame, *, features, name: str = "features") -> DataFrame:
    """Append an array of the wanted features, by name or alias; null when over half are missing."""
    vals = []
    for f in features:
        found = next((x for x in [f, *V.SPECIALIST_ALIASES.get(f, [])] if x in df.columns), None)
        vals.append(F.col(f"`{found}`").try_cast("double") if found else F.lit(None).cast("double"))
    d = df.withColumn("_raw", F.array(*vals))
    missing = F.size(F.filter("_raw", lambda x: x.isNull()))
    return d.withColumn(name, F.when(missing <= len(vals) * 0.5, F.transform("_raw", lambda x: F.coalesce(x, F.lit(0.0))))).drop("_raw")


# ── policy ───────────────────────────────────────────────────────────────────
def vpn_authorized(*, src="src_ip", dst="dst_ip", department="department") -> Column:
    return (F.col(dst).isin(V.VPN_SERVER_IPS) | F.col(src).isin(V.VPN_AUTHORIZED_IPS)
            | F.coalesce(F.col(department).isin(V.VPN_AUTHORIZED_DEPARTMENTS), F.lit(False)))


VIOLATION = "array<struct<severity:string,category:string,subject:string>>"


def _violation(sev: Column, cat: str | Column, subject: Column) -> Column:
    return F.struct(sev.cast("string").alias("severity"), (F.lit(cat) if isinstance(cat, str) else cat).alias("category"),
                    subject.cast("string").alias("subject"))


def policy_eval(df: DataFrame, *, ts="ts", zone: str = "UTC", tor_exits: DataFrame | None = None, patterns=tuple(V.BANK_LOOKALIKES)) -> DataFrame:
    """Append violation, policy_severity, policy_category, policy_reasons, policy_boost.

    Rules in order: anonymizer, device category and port, department, time, exfiltration,
    exit-node hit, bank lookalike. The highest severity wins, the first on ties. Device and
    department rules are a fixed list, so they unroll into expressions and nothing shuffles.
    """
    d = df.transform(join_policy_ports, tor_exits=tor_exits) if "anonymizers" not in df.columns else df
    auth = vpn_authorized()
    none = F.array().cast(VIOLATION)
    dev = F.lower(F.coalesce("device_type", F.lit("")))
    closed = ~S.business_hours(ts, zone)
    sni = _has(d, "sni")
    exit_hit = F.coalesce(F.col("dst_category") == "anonymizer", F.lit(False)) if "dst_category" in d.columns else F.lit(False)

    def when_any(v, on, forbidden, sev, name):
        """One more violation when `on` holds and an earlier one is of a forbidden category."""
        allow, deny = forbidden
        bad = F.filter(v, lambda x: ~F.lower(x["category"]).isin(allow or [""])
                       & (F.lit("anonymizer" in deny) | F.lower(x["category"]).isin(deny or [""])))
        return F.when(on, let(bad, lambda b: F.when(F.size(b) > 0, F.array(_violation(F.lit(sev), name, F.get(b, F.lit(0))["category"]))).otherwise(none))).otherwise(none)

    def step(rule):
        types, forbidden, ports, sev = rule
        on = dev.isin([t.lower() for t in types])

        def more(v):
            port = (F.when(on & F.col("dst_port").isin(ports), F.array(_violation(F.lit(sev), "device_port_violation", F.col("dst_port")))).otherwise(none)
                    if ports else none)
            return F.concat(v, when_any(v, on, ([], forbidden), sev, "device_restriction") if forbidden else none, port)
        return more

    def departments(v):
        parts = [when_any(v, F.coalesce(F.col("department") == n, F.lit(False)), (allow, forbid), sev, "department_restriction")
                 for n, (allow, forbid, sev) in V.DEPARTMENT_RULES.items()]
        return F.concat(v, *parts)

    def rest(v):
        return F.concat(v, _pack(
            F.when((F.size(v) > 0) & closed, _violation(F.lit("MEDIUM"), "time_escalation", F.lit(""))),
            F.when((F.size("anonymizers") > 0) & (F.col("fwd_bytes") > V.EXFIL_BYTES), _violation(F.lit("CRITICAL"), "exfiltration", F.col("fwd_bytes"))),
            F.when(exit_hit, _violation(F.lit("HIGH"), "tor_exit_node", F.col("dst_ip"))),
            F.when((sni != "") & L.bank_lookalike(sni, patterns).isNotNull(), _violation(F.lit("HIGH"), "credential_harvesting", sni))))

    anon = F.filter("anonymizers", lambda a: ~((a["category"] == "vpn_unauthorized") & auth))
    v = F.transform(anon, lambda a: _violation(a["severity"], a["category"], F.col("dst_ip")))
    # each stage reads the list so far; `let` keeps the expression linear in the number of rules
    for stage in [*[step(r) for r in V.DEVICE_RULES], departments, rest]:
        v = let(v, stage)
    d = d.withColumn("_v", v)
    rank = lambda v: S.severity_rank(v["severity"])
    best = F.aggregate("_v", F.lit(None).cast("struct<severity:string,category:string,subject:string>"),
                       lambda a, x: F.when(a.isNull() | (rank(x) > rank(a)), x).otherwise(a))
    d = d.withColumn("_best", best)
    return d.select(*df.columns, (F.size("_v") > 0).alias("violation"), F.coalesce("_best.severity", F.lit("BENIGN")).alias("policy_severity"),
                    F.coalesce("_best.category", F.lit("")).alias("policy_category"),
                    F.transform("_v", lambda v: F.concat_ws(": ", F.upper(v["category"]), v["subject"])).alias("policy_reasons"),
                    S.lookup("_best.severity", V.POLICY_BOOST, 0.0).alias("policy_boost"))


# ── peers ────────────────────────────────────────────────────────────────────
def _peer_z(v: Column, mean: Column, std: Column) -> Column:
    return F.when(std < 0.01, F.when(F.abs(v - mean) < 0.01, 0.0).otherwise(10.0)).otherwise(F.try_divide(F.abs(v - mean), std))


def peer_deviation(df: DataFrame, baseline: DataFrame, *, group="department") -> DataFrame:
    """Append peer_score and peer_reasons: additive z-scores against a ready department."""
    b = baseline.filter("is_ready")
    stats = [c for c in b.columns if c.startswith(("mean_", "std_"))]
    d = df.join(b.select(group, *[F.col(c).alias("_" + c) for c in stats]), group, "left")
    z = {m: _peer_z(F.col(m), F.col(f"_mean_{m}"), F.col(f"_std_{m}")) for m in ("fpm", "unique_dst", "bytes_per_flow", "send_ratio")}
    # noise in the last digits must not decide a threshold (one outlier in ten has z = 3 exactly)
    d = d.withColumns({f"_z_{m}": F.round(e, 9) for m, e in z.items()})
    step = lambda m, hi, lo: F.when(F.col(f"_z_{m}") >= 5.0, hi).when(F.col(f"_z_{m}") >= 3.0, lo).otherwise(0.0)
    ratio = (F.when((F.col("_z_send_ratio") >= 4.0) & (F.col("send_ratio") > 0.80), 0.30).when(F.col("_z_send_ratio") >= 3.0, 0.10).otherwise(0.0))
    parts = [step("fpm", 0.35, 0.20), step("unique_dst", 0.30, 0.15), step("bytes_per_flow", 0.25, 0.10), ratio]
    known = F.col("_mean_fpm").isNotNull() & F.col("fpm").isNotNull()
    total = F.least(parts[0] + parts[1] + parts[2] + parts[3], F.lit(1.0))
    why = _pack(F.when(parts[0] > 0, F.lit("Peer deviation: rate")), F.when(parts[1] > 0, F.lit("Peer deviation: destinations")),
                F.when(F.col("_z_bytes_per_flow") >= 5, F.lit("Peer deviation: bytes")), F.when(ratio == 0.30, F.lit("Peer deviation: outbound")))
    return d.select(*df.columns, F.when(known, total).otherwise(0.0).alias("peer_score"),
                    F.when(known, why).otherwise(F.array().cast("array<string>")).alias("peer_reasons"))


def cold_start_inherit(entities: DataFrame, own: DataFrame, baseline: DataFrame, *, group="department") -> DataFrame:
    """Baseline per entity: its own, else that of a ready department."""
    m = [c for c in baseline.columns if c.startswith("mean_")]
    d = (entities.join(own.select("src_ip", *[F.col(c).alias("_o_" + c) for c in m]), "src_ip", "left")
         .join(baseline.filter("is_ready").select(group, *[F.col(c).alias("_g_" + c) for c in m]), group, "left"))
    src = F.when(F.col("_o_" + m[0]).isNotNull(), "own").when(F.col("_g_" + m[0]).isNotNull(), "department").otherwise("none")
    return d.select(*entities.columns, src.alias("baseline_source"), *[F.coalesce("_o_" + c, "_g_" + c).alias(c) for c in m])


# ── behaviour ────────────────────────────────────────────────────────────────
def ueba_long_result(df: DataFrame, *, active: bool | Column = True, ts="ts", spike: float = V.UEBA_SPIKE_Z, holidays=tuple(V.HOLIDAYS)) -> DataFrame:
    """Append ueba_alert, ueba_severity, ueba_risk, ueba_anomaly, ueba_verdict, ueba_ready from max_z."""
    on = F.lit(active) if isinstance(active, bool) else active
    z = F.abs("max_z")
    ready = on & F.col("max_z").isNotNull()
    hot = F.coalesce(ready & (z >= spike), F.lit(False))
    return df.withColumns({
        "ueba_ready": ready, "ueba_alert": hot & ~S.post_holiday(ts, holidays),
        "ueba_severity": F.when(hot, S.severity_of(z, "zscore")).otherwise("BENIGN"),
        "ueba_risk": F.when(ready, F.round(F.least(z * F.when(hot, 10).otherwise(2), F.lit(100.0)), 2)).otherwise(0.0),
        "ueba_anomaly": F.when(ready, F.round(F.least(z / 10.0, F.lit(1.0)), 4)).otherwise(0.0),
        "ueba_verdict": F.when(hot, "Behavioral_Anomaly").otherwise("BENIGN"),
        "ueba_reasons": F.when(hot, F.array(F.concat(F.lit("UEBA spike: "), F.col("max_metric"), F.lit(" z="), F.format_number("max_z", 2)))
                               ).otherwise(F.array().cast("array<string>"))})


def anomaly_10_checks(df: DataFrame, *, verdicts: str | None = None) -> DataFrame:
    """Append behaviour_score and behaviour_reasons (names of the checks that fired).

    Needs flow_bytes, z_fpm, z_unique_dst, z_bytes_pf, mean_fpm, the w_* window columns, beacon_n/mean/cv,
    hour_dev, flow_idx, proto_share, proto_in_window, port_is_new, known_ports, mature.
    """
    c = F.col
    n, sr, by = c("w_fpm"), c("w_send_ratio"), c("w_bytes")
    checks = [
        ("rate", F.when(n > 0, F.when(c("z_fpm") >= 8, 0.50).when(c("z_fpm") >= 5, 0.35).when(c("z_fpm") >= 3, 0.20))),
        ("destinations", F.when((c("z_unique_dst") >= 8) & (c("w_unique_dst") >= 20), 0.40).when((c("z_unique_dst") >= 4) & (c("w_unique_dst") >= 10), 0.20)),
        ("new_port", F.when((c("flow_idx") > 100) & c("port_is_new") & (c("known_ports") >= 3) & (c("dst_port") > 0),
                            F.when(c("dst_port").isin(V.BEHAVIOUR_THREAT_PORTS), 0.40).otherwise(0.10))),
        ("failures", F.when(n >= 5, F.when(c("w_failed_ratio") > 0.80, 0.45).when(c("w_failed_ratio") > 0.50, 0.25).when(c("w_failed_ratio") > 0.20, 0.10))),
        ("asymmetry", F.when(by > 500_000, F.when(sr > 0.95, 0.50).when(sr > 0.85, 0.30)).when((by > 50_000) & (sr > 0.90), 0.15)),
        ("beacon", F.when(c("beacon_n") >= 15, F.when((c("beacon_cv") < 0.05) & (c("beacon_mean") > 10), 0.40).when((c("beacon_cv") < 0.15) & (c("beacon_mean") > 30), 0.20))),
        ("hour", F.when((c("hour_dev") >= 1) & (n > F.greatest(c("mean_fpm"), F.lit(0.1)) * 2), 0.25).when((c("hour_dev") >= 0.5) & (n > F.greatest(c("mean_fpm"), F.lit(0.1)) * 3), 0.12)),
        ("volume", F.when(c("flow_bytes") > 0, F.when(c("z_bytes_pf") >= 8, 0.35).when(c("z_bytes_pf") >= 5, 0.25))),
        ("protocol", F.when((c("flow_idx") > 50) & (c("proto_share") < 0.02) & (c("proto_in_window") >= 3), 0.20)),
    ]
    score = F.lit(0.0)
    for _, e in checks:
        score = score + F.coalesce(e, F.lit(0.0))
    fired = [F.when(e.isNotNull(), F.lit(name)) for name, e in checks]
    d = df.withColumns({"_s": score, "_r": _pack(*fired)})
    if verdicts:
        at = attacking(verdicts)
        d = d.withColumn("_at", at)
        conf = F.array_max(F.transform("_at", lambda v: v["confidence"]))
        add = F.when(F.size("_at") >= 2, 0.30).when((F.size("_at") == 1) & (conf >= 0.90), 0.15).when((F.size("_at") == 1) & (conf >= 0.75), 0.05).otherwise(0.0)
        named = (F.size("_at") >= 2) | ((F.size("_at") == 1) & (conf >= 0.90))
        d = d.withColumns({"_s": F.col("_s") + add, "_r": F.when(named, F.concat("_r", F.array(F.lit("specialists")))).otherwise(F.col("_r"))})
        calm = (F.size(verdicts) > 0) & F.forall(verdicts, lambda v: ~v["is_attack"])
        avg = F.try_divide(F.aggregate(verdicts, F.lit(0.0), lambda a, v: a + v["benign_prob"]), F.size(verdicts))
        d = d.withColumn("_s", F.when(calm & (avg > 0.90) & (F.col("_s") < 0.60) & (F.size("_r") < 3), F.greatest(F.lit(0.0), F.col("_s") - 0.15)).otherwise(F.col("_s")))
    return d.select(*df.columns, F.when(c("mature"), F.least("_s", F.lit(1.0))).otherwise(0.0).alias("behaviour_score"),
                    F.when(c("mature"), F.col("_r")).otherwise(F.array().cast("array<string>")).alias("behaviour_reasons"))


def attacking(verdicts: str) -> Column:
    """Verdicts over their specialist's own gate."""
    return F.filter(verdicts, lambda v: v["is_attack"] & (v["confidence"] >= S.lookup(v["source"], V.SPECIALIST_GATES, V.SPECIALIST_GATE_DEFAULT)))


def seven_gates(df: DataFrame, *, verdicts="verdicts") -> DataFrame:
    """Append should_alert, gate_blocked_by, alert_severity, alert_tag, alert_type, sources (gates 2 to 6).

    Needs mature, behaviour_score, behaviour_reasons, window_ratio, window_n, reputation, risk.
    Gate 7, the cooldown, is `dedup_cooldown_300s` on the rows that pass.
    """
    c = F.col
    d = df.withColumn("_at", attacking(verdicts))
    d = d.withColumns({"_sp": F.size("_at") > 0, "_b": _best(F.col("_at")),
                       "_bh": (c("behaviour_score") >= 0.40) & (F.size("behaviour_reasons") >= 2)})
    spec = F.coalesce("_b.confidence", F.lit(0.0))
    n = c("_sp").cast("int") + c("_bh").cast("int") + (c("behaviour_score") >= 0.60).cast("int")
    d = d.withColumns({"_spec": spec, "_n": n, "_conf": F.greatest(spec, c("behaviour_score"))})
    sev = S.severity_of("_conf", "confidence")
    d = d.withColumn("_sev", sev)
    need = F.when(c("_sev").isin("CRITICAL", "HIGH"), 2).otherwise(1)
    sure = (c("_sev") == "CRITICAL") & (c("_spec") >= 0.95)
    blocked = (F.when(~c("mature"), "G2").when(~c("_sp") & ~c("_bh"), "G3").when((c("_n") < need) & (c("_spec") < 0.97), "G4")
               .when(~sure & (c("window_n") >= 5) & (c("window_ratio") < 0.15), "G5")
               .when((c("reputation") < 25) & (c("_sev") != "CRITICAL") & (c("_conf") < 0.85), "G6").otherwise(""))
    d = d.withColumn("gate_blocked_by", blocked)
    conf = F.when(c("_n") >= 3, F.least(c("_conf") * 1.15, F.lit(1.0))).when(c("_n") >= 2, F.least(c("_conf") * 1.10, F.lit(1.0))).otherwise(c("_conf"))
    d = d.withColumn("_c2", conf)
    s2 = F.when(c("_n") >= 2, S.severity_of("_c2", "confidence")).otherwise(c("_sev"))
    d = d.withColumn("_s2", s2)
    final = (F.when((c("risk") >= 80) & (c("_s2") != "CRITICAL"), F.when(c("_c2") >= 0.80, "CRITICAL").otherwise("HIGH"))
             .when((c("risk") >= 60) & (c("_s2") == "MEDIUM"), "HIGH").otherwise(c("_s2")))
    ok = c("gate_blocked_by") == ""
    tag = F.when(c("_sp") & c("_bh"), "CONFIRMED").when(c("_sp"), "SPECIALIST").otherwise("UEBA_OVERRIDE")
    kind = F.when(c("_sp"), c("_b.label")).otherwise(F.coalesce(F.substring(F.get("behaviour_reasons", F.lit(0)), 1, 30), F.lit("unknown")))
    return d.withColumns({"should_alert": ok, "alert_severity": F.when(ok, final).otherwise("BENIGN"), "alert_tag": F.when(ok, tag).otherwise(""),
                          "alert_type": kind, "sources": F.when(ok, c("_n")).otherwise(0)}).drop("_at", "_sp", "_b", "_bh", "_spec", "_n", "_conf", "_sev", "_c2", "_s2")


def confidence_opinions(df: DataFrame) -> DataFrame:
    """Append verdict, attack_conf, attack_class, class_source, class_severity, engines: the
    arbitration before the temporal decision. Needs is_attack, ml_score, ml_type, ueba_ready,
    ueba_score, rule_score, whitelisted."""
    c = F.col
    op = lambda cond, cls, conf, sev, src: F.when(cond, F.struct(conf.alias("confidence"), cls.alias("cls"), sev.alias("severity"), F.lit(src).alias("source")))
    ue = F.least(c("ueba_score"), F.lit(0.95))
    ru = F.least(c("rule_score"), F.lit(1.0))
    ops = _pack(op(c("is_attack") & (c("ml_score") >= 0.55), c("ml_type"), c("ml_score"), S.severity_of("ml_score", "confidence"), "ml_ensemble"),
                op(c("ueba_ready") & (c("ueba_score") > 0.5), F.lit("Behavioral_Anomaly"), ue, S.severity_of(ue, "confidence"), "ueba"),
                op(c("rule_score") >= 0.65, F.lit("Rule_Match"), ru, F.when(c("rule_score") >= 0.85, "CRITICAL").otherwise("HIGH"), "rules"))
    d = df.withColumn("_o", ops)
    d = d.withColumns({"_b": _best(c("_o")), "_k": F.size(F.filter("_o", lambda o: o["severity"] != "BENIGN"))})
    raw = c("_b.confidence")
    two = F.least(raw * 1.1, F.lit(1.0))
    conf = F.when(c("_k") >= 3, F.least(two * 1.15, F.lit(1.0))).when(c("_k") >= 2, two).otherwise(raw)
    gated = raw < 0.55
    d = d.withColumn("_c", conf)
    sev = F.when(c("_k") >= 2, S.severity_of("_c", "confidence")).otherwise(c("_b.severity"))
    v = F.when(c("whitelisted"), "benign-whitelist").when(c("_b").isNull(), "benign-consensus").when(gated, "benign-gated").otherwise("candidate")
    return d.withColumns({
        "verdict": v, "attack_conf": F.when(c("whitelisted"), 1.0).when(c("_b").isNull(), 1.0 - c("ml_score")).when(gated, raw).otherwise(c("_c")),
        "class_severity": F.when(v == "candidate", sev).otherwise("BENIGN"), "attack_class": F.when(v == "candidate", c("_b.cls")),
        "class_source": F.when(c("whitelisted"), "whitelist").otherwise(F.coalesce("_b.source", F.lit("consensus"))), "engines": c("_k")}).drop("_o", "_b", "_k", "_c")


def confidence_classify(df: DataFrame, **window) -> DataFrame:
    """Opinions, then the 60-second temporal decision over all rows that are not whitelisted."""
    from flowlens.operators.windows import temporal_ratio_60s
    d = confidence_opinions(df)
    keep = d.columns
    w = d.filter(~F.col("whitelisted")).withColumns({
        "_att": F.col("is_attack"), "is_attack": F.col("verdict") == "candidate", "confidence": F.col("attack_conf"), "severity": F.col("class_severity")})
    w = temporal_ratio_60s(w, **window)
    done = F.col("verdict") == "candidate"
    w = w.withColumns({"final_verdict": F.when(done, F.when(F.col("temporal_alert"), "attack").otherwise("benign-suppressed")).otherwise(F.col("verdict")),
                       "final_severity": F.when(done & F.col("temporal_alert"), F.col("effective_severity")).otherwise("BENIGN"),
                       "is_attack": F.col("_att")})
    extra = {"window_ratio": F.lit(0.0), "final_verdict": F.lit("benign-whitelist"), "final_severity": F.lit("BENIGN")}
    white = d.filter("whitelisted").withColumns(extra)
    cols = [*keep, *extra]
    return w.select(*cols).unionByName(white.select(*cols))


def final_score_blend(*, ml="ml_score", ueba="ueba_score", rule="rule_score", ready="ueba_ready") -> Column:
    """Weighted score; without a baseline the behaviour weight goes to the model."""
    w = V.BLEND_WEIGHTS
    return F.when(F.col(ready), w["ml"] * F.col(ml) + w["ueba"] * F.col(ueba) + w["rule"] * F.col(rule)).otherwise(
        (w["ml"] + w["ueba"]) * F.col(ml) + w["rule"] * F.col(rule))


# ── fusion ───────────────────────────────────────────────────────────────────
def fuse_signals(df: DataFrame, *, ml_threshold: float = 0.50) -> DataFrame:
    """Append alert, severity, tag, n_signals: highest of up to seven signals, one step up for two or more.

    Signals in order: policy, behaviour, model, rule, soft threat intel, TLS anomaly, peers.
    """
    c = F.col
    sig = lambda cond, sev, tag, i: F.when(F.coalesce(cond, F.lit(False)), F.struct(S.severity_rank(sev).alias("rank"), F.lit(-i).alias("ord"), tag.alias("tag")))
    lit = F.lit
    sigs = _pack(
        sig(c("violation"), c("policy_severity"), F.concat(lit("POLICY_"), F.upper("policy_category")), 0),
        sig(c("ueba_alert"), c("ueba_severity"), lit("UEBA_LONG"), 1),
        sig(c("is_attack") & (c("ml_score") >= ml_threshold), c("ml_severity"), lit("SPECIALIST"), 2),
        sig(c("rule_score") >= 0.85, F.when(c("rule_score") >= 1.0, "CRITICAL").otherwise("HIGH"), lit("RULE_MATCH"), 3),
        sig((c("ti_boost") > 0) & c("ti_severity").isin("MEDIUM", "LOW"), c("ti_severity"), lit("THREAT_INTEL_SOFT"), 4),
        sig((c("eta_pure") >= 0.20) & (c("eta_anomaly_count") >= 2), F.when(c("eta_pure") >= 0.35, "HIGH").otherwise("MEDIUM"), lit("ETA_TLS_ANOMALY"), 5),
        sig(c("peer_score") >= 0.40, F.when(c("peer_score") >= 0.70, "HIGH").otherwise("MEDIUM"), lit("PEER_DEVIATION"), 6))
    d = df.withColumn("_s", sigs)
    d = d.withColumn("_top", F.array_max("_s"))
    rank = F.when(F.size("_s") >= 2, S.bump("_top.rank")).otherwise(c("_top.rank"))
    return d.withColumns({"alert": F.size("_s") > 0, "severity": S.severity_name(F.coalesce(rank, F.lit(0))),
                          "tag": F.coalesce("_top.tag", F.lit("")), "n_signals": F.size("_s")}).drop("_s", "_top")


def tune_threshold(df: DataFrame, *, source: str, p="p", label="label", max_fpr: float = 0.01) -> DataFrame:
    """Per source: the threshold with the best F1 among those with FPR <= max_fpr.

    Scores (six decimals) are counted per source first; running counts over the score order
    are two-level prefixes, so a source with most of the rows is split by score range.
    """
    # order by falling score as an integer
    pos = F.count_if(F.col(label) == 1)
    g = df.groupBy(F.col(source).alias("source"), F.round((1 - F.col(p)) * 1_000_000).cast("long").alias("_o")).agg(
        pos.alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    tot = g.groupBy("source").agg(F.sum("_p").alias("P"), F.sum("_n").alias("N"))
    r = running_totals(g, keys="source", t="_o", rid="_o", bucket_us=1000, sums={"tp": F.col("_p"), "fp": F.col("_n")}).join(tot, "source")
    f1 = F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("P"))
    fpr = F.coalesce(F.try_divide("fp", "N"), F.lit(0.0))
    tau = F.round(1 - F.col("_o") / 1_000_000, 6)
    ok = r.filter(fpr <= max_fpr)
    # higher F1, then the higher threshold
    return ok.groupBy("source").agg(F.max_by(F.struct(tau.alias("tau"), f1.alias("f1"), fpr.alias("fpr")), F.struct(F.round(f1, 9), -F.col("_o"))).alias("b")).select("source", "b.*")
