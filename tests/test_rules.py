"""Hand-evaluated rows on each side of the thresholds."""

import pytest
from pyspark.sql import functions as F

from flowlens import values as V
from flowlens.functions import ip as IP, scores as S, tls as L
from flowlens.operators import aggregates as A, detect as D, features as X, joins as J, output as O, setops as So
from flowlens.sources import feeds, flowfiles, zeek
from flowlens.streaming import flow


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("ip,scope,public,nonuni", [
    ("203.0.113.1", "external", False, False), ("100.64.0.1", "internal", True, False), ("192.168.1.255", "internal", False, True),
    ("239.1.1.1", "external", False, True), ("fe80::1", "internal", False, True), ("abc", "invalid", False, False), ("", "invalid", False, False),
    ("1.2.3.04", "invalid", False, False), ("2404:6800::1", "external", True, False), ("::ffff:8.8.8.8", "external", True, False),
    ("::ffff:10.0.0.1", "external", False, False), ("fc00::1", "internal", False, False), ("2001:db8::1", "external", False, False),
    ("1::2::3", "invalid", False, False), ("1:2:3:4:5:6:7:8", "external", False, False), ("172.32.0.1", "external", True, False), ("8.8.8.8", "external", True, False)])
def test_addresses(spark, ip, scope, public, nonuni):
    c = F.lit(ip)
    r = spark.range(1).select(IP.ip_scope(c).alias("s"), IP.ip_is_public(c).alias("p"), IP.is_non_unicast(c).alias("n")).first()
    assert (r["s"], r["p"], r["n"]) == (scope, public, nonuni)


@pytest.mark.parametrize("name", list(V.LADDERS))
def test_ladders(spark, name):
    for sev, floor in V.LADDERS[name]:
        assert one(spark, S.severity_of(F.lit(floor), name)) == sev
        assert one(spark, S.severity_of(F.lit(floor - 1e-9), name)) != sev


def test_bump_and_sni(spark):
    assert [one(spark, S.bump(F.lit(i))) for i in range(5)] == [0, 2, 3, 4, 4]
    for text, hit in (("", True), ("10.0.0.1", True), ("[::1]", True), ("LOCALHOST", True), ("example.com", False)):
        assert one(spark, L.sni_is_ip(F.lit(text))) is hit


def test_post_holiday(spark):
    at = lambda t: one(spark, S.post_holiday(F.lit(t).cast("timestamp")))
    assert at("2026-11-11 19:00:00") is True   # 00:30 local on the 12th, the day after
    assert at("2026-11-11 22:29:59") is True   # 03:59 local
    assert at("2026-11-11 22:30:00") is False  # 04:00 local
    assert at("2026-11-09 18:29:59") is False


def test_business_hours(spark):
    at = lambda t: one(spark, S.business_hours(F.lit(t).cast("timestamp")))
    assert [at(f"2024-01-02 {h:02d}:30:00") for h in (7, 8, 19, 20)] == [False, True, True, False]
    assert at("2024-01-06 12:00:00") is False


FLOW = {"flow_id": 1, "t_us": 0, "src_ip": "192.168.20.5", "dst_ip": "93.184.1.1", "src_port": 5000, "dst_port": 443, "protocol": 6, "duration": 1.0, "fwd_packets": 1,
        "bwd_packets": 1, "fwd_bytes": 100, "bwd_bytes": 28, "syn_flag": 0, "fin_flag": 0, "rst_flag": 0, "ack_flag": 0, "psh_flag": 0, "sni": "x.example", "ja3": "",
        "device_type": "unknown", "department": "Finance"}


def flows(spark, *changes):
    rows = [{**FLOW, "flow_id": i, **c} for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r.values()) for r in rows], list(FLOW)).withColumn("ts", F.lit("2024-01-02 12:00:00").cast("timestamp"))


def test_canonical_edges(spark):
    d = flows(spark, {}, {"duration": 0.999}, {"duration": 600.0}, {"duration": 600.001}, {"fwd_bytes": 100, "bwd_bytes": 28}, {"fwd_bytes": 100, "bwd_bytes": 27},
              {"fwd_bytes": 2800, "bwd_bytes": 0}, {"fwd_bytes": 2801, "bwd_bytes": 0}, {"duration": -5.0, "fwd_bytes": -3})
    r = d.transform(X.canonical_45, keep=["flow_id"]).orderBy("flow_id").collect()
    assert [x["short_session_flag"] for x in r[:2]] == [0, 1]
    assert [x["long_session_flag"] for x in r[2:4]] == [0, 1]
    assert [x["small_packet_flag"] for x in r[4:6]] == [0, 1]
    assert [x["large_packet_flag"] for x in r[6:8]] == [0, 1]
    assert r[0]["flag_entropy"] == 0.0 and r[8]["duration"] == 0.0 and r[8]["fwd_bytes"] == 0.0
    assert list(r[0].asDict())[1:] == V.CANONICAL_45


def test_validate_schema(spark):
    good = spark.createDataFrame([tuple([0.0] * 53)], V.CANONICAL_45 + V.METADATA)
    assert X.validate_schema(good) is good
    with pytest.raises(ValueError):
        X.validate_schema(good.select(*reversed(good.columns)))


def test_map_columns():
    names = {"Src IP": "src_ip", "id.orig_h": "src_ip", "IPV4_DST_ADDR": "dst_ip", "Destination Port": "dst_port", "L4_SRC_PORT": "src_port", "Protocol Type": "protocol",
             "Flow Duration": "duration", "Tot Fwd Pkts": "fwd_packets", "Total Backward Packets": "bwd_packets", "TotPkts": "total_packets", "orig_bytes": "fwd_bytes",
             "TotLen Bwd Pkts": "bwd_bytes", "Total Bytes": "total_bytes", "Flow Byts/s": "bytes_per_sec", "Flow Packets/s": "packets_per_sec", "Fwd Pkts/s": "fwd_packets_per_sec",
             "Pkt Len Min": "pkt_size_min", "Packet Length Max": "pkt_size_max", "Pkt Size Avg": "pkt_size_mean", "flow_pkts_payload.std": "pkt_size_std", "Flow IAT Mean": "iat_mean",
             "flow_iat.max": "iat_max", "Fwd IAT Tot": "fwd_iat_total", "SYN Flag Cnt": "syn_flag", "flow_RST_flag_count": "rst_flag", "tcp.flags.ack": "ack_flag",
             "Fwd PSH Flags": "psh_flag", "Header_Length": "header_len", "Init Fwd Win Byts": "init_fwd_win", "server_name": "sni", "ja3_hash": "ja3", "BytesPerPkt": "bytes_per_packet"}
    names |= {"tcp.dstport": "dst_port", "bytes_per_pkt": "pkt_size_mean", "Bytes Per Pkt": "bytes_per_packet", "dpkts": "bwd_packets", "FlowDuration": "duration", "Syn": "syn_flag",
              "PSH_FLAG": "psh_flag", "Bwd Packets/s": "bwd_packets_per_sec", "ServerName": "sni", "HTTPS": "is_https"}
    assert X.map_columns(list(names) + ["unrelated", "Label", "Flow ACK", "TCP Connection Protocol", "TCP Flags SYN"]) == names
    assert X.map_columns(["Label", "sa"], {"Label": "sni", "sa": "dst_ip"}) == {"Label": "sni", "sa": "dst_ip"}


def test_duplicate_sources_coalesce(spark):
    d = spark.createDataFrame([(None, 7)], "`Src Port` int, sport int").transform(X.normalize_universal)
    assert d.first()["src_port"] == 7


def test_normalize_directional_suppression_comes_last(spark):
    d = flows(spark, {}).transform(X.canonical_45, keep=["flow_id"]).transform(X.suppress_directional, when=F.lit(True)).first()
    assert d["fwd_bwd_byte_ratio"] == d["fwd_bwd_pkt_ratio"] == d["fwd_byte_ratio"] == 0.0


def policy(spark, **change):
    return D.policy_eval(flows(spark, change)).first()


def test_policy_order_and_exfiltration(spark):
    r = policy(spark, dst_port=9001, department="Sales", fwd_bytes=10_000_000)
    assert (r["policy_severity"], r["policy_category"]) == ("HIGH", "tor")
    r = policy(spark, dst_port=9001, department="Sales", fwd_bytes=10_000_001)
    assert (r["policy_severity"], r["policy_category"]) == ("CRITICAL", "exfiltration")
    # an authorised tunnel is no violation by itself but still counts for exfiltration
    r = policy(spark, dst_port=1194, department="IT", fwd_bytes=10_000_001)
    assert (r["policy_category"], len(r["policy_reasons"])) == ("exfiltration", 1)
    r = policy(spark, dst_port=9001, dst_ip="192.168.1.9")
    assert r["violation"] is False and r["policy_boost"] == 0.0
    r = policy(spark, dst_port=22, device_type="printer", department="Guest")
    assert (r["policy_category"], r["policy_boost"]) == ("device_port_violation", 0.5)
    r = policy(spark, dst_port=1194, device_type="iot", department="Guest")  # a tunnel by an appliance
    assert r["policy_category"] == "device_restriction"


def test_peer_signal_levels(spark):
    b = spark.createDataFrame([("Finance", 20, 3, True, 10.0, 1.0, 5.0, 1.0, 100.0, 10.0, 0.5, 0.1)],
                              "department string, n_samples int, members int, is_ready boolean, mean_fpm double, std_fpm double, mean_unique_dst double, std_unique_dst double, mean_bytes_per_flow double, std_bytes_per_flow double, mean_send_ratio double, std_send_ratio double")
    rows = [(1, "Finance", 12.9, 5.0, 100.0, 0.5), (2, "Finance", 13.0, 5.0, 100.0, 0.5), (3, "Finance", 15.0, 10.0, 150.0, 0.5), (4, "Finance", 10.0, 5.0, 100.0, 0.9), (5, "Sales", 99.0, 5.0, 100.0, 0.5)]
    d = spark.createDataFrame(rows, "flow_id int, department string, fpm double, unique_dst double, bytes_per_flow double, send_ratio double")
    got = {r["flow_id"]: round(r["peer_score"], 6) for r in D.peer_deviation(d, b).collect()}
    assert got == {1: 0.0, 2: 0.20, 3: 0.90, 4: 0.30 if 0.4 / 0.1 >= 4.0 else 0.10, 5: 0.0}


def test_suppression_at_expiry(spark):
    a = spark.createDataFrame([(1, "a", "x", 99), (2, "a", "x", 100), (3, "a", "y", 50)], "id int, src_ip string, attack_type string, t_us long")
    s = spark.createDataFrame([("a", "x", 100)], "src_ip string, attack_type string, expires_us long")
    assert sorted(r["id"] for r in J.join_suppression(a, s).collect()) == [2, 3]


def test_pattern_confidence_band(spark):
    a = spark.createDataFrame([(i, "x", "10.0.0.1", "1.2.3.4", 80, "HIGH") for i in range(1)], "id int, attack_type string, src_ip string, dst_ip string, dst_port int, severity string")
    pat = lambda c: spark.createDataFrame([(1, "x", "10.0.*", "", 0, c)], "id int, attack_type string, src_pattern string, dst_pattern string, dst_port int, confidence double")
    assert [(r["severity"], r["attack_type"]) for r in J.join_fp_pattern(a, pat(0.49)).collect()] == [("HIGH", "x")]
    assert [(r["severity"], r["attack_type"]) for r in J.join_fp_pattern(a, pat(0.5)).collect()] == [("LOW", "Other")]
    assert J.join_fp_pattern(a, pat(0.8)).count() == 0


def test_longest_prefix_wins(spark):
    nets = spark.createDataFrame([("10.0.0.0/8", "wide"), ("10.1.0.0/16", "mid"), ("10.1.2.0/24", "narrow")], "cidr string, department string")
    d = spark.createDataFrame([("10.9.9.9",), ("10.1.9.9",), ("10.1.2.3",), ("11.0.0.1",), ("x",)], "src_ip string")
    assert {r["src_ip"]: r["department"] for r in J.join_subnet_dept(d, nets).collect()} == {
        "10.9.9.9": "wide", "10.1.9.9": "mid", "10.1.2.3": "narrow", "11.0.0.1": "Unknown", "x": "Unknown"}


def test_welford_merge_is_direct(spark):
    d = spark.range(100).select(F.lit("e").alias("k"), (F.col("id") * F.col("id") % 37).cast("double").alias("m"), F.col("id").alias("t_us"))
    kw = {"entity": "k", "entity_type": "x", "metrics": ["m"]}
    whole = A.agg_welford(d, **kw).first()
    parts = A.merge_welford(A.agg_welford(d.filter("t_us < 13"), **kw), A.agg_welford(d.filter("t_us >= 13"), **kw)).first()
    assert (parts["n"], parts["first_us"], parts["last_us"]) == (100, 0, 99)
    assert (parts["mean"], parts["m2"]) == pytest.approx((whole["mean"], whole["m2"]))


def test_routes():
    assert So.intersect_features(["Dur", "tcp.len"]) == ["spec2_botnet", "spec3_iot"]
    assert So.intersect_features(["other"]) == list(V.SPECIALIST_ROUTES)


def test_zeek_headers_per_file(spark, tmp_path):
    (tmp_path / "a.log").write_text("#separator \\x09\n#fields\tts\tuid\tproto\n1.0\tC1\ttcp\n2.0\tC2\t-\nbroken\trow\n#close\tx\n")
    (tmp_path / "b.log").write_text("#fields\tuid\tts\n" + "C3\t3.0\n(empty)\t4.0\n")
    got = {(r["uid"], r["ts"], r["proto"]) for r in zeek.src_zeek_tsv(spark, str(tmp_path)).collect()}
    assert got == {("C1", "1.0", "tcp"), ("C2", "2.0", None), ("C3", "3.0", None), (None, "4.0", None)}


def test_zeek_stream_by_header(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()
    head = ("ts uid id.orig_h id.orig_p id.resp_h id.resp_p proto service duration orig_bytes resp_bytes conn_state local_orig "
            "local_resp missed_bytes history orig_pkts orig_ip_bytes resp_pkts resp_ip_bytes tunnel_parents").split()
    row = dict(zip(head, "1.5 C1 10.0.0.1 5000 10.0.0.2 443 tcp ssl 0.5 10 20 SF T T 0 ShAD 3 130 4 180 -".split()))
    write = lambda name, names, rows: (logs / name).write_text("#separator \\x09\n#fields\t" + "\t".join(names) + "\n" + "".join("\t".join(r[n] for n in names) + "\n" for r in rows))
    write("conn.1.log", head, [row, row | {"uid": "C2", "history": "-"}])
    write("conn.2.log", head[::-1], [row | {"uid": "C3"}])
    with open(logs / "conn.2.log", "a") as f:
        f.write("short\trow\n\n#close\tx\n")
    (logs / "conn.3.log").write_text("no\theader\n")
    (logs / "ssl.1.log").write_text("#fields\tts\tuid\n1.0\tC9\n")
    flow.run_available(zeek.src_zeek_stream(spark, str(logs), "conn", files_per_trigger=1), write=zeek.zeek_landing(f"{out}/rows", f"{out}/rejected"))
    rows = flow.collected(spark, f"{out}/rows", zeek.landed_schema("conn"))
    assert {(r["uid"], r["id.orig_h"], r["history"], r["resp_ip_bytes"], r["event_time"] is not None) for r in rows.collect()} == {
        ("C1", "10.0.0.1", "ShAD", "180", True), ("C2", "10.0.0.1", None, "180", True), ("C3", "10.0.0.1", "ShAD", "180", True)}
    assert {r["value"] for r in spark.read.parquet(f"{out}/rejected").collect()} == {"short\trow", "no\theader"}


def test_row_numbers_without_global_sort(spark):
    d = flowfiles.number_rows(spark.range(0, 50, 1, 5).withColumnRenamed("id", "x"), "i")
    assert sorted((r["x"], r["i"]) for r in d.collect()) == [(i, i + 1) for i in range(50)]


def test_feed_lines(spark, tmp_path):
    p = tmp_path / "ips.txt"
    p.write_text("# head\n\n1.2.3.4 note\n5.6.7.8,x\n8.8.8.8\nhost.example\n999.1.1.1\n")
    got = {r["ip"] for r in feeds.src_feed_ip_list(spark, str(p), feed="f", category="c", severity="LOW").collect()}
    assert got == {"1.2.3.4", "5.6.7.8", "999.1.1.1"}  # the pattern checks digits only
    q = tmp_path / "urls.txt"
    q.write_text("http://Bad.Example/x\nhttps://github.com/a\nnot a url\n")
    urls, dom = feeds.src_feed_url_list(spark, str(q), feed="u", category="c", severity="HIGH")
    assert urls.count() == 3 and [r["domain"] for r in dom.collect()] == ["bad.example"]


def test_alert_shape(spark):
    d = spark.createDataFrame([(0.4, 0.2, 0.0, 0.6, ["Rule: a", "b"]), (0.5, 0.0, 0.0, 0.1, ["Rule: a"]), (0.9, 0.9, 0.9, 0.9, ["b"])],
                              "ml_score double, ueba_score double, rule_score double, eta_score double, reasons array<string>")
    r = O.shape_alerts(d).collect()
    assert [(x["final_score"], x["rule_names"], x["ueba_reasons"], x["correlated"]) for x in r] == [
        (0.6, ["Rule: a"], ["b"], False), (0.5, ["Rule: a"], [], True), (0.9, [], ["b"], False)]


def test_models_learn_and_fuse(spark):
    from flowlens.operators import models as M
    d = spark.range(600).select(((F.col("id") * 37) % 100 / 100).alias("a"), ((F.col("id") * 61) % 97 / 97).alias("b")).withColumn("label", F.when(F.col("a") > 0.5, 1).otherwise(0))
    m = M.fit_stage1(d, features=["a", "b"], gbt=3, trees=5, lr=10, depth=3)
    s = M.score_members(m, d)
    g = M.tune_fusion(s, step=0.5)
    assert sum(g["weights"]) == pytest.approx(1.0)
    hit = s.withColumn("p", S.score_stage1(["p_1", "p_2", "p_3"], g["weights"], g["temperature"])).filter((F.col("p") >= 0.5) == (F.col("label") == 1)).count()
    assert hit >= 560
    fam = d.withColumn("family", F.when(F.col("label") == 1, "x").otherwise("y"))
    out, names = M.family_probabilities(M.fit_stage2(fam, features=["a", "b"], trees=5, depth=3), fam)
    top = D.score_stage2(out.drop("family"), probs="family_probs", classes=names).join(fam.select("a", "b", "family").withColumnRenamed("family", "want"), ["a", "b"])
    assert top.filter("family = want").count() >= 560
