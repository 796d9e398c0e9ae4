"""Rules and dimensions read from files."""

import json

import pytest
from pyspark.sql import functions as F

from flowlens import values as V
from flowlens.operators import detect
from flowlens.operators.policy import policy_by_rules, read_policies
from flowlens.session import scratch_path
from flowlens.sources.dimensions import json_entries, src_dimensions, yaml_lists

FLOW = "flow_id int, ts timestamp, src_ip string, dst_ip string, dst_port int, fwd_bytes long, sni string, ja3 string, device_type string, department string"


def text(spark, content):
    path = scratch_path(spark, "text")
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.text(path)
    return path


def builtin():
    """The fixed rules as a file."""
    return {"anonymizer_detection": {"enabled": True, **{n: {"default_severity": s, "dst_ports": p} for n, s, p in V.ANONYMIZERS}},
            "device_restrictions": {"enabled": True, "rules": [{"device_types": t, "forbidden_categories": c, "forbidden_ports": p, "severity": s} for t, c, p, s in V.DEVICE_RULES]},
            "department_policies": {"enabled": True, "rules": {d: {"allowed_categories": a, "forbidden_categories": c, "severity_boost": s} for d, (a, c, s) in V.DEPARTMENT_RULES.items()}},
            "time_based_policies": {"enabled": True, "business_hours": {"start": V.BUSINESS_START, "end": V.BUSINESS_END}},
            "authorized_vpn": {"authorized_ips": V.VPN_AUTHORIZED_IPS, "authorized_departments": V.VPN_AUTHORIZED_DEPARTMENTS, "authorized_server_ips": V.VPN_SERVER_IPS}}


@pytest.fixture(scope="module")
def flows(spark):
    cases, days = [], ["2024-01-03 12:00:00", "2024-01-03 03:00:00", "2024-01-06 12:00:00"]
    for port in (443, 9001, 4444, 1194, 8080, 22):
        for device in (None, "IP_Camera", "workstation", "printer"):
            for dept in (None, "Finance", "IoT", "Guest", "IT", "Sales"):
                i = len(cases)
                cases.append((i, days[i % 3], "192.168.10.10" if i % 11 == 0 else "192.168.7.7", ["93.1.1.1", "10.0.0.100", "192.168.1.1"][i % 7 % 3], port,
                              20_000_000 if i % 2 else 10, "x.hdfc-secure.y" if i % 13 == 0 else None, V.JA3_TOR[0] if i % 17 == 0 else "", device, dept))
    return spark.createDataFrame(cases, FLOW.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))


def results(df):
    return {r.flow_id: (r.violation, r.policy_severity, r.policy_category, r.policy_reasons, r.policy_boost) for r in df.collect()}


def test_builtin_rules_as_a_file_give_what_they_give_in_code(spark, flows):
    rules = read_policies(spark, text(spark, json.dumps(builtin(), indent=1)))
    assert results(policy_by_rules(flows, rules)) == results(detect.policy_eval(flows))


def test_changed_rules_change_the_result(spark, flows):
    changed = builtin()
    changed["anonymizer_detection"]["tor"]["enabled"] = False
    changed["anonymizer_detection"]["alt"] = {"dst_ports": [8080]}
    del changed["department_policies"], changed["time_based_policies"]
    changed["device_restrictions"]["enabled"] = False
    got = results(policy_by_rules(flows, read_policies(spark, text(spark, json.dumps(changed)))))
    public = {r.flow_id: r for r in flows.filter("dst_ip = '93.1.1.1' AND ja3 = '' AND sni IS NULL AND fwd_bytes < 100").collect()}
    assert {got[i][1:3] for i, r in public.items() if r.dst_port == 9001} == {("BENIGN", "")}
    assert {got[i][1:3] for i, r in public.items() if r.dst_port == 8080} == {("MEDIUM", "alt")}
    assert not {c for _, _, c, _, _ in got.values()} & {"department_restriction", "time_escalation", "device_restriction"}


def test_empty_policies_and_tables(spark, flows):
    rules = read_policies(spark, text(spark, "{}"))
    assert {r[1] for r in results(policy_by_rules(flows.filter("sni IS NULL AND ja3 = ''"), rules)).values()} == {"BENIGN"}
    assert policy_by_rules(flows.limit(0), rules).collect() == []


def test_dimensions_from_files(spark):
    yaml = text(spark, "a: 1  # not a list\nholidays:\n  - \"2024-01-01\" # new year\n  # - 2024-02-02\n\n  - 2024-03-03\nempty: []\nextra_internal: [5.0.0.0/8, '6.0.0.0/8']\npublic_office_ips:\n- 7.7.7.7\n- \"2001:db8::1\"\n")
    assert [(r.section, r.value) for r in yaml_lists(spark, yaml).orderBy("ord").collect()] == [
        ("holidays", "2024-01-01"), ("holidays", "2024-03-03"), ("extra_internal", "5.0.0.0/8"), ("extra_internal", "6.0.0.0/8"), ("public_office_ips", "7.7.7.7"), ("public_office_ips", "2001:db8::1")]
    d = src_dimensions(spark, {"holidays": yaml, "networks": yaml})
    assert [r.day for r in d["holidays"].collect()] == ["2024-01-01", "2024-03-03"]
    assert {r.cidr for r in d["internal_networks"].collect()} == {*V.INTERNAL_CIDRS_V4, "5.0.0.0/8", "6.0.0.0/8", "7.7.7.7/32", "2001:db8::1/128"}
    assert src_dimensions(spark)["vlans"].count() == len(V.VLANS)
    entries = json_entries(spark, text(spark, '{"m": {"x": {"a": 1},\n "y": 7, "z": {"b": 2}}}'), "m", "a int, b int").orderBy("ord").collect()
    assert [(r.name, r.a, r.b) for r in entries] == [("x", 1, None), ("y", None, None), ("z", None, 2)]
    assert json_entries(spark, text(spark, "{}"), "m", "int").collect() == []
