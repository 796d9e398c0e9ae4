"""A sample of registered queries against their DuckDB SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["flagship_offenders", "host_rolling_60s", "ueba_running_z", "join_dns_asof", "ioc_flow_hits", "policy_eval", "peer_deviation", "fuse_signals",
         "cascade_batch", "dedup_alert_60s", "agg_device_evidence", "tune_threshold", "stream_host_agg", "stream_late_data", "src_zeek_tsv", "src_zeek_stream"]


def text(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(text(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = con.execute(entry.oracle_sql()[name])
    have = [d[0] for d in cur.description]
    want = sorted((tuple(text(r[have.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert sorted(have) == cols
    assert got == want


def test_registry_is_complete():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 180


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
