"""Feeds that name one key twice, and device votes by address prefix."""

from flowlens.operators import joins


def test_repeated_feed_keys_do_not_multiply_flows(spark):
    flows = spark.createDataFrame([(1, "1.1.1.1", "2.2.2.2", "h")], "flow_id long, src_ip string, dst_ip string, ja3 string")
    feed = spark.createDataFrame([("2.2.2.2", "c2", "LOW", "a"), ("2.2.2.2", "c2", "CRITICAL", "b"), ("2.2.2.2", "bot", "CRITICAL", "c")], "ip string, category string, severity string, feed string")
    out = joins.join_ioc_ip(flows, feed).collect()
    assert len(out) == 1 and out[0].dst_hit.severity == "CRITICAL" and out[0].dst_hit.feed == "b"
    prints = feed.withColumnRenamed("ip", "ja3").replace("2.2.2.2", "h").selectExpr("*", "feed AS name")
    assert joins.join_ioc_ja3(flows, prints).count() == 1
    assert joins.join_ja3_builtin(flows, prints).count() == 1
