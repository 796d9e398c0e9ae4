"""Typed state: rows in any order within the delay fold as the batch operator would; late ones come back marked. Logs that grow and rotate."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens import values as V
from flowlens.operators import joins, windows
from flowlens.session import scratch_path
from flowlens.sources import tail
from flowlens.streaming import flow, stateful

START = 1704067200000000
FLOW = "flow_id long, t_us long, src_ip string, dst_ip string, dst_port long, syn_flag int, ack_flag int, total_bytes long"


def files(spark, schema, groups):
    """Each group of rows as a file; they arrive in this order."""
    path = scratch_path(spark, "files")
    for i, rows in enumerate(groups):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros(F.col("t_us") + F.lit(START))).coalesce(1).write.parquet(f"{path}/slot={i}")
    stored = spark.read.parquet(f"{path}/slot=0")
    return flow.parquet_stream(spark, path, stored.schema)


def ran(spark, stream, **kw):
    return flow.collected(spark, flow.run_available(stream, **kw), stream.schema)


def a_flow(i, second, src="a", dst="x", port=80):
    return (i, int(second * 1e6), src, dst, port, 1, 0, 10 + i)


def test_rows_before_newer_ones_of_an_earlier_batch(spark):
    groups = [[a_flow(1, 100), a_flow(2, 110, dst="y")], [a_flow(3, 95, port=81), a_flow(4, 120)], [a_flow(5, 1000)], [a_flow(6, 300)], [a_flow(9, 90000, src="beat")]]
    with stateful.state_conf(spark):
        s = stateful.stream_host_agg(files(spark, FLOW, groups))
        got = {r.flow_id: r for r in ran(spark, s).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and [i for i in got if got[i].late] == [6]
    on_time = spark.createDataFrame([r for g in groups for r in g if r[0] not in (6, 9)], FLOW)
    for want in windows.host_rolling_60s(on_time).collect():
        assert [got[want.flow_id][n] for n in V.HOST_AGGREGATES] == pytest.approx([want[n] for n in V.HOST_AGGREGATES]), want.flow_id


def test_repeats_are_judged_in_event_order(spark):
    schema = "id long, flow_id long, t_us long, src_ip string, attack_type string, rank int, correlated boolean"
    groups = [[(1, 1, 100_000_000, "a", "t", 2, False)], [(2, 2, 90_000_000, "a", "t", 2, False), (3, 3, 120_000_000, "a", "t", 2, None), (4, 4, 121_000_000, "a", "t", 2, True)],
              [(9, 9, 9_000_000_000, "beat", "t", 1, False)]]
    with stateful.state_conf(spark):
        s = stateful.stream_dedup(files(spark, schema, groups), correlated="correlated")
        assert sorted(r.id for r in ran(spark, s).collect()) == [2, 4]


def test_names_as_of_a_flow_equal_the_batch_join(spark):
    rng = random.Random(1)
    answers = [(rng.randrange(0, 400_000_000), f"n{i}", rng.choice(["x", "y, x", "-", "z"])) for i in range(40)] + [(5_000_000, "", "x")]
    flows = [(i, rng.randrange(0, 400_000_000), rng.choice("xyzw")) for i in range(120)]
    beat = 90_000_000_000

    def dealt(rows, at, last):
        return [sorted((r for r in rows if (r[at] + rng.randrange(0, 10_000_000)) // 200_000_000 == k), key=str) for k in range(3)] + [[last]]

    one = files(spark, "flow_id long, t_us long, dst_ip string", dealt(flows, 1, (-1, beat, "beat")))
    two = files(spark, "t_us long, query string, answers string", dealt(answers, 0, (beat, "-", "")))
    with stateful.state_conf(spark):
        got = {r.flow_id: r.name for r in ran(spark, stateful.stream_names(one, two)).filter("NOT late").collect()}
    want = joins.join_dns_asof(spark.createDataFrame(flows, "flow_id long, t_us long, dst_ip string"), spark.createDataFrame(answers, "t_us long, query string, answers string"))
    assert got == {r.flow_id: r.dns_resolved for r in want.collect()}


def test_values_of_rows_with_missing_numbers(spark):
    rows = [(1, 100_000_000, "a", None, None, 1, 0, 5), (2, 101_000_000, "a", "y", 7, 1, 0, 5)]
    with stateful.state_conf(spark):
        s = stateful.in_order(files(spark, FLOW, [rows, [a_flow(9, 90000, src="beat")]]), keys="src_ip", fold=lambda key, rows, state: (rows, state), store=stateful.ListStore("x int"))
        got = {r.flow_id: (r.dst_ip, r.dst_port) for r in ran(spark, s).collect()}
    assert got == {1: (None, None), 2: ("y", 7)}


HEAD = "#separator \\x09\n#open {}\n#fields\tts\tuid\tquery\tanswers\n"


def test_log_that_grows_and_rotates(spark, tmp_path):
    log = tmp_path / "dns.log"
    log.write_text(HEAD.format("one") + "1\ta\tq\tr\n2\tb\tq\tr\n3\thal")
    stream, checkpoint, out = tail.src_log_tail(spark, str(tmp_path), pattern="dns*"), scratch_path(spark, "tail"), scratch_path(spark, "tail-out")

    def run():
        flow.run_available(stream, checkpoint=checkpoint, path=out)
        return sorted(r.value.split("\t")[1] for r in spark.read.parquet(f"{out}/batch_id=*").collect())

    assert run() == ["a", "b"]  # the line that is being written waits
    with log.open("a") as f:
        f.write("f\tq\tr\n4\td\tq\tr\n")
    assert run() == ["a", "b", "d", "half"]
    with log.open("a") as f:
        f.write("5\te\tq\tr\n")
    log.rename(tmp_path / "dns.1.log")  # rotated before its last line was read
    log.write_text(HEAD.format("two") + "#comment\n")
    assert run() == ["a", "b", "d", "e", "half"]
    with log.open("a") as f:
        f.write("6\tf\tq\tr\r\n\n#close\n")
    assert run() == ["a", "b", "d", "e", "f", "half"]
    assert run() == ["a", "b", "d", "e", "f", "half"]
    names = {tuple(r.names) for r in spark.read.parquet(f"{out}/batch_id=*").collect()}
    assert names == {("ts", "uid", "query", "answers")}


def test_tail_in_parts_and_shrunk_files(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "SPLIT", 40)
    monkeypatch.setattr(tail, "CHUNK", 7)
    (tmp_path / "a.log").write_text(HEAD.format("x") + "".join(f"{i}\tu{i}\t{'q' * (i % 60)}\tr\n" for i in range(50)))
    reader = tail.TailReader({"path": str(tmp_path)})
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    assert len(parts) > 20
    assert [v.split("\t")[1] for p in parts for v, _, _ in reader.read(p)] == [f"u{i}" for i in range(50)]
    (tmp_path / "a.log").rename(tmp_path / "b.log")
    assert len(list(reader.read(parts[-1]))) >= 1  # found under its new name
    (identity, (path, upto)), = end["files"].items()
    with pytest.raises(ValueError, match="shrunk"):
        reader.partitions(end, {"files": {identity: [path, upto - 5]}})
    assert tail.head_of(b"#fields\ta\n") is None and tail.head_of(b"x\ty\n")[1] == []


def test_state_calls_grow_with_groups_not_keys(spark):
    schema = "flow_id long, t_us long, src_ip string, department string, x double, y double"
    rows = [(i, i * 50_000, f"h{i % 300}", "d", 1e6 + i % 7, 5.0) for i in range(1500)]
    ends = [[(-1, 90_000_000_000, "beat", "beat", 0.0, 0.0)], [(5000, 1_000_000, "h0", "d", 1.0, 1.0)]]
    checkpoint = scratch_path(spark, "groups")
    with stateful.state_conf(spark):
        s = stateful.stream_group_state(files(spark, schema, [rows[::2] + rows[1:100:2], rows[101::2], *ends]), group="src_ip", metrics=["x", "y"])
        found = ran(spark, s, checkpoint=checkpoint).collect()
        got, late = {r.flow_id: r for r in found if not r.late}, [(r.flow_id, r.group_mean) for r in found if r.late]
        due = spark.read.format("statestore").option("stateVarName", "due").option("path", checkpoint).load().count()
    saved = {(r.src_ip, r.metric): r for r in stateful.moments(spark, checkpoint, "src_ip").collect()}
    assert due <= 128 and len(saved) == 600 and len(got) == 1500 and late == [(5000, None)]
    for src in ("h0", "h299"):
        values = [r[4] for r in rows if r[2] == src]
        last = got[max(r[0] for r in rows if r[2] == src)]
        mean = sum(values) / 5
        want = (mean, sum((v - mean) ** 2 for v in values))
        assert last.group_n == saved[src, "x"].n == 5 and last.before_n == 4 and saved[src, "y"].m2 == 0
        assert (saved[src, "x"].mean, saved[src, "x"].m2) == pytest.approx(want) and (last.group_mean[0], last.group_m2[0]) == pytest.approx(want)


def test_moments_in_pieces_equal_those_in_one(spark):
    import numpy as np
    x = np.random.default_rng(1).normal(1e6, 1.0, (9000, 2))
    _, (n, mean, m2), state = stateful.moved({}, ["x", "y"], x)
    _, (a, b, c), half = stateful.moved(stateful.moved({}, ["x", "y"], x[:5000])[2], ["x", "y"], x[5000:])
    assert n[-1] == a[-1] == 9000 and np.allclose(mean[5000:], b, rtol=1e-14) and np.allclose(m2[5000:], c, rtol=1e-9)
    assert state["x"] == pytest.approx(half["x"]) and m2[-1] == pytest.approx(((x - x.mean(axis=0)) ** 2).sum(axis=0))


def in_blocks(monkeypatch, fold, store, keys, schema, calls):
    """Output of a store's fold over calls of due rows, a few rows at a time."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    class Handle:
        def getListState(self, *_):
            return None

    monkeypatch.setattr(stateful, "PIECE", 16)
    schema = T._parse_datatype_string(f"{schema}, {stateful.AT} long")
    store.declare(Handle(), T.StructType([schema[k] for k in keys]))
    state, found = store.arrow.empty_table(), []
    for rows in calls:
        table = pa.Table.from_pylist([dict(zip(schema.names, (*r, r[1]), strict=True)) for r in rows], to_arrow_schema(schema))
        frames = store.folded(fold, table, state, ["t_us", "flow_id"], [*V.HOST_AGGREGATES, "flow_id"] if "dst_ip" in schema.names else ["flow_id"])
        while True:
            try:
                found.append(next(frames))
            except StopIteration as end:
                state = end.value
                break
    return {int(r["flow_id"]): r for f in found for r in f.to_dict("records")}, state


@pytest.mark.parametrize("window_us", [60_000_000, 4_000_000_000])
def test_windows_of_many_keys_at_once(spark, monkeypatch, window_us):
    from flowlens.streaming.keyed import host_fold
    rng = random.Random(3)
    rows = [(i, rng.randrange(0, 40) * window_us // 20, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice(["x", "y", None]), rng.choice([80, 81]), 1, rng.choice([0, 1]), i) for i in range(300)]
    rows += [(1000, 0, "gaps", "x", 80, 1, 0, 1)] + [(1001 + i, 10**13 + i * 1_000_001, "gaps", "x", 80, 1, 0, 1) for i in range(3)]
    rows.sort(key=lambda r: (r[1], r[0]))
    store = stateful.BlockStore("t bigint, dst string, port bigint, flag bigint, bytes bigint")
    got, state = in_blocks(monkeypatch, host_fold(window_us), store, ["src_ip"], FLOW, [rows[:130], rows[130:131], rows[131:]])
    assert len(got) == len(rows) and len(state) < len(rows)
    for at, r in enumerate(rows):
        w = [x for x in rows[:at] if x[2] == r[2] and x[1] >= r[1] - window_us]
        steps = [(b[1] - a[1]) / 1e6 for a, b in zip(w, w[1:])]
        mean = sum(steps) / len(steps) if steps else 0.0
        std = (sum((s - mean) ** 2 for s in steps) / len(steps)) ** 0.5 if steps else 0.0
        want = [len(w), len({x[3] for x in w} - {None}), len({x[4] for x in w}), sum(x[6] == 0 for x in w), len(w) / (window_us / 1e6), sum(x[7] for x in w), mean, std]
        assert [got[r[0]][n] for n in V.HOST_AGGREGATES] == pytest.approx(want, abs=1e-9), r


def test_gate_of_many_keys_at_once(spark, monkeypatch):
    from flowlens.streaming.keyed import gate_fold
    rng = random.Random(4)
    rows = sorted([(i, rng.randrange(0, 300_000_000), rng.choice("aaaabc"), rng.choice("tu"), rng.randrange(1, 4), rng.choice([None, False, False, False, True])) for i in range(300)], key=lambda r: (r[1], r[0]))
    store = stateful.BlockStore("t bigint, v bigint")
    got, state = in_blocks(monkeypatch, gate_fold("rank", 60_000_000, "rise", "correlated"), store, ["src_ip", "attack_type"],
                           "flow_id long, t_us long, src_ip string, attack_type string, rank int, correlated boolean", [rows[:150], rows[150:]])
    last, want = {}, []
    for i, t, src, kind, rank, force in rows:
        own = last.get((src, kind))
        if own is None or force or t - own[0] >= 60_000_000 or rank > own[1]:
            last[src, kind] = t, rank
            want.append(i)
    assert sorted(got) == sorted(want) and {(r["src_ip"], r["attack_type"]): (r["t"], r["v"]) for r in state.to_pylist()} == last


def test_windows_in_state_are_batches_not_rows(spark):
    rows = [a_flow(i, i * 0.02, src=f"h{i % 100}") for i in range(2000)]
    checkpoint = scratch_path(spark, "windows")
    with stateful.state_conf(spark):
        s = stateful.stream_host_agg(files(spark, FLOW, [rows, [a_flow(-1, 200, src="beat")]]), delay_s=160)
        got = ran(spark, s, checkpoint=checkpoint, partitions=stateful.state_partitions(spark)).count()
        state = spark.read.format("statestore").option("stateVarName", "folded").option("path", checkpoint).load()
    # the watermark stands at 40 s: all rows are folded, and their windows still open
    assert got == 2000 and 0 < state.count() <= 128


def test_state_partitions_do_not_follow_shuffle_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "600")
    try:
        assert stateful.state_partitions(spark) == 8 and stateful.state_partitions(spark, 3) == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_slots_have_equal_numbers_of_files(spark, monkeypatch):
    from flowlens.plans import q_streams
    monkeypatch.setattr(q_streams, "SLOT_FILE_ROWS", 20)
    rows = spark.range(400).select(F.col("id").alias("flow_id"), (F.col("id") * 1_800_000).alias("t_us"))
    stream = q_streams.streamed(q_streams.timed(rows), beat={"flow_id": -1})
    seen = scratch_path(spark, "slots")
    flow.run_available(stream, write=lambda b, i: b.withColumn("file", F.input_file_name()).write.parquet(f"{seen}/batch_id={i}"))
    got = spark.read.parquet(seen).groupBy("batch_id").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"), F.min("flow_id").alias("lo"), F.max("flow_id").alias("hi")).orderBy("batch_id").collect()
    assert [tuple(r) for r in got] == [*[(i, 100, 4, 100 * i, 100 * i + 99) for i in range(4)], (4, 1, 1, -1, -1)]


@pytest.mark.parametrize("name, view", [("keyed_recurrence", "alerts"), ("parity_report", "flows")])
def test_view_of_both_sides_is_worked_out_once(spark, monkeypatch, name, view):
    from flowlens.plans import catalog, q_streams
    made, seen, sf = getattr(q_streams, view), spark.sparkContext.accumulator(0), "/root/testdata/sf0.001"

    def counted(x):
        seen.add(1)
        return x

    monkeypatch.setattr(q_streams, view, lambda spark, sf: made(spark, sf).withColumn("src_ip", F.udf(counted, "string")("src_ip")))
    got = catalog.QUERIES[name](spark, sf).collect()
    assert got and all(r.differing == 0 if name == "keyed_recurrence" else r.ok == 1 for r in got)
    assert seen.value == made(spark, sf).count()


class Held:
    """State of one key in memory."""

    def __init__(self):
        self.value, self.map, self.rows, self.alarms = None, {}, [], []

    def getValueState(self, *_):
        return Held()

    getMapState = getListState = getValueState

    def registerTimer(self, at):
        self.alarms.append(at)

    def exists(self):
        return self.value is not None or bool(self.map) or bool(self.rows)

    def get(self):
        return self.value if self.value is not None else iter(self.rows)

    def update(self, value):
        self.value = value

    def appendList(self, rows):
        self.rows += rows

    def put(self, rows):
        self.rows = rows

    def clear(self):
        self.value, self.map, self.rows = None, {}, []

    def updateValue(self, key, value):
        self.map[key] = value

    def getValue(self, key):
        return self.map[key]

    def removeKey(self, key):
        del self.map[key]


def test_due_rows_of_a_hot_key_fold_in_pieces(spark, monkeypatch):
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T
    monkeypatch.setattr(stateful, "PIECE", 64)
    monkeypatch.setattr(stateful, "RUN", 512, raising=False)
    rng, sizes, found, upto = np.random.default_rng(5), [], [], [0]

    class Store(stateful.BlockStore):
        def folded(self, fold, table, states, order, output):
            sizes.append(len(table))
            found.extend(sorted(zip(table["t_us"].to_pylist(), table["flow_id"].to_pylist())))
            yield table.to_pandas()
            return states

    schema = T._parse_datatype_string(f"flow_id long, t_us long, src_ip string, {stateful.AT} long")
    held = Held()
    one = stateful.InOrder(None, Store("x int"), ["src_ip"], schema.names, schema, ["t_us"], [*schema.names, "late"], None)
    monkeypatch.setattr(one, "passed", lambda _: upto[0])
    one.init(held)
    times = rng.permutation(np.repeat(np.arange(1, 1001), 3))
    rows = pd.DataFrame({"flow_id": np.arange(3000), "t_us": times, "src_ip": "hot", stateful.AT: times})
    for lo, mark in ((0, 0), (1000, 0), (2000, 0), (3000, 700), (3000, 1000)):
        batch = rows.iloc[lo:lo + 1000]
        if len(batch):
            assert not list(one.handleInputRows("g", iter([batch[i:i + 100].copy() for i in range(0, 1000, 100)]), None))
        else:
            upto[0] = mark
            list(one.handleExpiredTimer("g", None, None))
            assert len(found) == 3 * mark
    assert found == sorted(zip(times.tolist(), range(3000))) and max(sizes) <= 7 * 64 and not one.waiting.exists() and not one.index.exists()


def test_names_of_many_addresses_share_groups(spark):
    flows = [(i, i * 1_000_000, f"x{i % 400}") for i in range(800)]
    answers = [(i * 1_000_000, f"n{i}", f"x{i}") for i in range(400)]
    beat = 90_000_000_000
    one = files(spark, "flow_id long, t_us long, dst_ip string", [flows, [(-1, beat, "beat")]])
    two = files(spark, "t_us long, query string, answers string", [answers, [(beat, "-", "")]])
    checkpoint = scratch_path(spark, "names")
    with stateful.state_conf(spark):
        got = {r.flow_id: r.name for r in ran(spark, stateful.stream_names(one, two), checkpoint=checkpoint).collect()}
        due = spark.read.format("statestore").option("stateVarName", "due").option("path", checkpoint).load().count()
    assert got == {i: f"n{i % 400}" for i in range(800)} and due <= 128
