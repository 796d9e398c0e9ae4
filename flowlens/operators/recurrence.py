"""Order-dependent folds per key, cut into time buckets.

A fold whose result depends on what it emitted before cannot be a window aggregate. Instead
of handing a whole key to one task, each (key, bucket) is summarised on its own, the small
summaries are walked per key, and each bucket is then replayed from its entry state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from flowlens import values as V
from flowlens.functions.scores import lookup, severity_rank
from flowlens.operators.segments import SECOND, bucket_of

# Keys are hashed into as many groups as there are shuffle partitions, so that one Python call handles many small keys
# and the groups grow with the cluster. A group never spans two buckets: a hot key adds at most one bucket of its rows.
FRESH = -(1 << 62)  # state of a key that has emitted nothing yet


def _hash(df: DataFrame, keys):
    return F.pmod(F.xxhash64(*keys), F.lit(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))).alias("_h")


def _starts(pdf: pd.DataFrame, keys) -> np.ndarray:
    """True where a new key begins in a sorted frame."""
    new = np.zeros(len(pdf), dtype=bool)
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    if len(new):
        new[0] = True
    return new


def _segments(pdf: pd.DataFrame, keys):
    """(start, end) of each key of a sorted frame."""
    at = np.flatnonzero(_starts(pdf, keys))
    return list(zip(at, np.append(at[1:], len(pdf))))


# ── clamped risk: x -> min(cap, x + d) or x * r ──────────────────────────────
def risk_accumulator(df: DataFrame, *, key="src_ip", score="anomaly_score", role="role", t="t_us", rid="flow_id",
                     threshold: float = 0.15, cap: float = 100.0, bucket_us: int = 600 * SECOND) -> DataFrame:
    """Append `risk`: plus 15 * score * multiplier (capped) when anomalous, else decayed by role.

    One step is x -> min(c, a*x + b). Such functions compose to the same form, so a bucket's
    steps fold into one (a, b, c), buckets chain per key, and rows replay inside the bucket.
    """
    hot = F.col(score) > threshold
    gain = F.col(score) * 15.0 * lookup(role, V.ROLE_MULTIPLIER, 1.0)
    d = df.withColumns({"_b": bucket_of(t, bucket_us), "_a": F.when(hot, 1.0).otherwise(lookup(role, V.ROLE_DECAY, 0.997)),
                        "_g": F.when(hot, gain).otherwise(0.0), "_c": F.when(hot, cap).otherwise(float("inf"))})
    step = F.struct(F.col(t), F.col(rid), F.col("_a").alias("a"), F.col("_g").alias("g"), F.col("_c").alias("c"))
    ident = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(float("inf")).alias("c"))

    def compose(s, x):
        return F.struct((s["a"] * x["a"]).alias("a"), (s["b"] * x["a"] + x["g"]).alias("b"),
                        F.least(x["c"], s["c"] * x["a"] + x["g"]).alias("c"))

    summary = d.groupBy(key, "_b").agg(F.aggregate(F.array_sort(F.collect_list(step)), ident, compose).alias("f"))
    # entry value of each bucket: walk a key's bucket functions in order
    entry_schema = T.StructType([df.schema[key], T.StructField("_b", T.LongType()), T.StructField("_x0", T.DoubleType())])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "_b"], kind="stable")
        out = np.empty(len(pdf))
        x, new = 0.0, _starts(pdf, [key])
        for i, (a, b, c) in enumerate(zip(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["c"].to_numpy())):
            out[i] = x = 0.0 if new[i] else x
            x = min(c, a * x + b)
        return pd.DataFrame({key: pdf[key].to_numpy(), "_b": pdf["_b"].to_numpy(), "_x0": out})

    entry = (summary.select(key, "_b", "f.*", _hash(df, [key]))
             .groupBy("_h").applyInPandas(walk, entry_schema))
    fields = [f for f in df.schema.fields]
    schema = T.StructType(fields + [T.StructField("risk", T.DoubleType())])
    names = [f.name for f in fields]

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, t, rid], kind="stable")
        x, out, new = 0.0, np.empty(len(pdf)), _starts(pdf, [key])
        for i, (a, g, c, x0) in enumerate(zip(pdf["_a"].to_numpy(), pdf["_g"].to_numpy(), pdf["_c"].to_numpy(), pdf["_x0"].to_numpy())):
            x = min(c, a * (x0 if new[i] else x) + g)
            out[i] = x
        return pdf[names].assign(risk=out)

    return (d.join(entry, [key, "_b"]).withColumn("_h", _hash(df, [key]))
            .groupBy("_h", "_b").applyInPandas(replay, schema))


# ── reputation: start 50, +2 capped at 100, -5 floored at 0 ──────────────────
def reputation(df: DataFrame, *, key="src_ip", verdict="verdict", t="t_us", rid="flow_id",
               bucket_us: int = 86400 * SECOND) -> DataFrame:
    """Final reputation and adaptive threshold adjustment per key from TP/FP verdicts."""
    d = df.filter(F.col(verdict).isin("TP", "FP")).withColumn("_b", bucket_of(t, bucket_us))
    step = F.struct(F.col(t), F.col(rid), F.when(F.col(verdict) == "TP", 2.0).otherwise(-5.0).alias("d"))
    ident = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("lo"), F.lit(100.0).alias("hi"))
    clamp = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(100.0))

    def compose(f, x):  # clamp(x + s, lo, hi) stays in that form
        return F.struct((f["s"] + x["d"]).alias("s"), clamp(f["lo"] + x["d"]).alias("lo"), clamp(f["hi"] + x["d"]).alias("hi"))

    per = d.groupBy(key, "_b").agg(
        F.aggregate(F.array_sort(F.collect_list(step)), ident, compose).alias("f"),
        F.count_if(F.col(verdict) == "TP").alias("tp"), F.count_if(F.col(verdict) == "FP").alias("fp"))
    fold = F.aggregate(F.array_sort(F.collect_list(F.struct("_b", "f"))), F.lit(50.0), lambda x, p: F.least(
        F.greatest(x + p["f"]["s"], p["f"]["lo"]), p["f"]["hi"]))
    return per.groupBy(key).agg(fold.alias("reputation"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))


# ── emit unless the last emitted row blocks it ───────────────────────────────
def _next_index(ts, val, force, wait, rule):
    """For each row taken as emitted, the next row that is emitted after it (or n)."""
    n = len(ts)
    by_time = np.searchsorted(ts, ts + wait, side="left")
    by_val = np.full(n, n)
    if rule == "rise":  # next strictly higher value
        stack = []
        for i in range(n - 1, -1, -1):
            while stack and val[stack[-1]] <= val[i]:
                stack.pop()
            by_val[i] = stack[-1] if stack else n
            stack.append(i)
    else:  # next different value
        for i in range(n - 2, -1, -1):
            by_val[i] = i + 1 if val[i + 1] != val[i] else by_val[i + 1]
    forced = np.append(np.flatnonzero(force), n)
    return np.minimum(np.minimum(by_time, by_val), forced[np.searchsorted(forced, np.arange(n), side="right")])


def _first_after(ts, val, force, state, wait, rule):
    """First emitted row of a bucket, given the state (time, value) it starts from."""
    st, sv = state
    hit = force | (ts >= st + wait)
    hit |= (val > sv) if rule == "rise" else (val != sv)
    return int(np.argmax(hit)) if hit.any() else len(ts)


def emit_gate(df: DataFrame, *, keys, value: str, wait_us: int, rule: str, t="t_us", rid="flow_id",
              bucket_us: int = 600 * SECOND, name: str = "emitted", always: str | None = None) -> DataFrame:
    """Append a boolean: is the row emitted.

    A row is emitted when `wait_us` has passed since the key's last emitted row, or when its
    value is higher than ("rise") or differs from ("change") that row's value. Rows where the
    column `always` is true are emitted whatever came before, and count as the last one. After
    `wait_us` any row is emitted, so a bucket can only be entered in a state left by the
    bucket right before it, or in the fresh state. Each bucket reports its possible exits;
    those are few, because chains merge. Per key only these states are walked.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    bucket = max(bucket_us, 2 * wait_us)
    force = F.coalesce(F.col(always), F.lit(False)) if always else F.lit(False)
    d = df.withColumns({"_b": bucket_of(t, bucket), "_h": _hash(df, keys), "_f": force})
    ktypes = [df.schema[k] for k in keys]
    narrow = d.select(*keys, "_h", "_b", F.col(t).alias("_t"), F.col(rid).alias("_id"), F.col(value).cast("long").alias("_v"), "_f")
    long = lambda *ns: [T.StructField(n, T.LongType()) for n in ns]
    order = [*keys, "_t", "_id"]

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        ts, val, force = pdf["_t"].to_numpy(), pdf["_v"].to_numpy(), pdf["_f"].to_numpy()
        keep = []
        for lo, hi in _segments(pdf, keys):
            nxt, n = _next_index(ts[lo:hi], val[lo:hi], force[lo:hi], wait_us, rule), hi - lo
            last = np.arange(n)
            for i in range(n - 1, -1, -1):
                if nxt[i] < n:
                    last[i] = last[nxt[i]]
            keep.append(lo + np.unique(last))
        o = pdf.iloc[np.concatenate(keep)]
        return o.assign(_b=o["_b"] + 1)[[*keys, "_h", "_b", "_t", "_v"]]

    cand_schema = T.StructType(ktypes + long("_h", "_b", "s_t", "s_v"))
    cand = narrow.groupBy("_h", "_b").applyInPandas(lambda p: exits(p).set_axis(cand_schema.names, axis=1), cand_schema)
    moves_schema = T.StructType(ktypes + long("_b", "s_t", "s_v", "e_t", "e_v"))

    def moves(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=moves_schema.names)
        rows = rows.sort_values(order, kind="stable")
        ts, val, force, b = rows["_t"].to_numpy(), rows["_v"].to_numpy(), rows["_f"].to_numpy(), int(rows["_b"].iloc[0])
        kcols = [rows[k].to_numpy() for k in keys]
        known: dict = {}
        for *k, st, sv in zip(*[states[k] for k in keys], states["s_t"], states["s_v"]):
            known.setdefault(tuple(k), []).append((st, sv))
        out = []
        for lo, hi in _segments(rows, keys):
            k = tuple(c[lo] for c in kcols)
            t1, v1, f1 = ts[lo:hi], val[lo:hi], force[lo:hi]
            nxt = _next_index(t1, v1, f1, wait_us, rule)
            for st in [(FRESH, -1)] + known.get(k, []):
                i, end = _first_after(t1, v1, f1, st, wait_us, rule), st
                while i < hi - lo:
                    end, i = (t1[i], v1[i]), nxt[i]
                out.append((*k, b, *st, *end))
        return pd.DataFrame(out, columns=moves_schema.names)

    steps = narrow.groupBy("_h", "_b").cogroup(cand.groupBy("_h", "_b")).applyInPandas(moves, moves_schema)
    entry_schema = T.StructType(ktypes + long("_b", "s_t", "s_v"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*keys, "_b"], kind="stable")
        kcols = [pdf[k].to_numpy() for k in keys]
        cols = [pdf[c].to_numpy() for c in ("_b", "s_t", "s_v", "e_t", "e_v")]
        out = []
        for lo, hi in _segments(pdf, keys):
            k, cur, i = tuple(c[lo] for c in kcols), (FRESH, -1), lo
            while i < hi:
                b, table = cols[0][i], {}
                while i < hi and cols[0][i] == b:
                    table[(cols[1][i], cols[2][i])] = (cols[3][i], cols[4][i])
                    i += 1
                start = cur if cur in table else (FRESH, -1)
                out.append((*k, b, *start))
                cur = table[start]
        return pd.DataFrame(out, columns=entry_schema.names)

    entry = steps.withColumn("_h", _hash(df, keys)).groupBy("_h").applyInPandas(walk, entry_schema)
    schema = T.StructType(df.schema.fields + [T.StructField(name, T.BooleanType())])
    cols = df.columns

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*keys, t, rid], kind="stable").reset_index(drop=True)
        ts, val, force = pdf[t].to_numpy(), pdf["_val"].to_numpy(), pdf["_f"].to_numpy()
        s_t, s_v, keep = pdf["s_t"].to_numpy(), pdf["s_v"].to_numpy(), np.zeros(len(pdf), dtype=bool)
        for lo, hi in _segments(pdf, keys):
            t1, v1, f1 = ts[lo:hi], val[lo:hi], force[lo:hi]
            nxt = _next_index(t1, v1, f1, wait_us, rule)
            i = _first_after(t1, v1, f1, (int(s_t[lo]), int(s_v[lo])), wait_us, rule)
            while i < hi - lo:
                keep[lo + i], i = True, nxt[i]
        return pdf[cols].assign(**{name: keep})

    return (d.withColumn("_val", F.col(value).cast("long")).join(entry, [*keys, "_b"])
            .groupBy("_h", "_b").applyInPandas(replay, schema))


def dedup_alert_60s(df: DataFrame, *, window_us: int = 60 * SECOND, bucket_us: int = 600 * SECOND, correlated: str | None = None) -> DataFrame:
    """Keep an alert unless its (src_ip, attack_type) emitted one in the last 60 s of at least its severity.

    Alerts that the boolean column `correlated` marks are always kept.
    """
    d = df.withColumn("_rank", severity_rank("severity"))
    out = emit_gate(d, keys=["src_ip", "attack_type"], value="_rank", wait_us=window_us, rule="rise", bucket_us=bucket_us, always=correlated)
    return out.filter("emitted").drop("emitted", "_rank")


def dedup_cooldown_300s(df: DataFrame, *, window_us: int = 300 * SECOND, bucket_us: int = 600 * SECOND) -> DataFrame:
    """Keep an alert unless the source's last emitted alert is of the same type and under 300 s old."""
    d = df.withColumn("_type", F.xxhash64("attack_type"))
    out = emit_gate(d, keys="src_ip", value="_type", wait_us=window_us, rule="change", bucket_us=bucket_us)
    return out.filter("emitted").drop("emitted", "_type")
