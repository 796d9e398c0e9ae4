"""Keyed time windows that stay splittable when one key holds most of the rows.

A plain `Window.partitionBy(key)` puts all rows of a key into one task. Here every key
is cut into time buckets, and (key, bucket) is the unit of work:

* `sliding`        sums, distinct counts and gap statistics over the last N seconds;
* `running_totals` sums since the beginning of the key (bucket totals, then a prefix
                   over buckets, then a running sum inside each bucket);
* `running_moments` mean and spread since the beginning of the key, by merging moments;
* `last_rows`      statistics of the last N rows of a key.

All are exact and run as built-in expressions, but for the scan over moments of buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

SECOND = 1_000_000


def _names(x):
    return [x] if isinstance(x, str) else list(x)


def sliding(df: DataFrame, *, key="src_ip", t="t_us", rid="flow_id", horizon_us: int,
            sums: dict[str, Column] | None = None, distinct: dict[str, str] | None = None,
            gaps: bool = False, include_current: bool = True, closed: bool = False,
            max_rows: int | None = None, bucket_us: int | None = None) -> DataFrame:
    """Append window measures over the last `horizon_us` of each key.

    sums     name -> integer expression, summed over the window
    distinct name -> column, distinct non-null values in the window
    gaps     adds `gap_n`, `gap_sum`, `gap_sq` of the steps between consecutive rows
    closed   keep a row that is exactly `horizon_us` old
    max_rows keep at most the newest `max_rows` rows

    Each row enters the window at its own position and leaves it by an expiry event, so a
    running sum over both kinds of event is the window total. Rows that reach into the next
    bucket are repeated there (without their payload) to open its window.
    """
    sums, distinct, keys = dict(sums or {}), dict(distinct or {}), _names(key)
    bucket = max(bucket_us or horizon_us, horizon_us)
    H = F.lit(horizon_us)
    vals = [e.cast("long").alias(f"_s_{n}") for n, e in sums.items()]
    dcols = [F.col(c).alias(f"_d_{n}") for n, c in distinct.items()]
    payload = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    base = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                     F.col(t).cast("long").alias("_t"), F.col(rid).alias("_id"), *vals, *dcols,
                     payload.alias("_row"))
    kcols = [f"_k{i}" for i in range(len(keys))]
    own = (F.col("_t") - F.pmod(F.col("_t"), F.lit(bucket))) / bucket
    own = own.cast("long")
    spill = F.pmod(F.col("_t"), F.lit(bucket)) + H >= bucket
    copy = F.array(F.struct(own.alias("b"), F.lit(True).alias("own")))
    both = F.array(F.struct(own.alias("b"), F.lit(True).alias("own")),
                   F.struct((own + 1).alias("b"), F.lit(False).alias("own")))
    base = (base.withColumn("_c", F.explode(F.when(spill, both).otherwise(copy)))
            .withColumn("_b", F.col("_c.b"))
            .withColumn("_row", F.when(F.col("_c.own"), F.col("_row"))).drop("_c"))
    part = kcols + ["_b"]
    # one exchange serves all windows below, also those that add a distinct column to the key
    base = base.repartition(*part)
    byrow = W.partitionBy(*part).orderBy("_t", "_id")
    gone = (lambda older, now: older < now - H) if closed else (lambda older, now: older <= now - H)
    enter, leave = {"_n": F.lit(1)}, {"_n": F.lit(-1)}
    for n in sums:
        enter[f"_s_{n}"], leave[f"_s_{n}"] = F.col(f"_s_{n}"), -F.col(f"_s_{n}")
    base = base.withColumn("_pt", F.lag("_t").over(byrow)).withColumn("_nt", F.lead("_t").over(byrow))
    if gaps:
        g_in = F.when(F.col("_pt").isNotNull() & ~gone(F.col("_pt"), F.col("_t")), F.col("_t") - F.col("_pt"))
        g_out = F.when(F.col("_nt").isNotNull() & ~gone(F.col("_t"), F.col("_nt")), F.col("_nt") - F.col("_t"))
        for n, f in (("gap_n", lambda g: F.lit(1)), ("gap_sum", lambda g: g), ("gap_sq", lambda g: g * g)):
            enter[f"_g_{n}"] = F.when(g_in.isNotNull(), f(g_in)).otherwise(0)
            leave[f"_g_{n}"] = F.when(g_out.isNotNull(), -f(g_out)).otherwise(0)
    for n in distinct:
        d = f"_d_{n}"
        byd = W.partitionBy(*part, d).orderBy("_t", "_id")
        base = (base.withColumn(f"_pp_{n}", F.lag("_t").over(byd))
                .withColumn(f"_nn_{n}", F.lead("_t").over(byd)))
        fresh = F.col(f"_pp_{n}").isNull() | gone(F.col(f"_pp_{n}"), F.col("_t"))
        last = F.col(f"_nn_{n}").isNull() | gone(F.col("_t"), F.col(f"_nn_{n}"))
        enter[d] = F.when(F.col(d).isNotNull() & fresh, 1).otherwise(0)
        leave[d] = F.when(F.col(d).isNotNull() & last, -1).otherwise(0)
    pushed = F.lit(False)
    if max_rows:  # a row also leaves when `max_rows` newer ones have arrived
        assert not gaps and not distinct
        base = base.withColumn("_lt", F.lead("_t", max_rows).over(byrow))
        pushed = F.col("_lt").isNotNull() & ~gone(F.col("_t"), F.col("_lt"))
        for m in ["_n"] + [f"_s_{n}" for n in sums]:
            val = F.lit(1) if m == "_n" else F.col(m)
            base = base.withColumn(f"_o{m}", F.lag(F.when(pushed, val).otherwise(0), max_rows, 0).over(byrow))
            enter[m] = enter[m] - F.col(f"_o{m}")
    measures = list(enter)
    expires_here = F.floor((F.col("_t") + H) / bucket) == F.col("_b")
    row_event = F.struct(F.col("_t").alias("_et"), F.lit(1).alias("_kind"), F.col("_row").alias("_row"),
                         *[enter[m].cast("long").alias(m) for m in measures])
    exit_event = F.struct((F.col("_t") + H).alias("_et"), F.lit(2 if closed else 0).alias("_kind"),
                          F.lit(None).cast(base.schema["_row"].dataType).alias("_row"),
                          *[leave[m].cast("long").alias(m) for m in measures])
    events = base.select(*part, "_id", F.explode(
        F.when(expires_here & ~pushed, F.array(row_event, exit_event)).otherwise(F.array(row_event))
    ).alias("_e")).select(*part, "_id", "_e.*")
    order = W.partitionBy(*part).orderBy("_et", "_kind", "_id")
    frame = order.rowsBetween(W.unboundedPreceding, W.currentRow if include_current else -1)
    out = events.select("_row", *[F.coalesce(F.sum(m).over(frame), F.lit(0)).alias(m + "_w") for m in measures])
    names = {"_n": "win_n", **{f"_s_{n}": n for n in sums}, **{f"_d_{n}": n for n in distinct},
             **{m: m[3:] for m in measures if m.startswith("_g_")}}
    return out.filter(F.col("_row").isNotNull()).select(
        "_row.*", *[F.col(m + "_w").alias(names[m]) for m in measures])


def gap_stats(n, s, sq) -> tuple[Column, Column]:
    """Mean and population deviation, in seconds, of integer microsecond gaps."""
    n, s, sq = (F.col(x).cast("decimal(20,0)") for x in (n, s, sq))
    mean = F.coalesce(F.try_divide(s.cast("double"), n.cast("double") * SECOND), F.lit(0.0))
    var = (n * sq - s * s).cast("double")
    std = F.coalesce(F.try_divide(F.sqrt(var), n.cast("double") * SECOND), F.lit(0.0))
    return mean, std


def bucket_of(t, bucket_us: int) -> Column:
    c = F.col(t) if isinstance(t, str) else t
    return ((c - F.pmod(c, F.lit(bucket_us))) / bucket_us).cast("long")


def running_totals(df: DataFrame, *, keys=None, sums: dict[str, Column] | None = None, specs=None,
                   t="t_us", rid="flow_id", include_current: bool = True,
                   bucket_us: int = 60 * SECOND) -> DataFrame:
    """Append running sums per key in (t, rid) order.

    `specs` is a list of (keys, sums) when several keys are needed at once; the input is
    then read once for the rows and once per key for the bucket totals.
    """
    specs = specs or [(keys, sums)]
    d = df.withColumn("_b", bucket_of(t, bucket_us))
    out = d
    for i, (ks, ss) in enumerate(specs):
        ks = _names(ks)
        part = d.groupBy(*ks, "_b").agg(*[F.sum(e).alias(n) for n, e in ss.items()])
        before = W.partitionBy(*ks).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        part = part.select(*ks, "_b", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_o{i}_{n}") for n in ss])
        inside = W.partitionBy(*ks, "_b").orderBy(t, rid).rowsBetween(
            W.unboundedPreceding, W.currentRow if include_current else -1)
        have = out.columns
        out = out.join(part, [*ks, "_b"]).select(
            *have, *[(F.col(f"_o{i}_{n}") + F.coalesce(F.sum(e).over(inside), F.lit(0))).alias(n) for n, e in ss.items()])
    return out.drop("_b")


def row_index(df: DataFrame, *, keys, name: str = "row_idx", **kw) -> DataFrame:
    """Append the 1-based position of each row in its key."""
    return running_totals(df, keys=keys, sums={name: F.lit(1).cast("long")}, **kw)


def last_rows(df: DataFrame, *, keys, idx: str, n: int, aggs: dict[str, Column],
              block: int = 4096) -> DataFrame:
    """Aggregates over the last `n` rows, where `idx` numbers the rows of each key.

    Keys are cut into blocks of `block` rows; the last n-1 rows of a block are repeated
    at the head of the next one.
    """
    keys = _names(keys)
    own = ((F.col(idx) - 1) / block).cast("long")
    tail = (F.col(idx) - 1) % block >= block - (n - 1)
    copies = F.when(tail, F.array(F.struct(own.alias("b"), F.lit(True).alias("o")),
                                  F.struct((own + 1).alias("b"), F.lit(False).alias("o")))
                    ).otherwise(F.array(F.struct(own.alias("b"), F.lit(True).alias("o"))))
    d = df.withColumn("_c", F.explode(copies)).withColumn("_b", F.col("_c.b"))
    w = W.partitionBy(*keys, "_b").orderBy(idx).rowsBetween(-(n - 1), 0)
    d = d.select(*df.columns, "_c", *[a.over(w).alias(k) for k, a in aggs.items()])
    return d.filter(F.col("_c.o")).drop("_c")


def merged(a: tuple, b: tuple) -> tuple:
    """Moments (n, mean, m2) of two parts as one; a part without rows counts for nothing. Columns or numpy arrays alike."""
    (na, ma, qa), (nb, mb, qb) = a, b
    n, away = na + nb, mb - ma
    share = nb / (n + (n == 0)) if isinstance(n, np.ndarray) else F.coalesce(F.try_divide(nb, n), F.lit(0.0))
    return n, ma + away * share, qa + qb + away * away * na * share


def scan_moments(key: np.ndarray, n: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Moments of all rows of a key up to each row; equal keys stand together. n: rows; mean, m2: rows x metrics.

    Every step merges what ends at a row with what ends as far before it as the steps so far have reached: log2 of the
    longest key's rows steps, each over whole arrays.
    """
    at = np.arange(len(key))
    new = np.append(True, key[1:] != key[:-1])
    first = np.maximum.accumulate(np.where(new, at, 0))
    state, reach = (n[:, None].astype(float), mean, m2), 1
    while len(key) and reach <= (at - first).max():
        own = np.flatnonzero(at - reach >= first)
        both = merged(tuple(x[own - reach] for x in state), tuple(x[own] for x in state))
        state = tuple(x.copy() for x in state)
        for x, y in zip(state, both, strict=True):
            x[own] = y
        reach *= 2
    return state[0][:, 0], state[1], state[2]


def _scanned(batches):
    """Batches of (keys, n, means, m2s) in key order: the moments of the key's rows before each, across batches."""
    last, carry = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = dict(zip(batch.schema.names, batch.columns, strict=True))
        names = [c for c in cols if c.startswith("_key")]
        keys = list(zip(*[cols[c].to_pylist() for c in names], strict=True))
        number, at = {}, np.zeros(len(keys), np.int64)
        for i, k in enumerate(keys):
            at[i] = number.setdefault(k, len(number))
        k = len(cols["_means"][0])
        n = cols["_rows"].to_numpy().astype(float)
        mean, m2 = (np.array(cols[c].flatten().to_numpy()).reshape(-1, k) for c in ("_means", "_m2s"))
        if carry is not None and last == keys[0]:
            at, n, mean, m2 = np.append(0, at), np.append(carry[0], n), np.vstack([carry[1], mean]), np.vstack([carry[2], m2])
        upto = scan_moments(at, n, mean, m2)
        extra = len(at) - len(keys)
        last, carry = keys[-1], tuple(x[-1] for x in upto)
        begins = np.append(True, at[1:] != at[:-1])
        before = [np.vstack([np.zeros_like(x[:1]), x[:-1]]) if x.ndim > 1 else np.append(0.0, x[:-1]) for x in upto]
        for x in before:
            x[begins] = 0
        before = [x[extra:] for x in before]
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, k, dtype=np.int32)), pa.array(x.ravel())) for x in before[1:]]
        yield pa.RecordBatch.from_arrays([*[cols[c] for c in cols if c not in ("_rows", "_means", "_m2s")], pa.array(before[0].astype(np.int64)), *lists],
                                         [*[c for c in cols if c not in ("_rows", "_means", "_m2s")], "_rows", "_means", "_m2s"])


def running_moments(df: DataFrame, *, specs: list[tuple], metrics, t="t_us", rid="flow_id", bucket_us: int = 60 * SECOND, of: DataFrame | None = None) -> DataFrame:
    """Append, per (keys, prefix) of specs, the moments of strictly earlier rows of the key in (t, rid) order.

    Columns: {prefix}n, and {prefix}a_{metric} (mean) and {prefix}v_{metric} (sum of squared deviations) of each metric.
    Buckets of time are units of work; the state before a bucket is a prefix scan over the moments of buckets, which are
    merged and never subtracted, so values that are large beside their spread keep it. Metrics must not be null.
    of: all rows, where df has only some, but all of any bucket of a key that it has.
    """
    out = df.withColumn("_b", bucket_of(t, bucket_us))
    d = out if of is None else of.withColumn("_b", bucket_of(t, bucket_us))
    for keys, p in specs:
        keys = _names(keys)
        part = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_rows"), F.array(*[F.avg(m) for m in metrics]).alias("_means"),
                                          F.array(*[F.var_pop(m) * F.count(F.lit(1)) for m in metrics]).alias("_m2s"))
        part = part.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_b", "_rows", "_means", "_m2s")
        named = [f"_key{i}" for i in range(len(keys))]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema)
        part = part.repartition(*named).sortWithinPartitions(*named, "_b").mapInArrow(_scanned, schema)
        part = part.select(*[F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)], "_b", F.col("_rows").alias("_o"), F.col("_means").alias("_oa"), F.col("_m2s").alias("_ov"))
        inside = W.partitionBy(*keys, "_b").orderBy(t, rid).rowsBetween(W.unboundedPreceding, -1)
        have = out.columns
        out = out.join(part, [*keys, "_b"]).withColumn("_i", F.count(F.lit(1)).over(inside))
        cols = []
        for i, m in enumerate(metrics):
            n, mean, m2 = merged((F.col("_o"), F.col("_oa")[i], F.col("_ov")[i]),
                                 (F.col("_i"), F.coalesce(F.avg(m).over(inside), F.lit(0.0)), F.coalesce(F.var_pop(m).over(inside) * F.col("_i"), F.lit(0.0))))
            cols += [mean.alias(f"{p}a_{m}"), m2.alias(f"{p}v_{m}")]
        out = out.select(*have, (F.col("_o") + F.col("_i")).alias(f"{p}n"), *cols)
    return out.drop("_b")
