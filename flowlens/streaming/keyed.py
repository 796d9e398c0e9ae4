"""Folds of keyed streaming operators: rows of many keys, each key's in event order, and their state give output rows and the new state."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from flowlens import values as V


# ── many keys at once ────────────────────────────────────────────────────────
def runs(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal numbers."""
    start = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else np.zeros(0, np.int64)
    return start, np.append(start[1:], len(number)).astype(np.int64)


def distinct_before(number: np.ndarray, values: pd.Series, leaves: np.ndarray) -> np.ndarray:
    """Distinct non-null values among the earlier rows of a key that have not left; leaves: first row that a row is gone for.

    A row counts from the next row on, until its value comes again or it leaves.
    """
    n, code = len(number), pd.factorize(values)[0]
    at = np.lexsort((code, number))
    again = (number[at[1:]] == number[at[:-1]]) & (code[at[1:]] == code[at[:-1]])
    until = leaves.copy()
    until[at[:-1][again]] = np.minimum(until[at[:-1][again]], at[1:][again] + 1)
    found = code >= 0
    step = np.bincount(np.flatnonzero(found) + 1, minlength=n + 1) - np.bincount(until[found], minlength=n + 1)
    return np.cumsum(step)[:n]


# ── host window ──────────────────────────────────────────────────────────────
def host_fold(window_us: int = 60_000_000):
    """The 8 aggregates over a key's earlier rows of the window: sums over rows that came and have not left.

    Rows of many keys, numbered and in order, and the rows that their windows hold give output rows and the new windows.
    """
    def fold(rows, number, state, state_number):
        flag = ((rows["syn_flag"] == 1) & (rows["ack_flag"] == 0)).to_numpy(np.int64)
        new = pd.DataFrame({"t": rows["t_us"].to_numpy(np.int64), "dst": rows["dst_ip"].to_numpy(), "port": rows["dst_port"].to_numpy(),
                            "flag": flag, "bytes": rows["total_bytes"].fillna(0).to_numpy(np.int64)})
        w = pd.concat([state, new], ignore_index=True) if len(state) else new
        num = np.concatenate([state_number, number])
        at = np.argsort(num, kind="stable")  # a key's window comes before its new rows
        w, num, own = w.iloc[at].reset_index(drop=True), num[at], at >= len(state_number)
        n, t = len(num), w["t"].to_numpy(np.int64)
        first, leaves, newest = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
        for lo, hi in zip(*runs(num), strict=True):
            first[lo:hi] = lo + np.searchsorted(t[lo:hi], t[lo:hi] - window_us, "left")
            leaves[lo:hi] = lo + np.searchsorted(t[lo:hi], t[lo:hi] + window_us, "right")
            newest[lo:hi] = t[hi - 1]
        here = np.arange(n)
        last, count = np.maximum(here - 1, first), here - first

        def inside(values):
            total = np.append(np.zeros(1, values.dtype), np.cumsum(values))
            return total[here] - total[first]

        # squares of steps outside of windows may wrap around, which differences of totals undo; wide windows take exact integers
        gap = np.append(0, t[1:] - t[:-1]).astype(np.int64 if window_us < 3_000_000_000 else object)
        g1, g2 = np.cumsum(gap), np.cumsum(gap * gap)
        g1, g2 = g1[last] - g1[first], g2[last] - g2[first]
        k = np.maximum(count - 1, 1)
        q = g1 // k  # moments about a whole number near the mean: no digits cancel
        var = (g2 - 2 * q * g1 + k * q * q).astype(float) / k - ((g1 - k * q).astype(float) / k) ** 2
        out = [count, distinct_before(num, w["dst"], leaves), distinct_before(num, w["port"], leaves), inside(w["flag"].to_numpy(np.int64)), count / (window_us / 1e6),
               inside(w["bytes"].to_numpy(np.int64)), g1.astype(float) / k / 1e6, np.sqrt(np.maximum(var, 0.0)) / 1e6]
        stay = t >= newest - window_us
        return rows.assign(**{c: x[own].astype(float) for c, x in zip(V.HOST_AGGREGATES, out, strict=True)}), w[stay], num[stay]
    return fold


# ── alert gate ───────────────────────────────────────────────────────────────
def gate_fold(value: str, wait_us: int, rule: str, always: str | None = None):
    """Keep a row unless the key's last kept row blocks it; rows that `always` marks are kept whatever came before.

    Rows of many keys, numbered and in order, and (t, v) of the row that each kept last give the kept rows and the new state.
    """
    def fold(rows, number, state, state_number):
        keep, last = np.zeros(len(rows), dtype=bool), dict(zip(state_number.tolist(), zip(state["t"].tolist(), state["v"].tolist(), strict=True), strict=True))
        force = rows[always].eq(True).to_numpy(bool) if always else np.zeros(len(rows), dtype=bool)
        key = own = None
        for i, (k, t, v, f) in enumerate(zip(number.tolist(), rows["t_us"].tolist(), rows[value].tolist(), force.tolist(), strict=True)):
            if k != key:
                key, own = k, last.get(k)
            if own is None or f or t - own[0] >= wait_us or (v > own[1] if rule == "rise" else v != own[1]):
                keep[i], own = True, (int(t), int(v))
                last[k] = own
        return rows[keep], pd.DataFrame(list(last.values()), columns=["t", "v"], dtype=np.int64), np.fromiter(last, np.int64, len(last))
    return fold


def stream_drop_repeats(stream: DataFrame, *, key="flow_id", within="10 minutes", ts="ts") -> DataFrame:
    """Exactly repeated rows dropped within the watermark."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])
