"""Severity ladders, ranks, logit fusion and calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowlens import values as V


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def severity_of(p, ladder: str = "cascade") -> Column:
    """Severity name of a score by one of the threshold ladders."""
    out = None
    for name, floor in V.LADDERS[ladder]:
        cond = _col(p) >= floor
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(V.LADDER_FLOOR.get(ladder, "BENIGN"))


def lookup(c, table: dict, default=None) -> Column:
    """Fixed-table lookup; missing keys give the default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    got = F.try_element_at(F.create_map(*pairs), _col(c))
    return got if default is None else F.coalesce(got, F.lit(default))


def severity_rank(c) -> Column:
    return lookup(c, V.SEVERITY_RANK, 0)


def severity_name(rank) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in V.SEVERITY_BY_RANK]), _col(rank).cast("int") + 1)


def bump(rank) -> Column:
    """One step up; BENIGN stays, CRITICAL is the top."""
    r = _col(rank)
    return F.when(r <= 0, r).otherwise(F.least(r + 1, F.lit(4)))


def clip(p, eps: float = V.EPS) -> Column:
    return F.least(F.greatest(_col(p), F.lit(eps)), F.lit(1.0) - F.lit(eps))


def logit(p, eps: float = V.EPS) -> Column:
    c = clip(p, eps)
    return F.log(c / (F.lit(1.0) - c))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x)))


def temperature_scale(p, temperature: float = V.TEMPERATURE, eps: float = V.EPS) -> Column:
    return sigmoid(logit(p, eps) / F.lit(temperature))


def fuse_logit(probs, weights=tuple(V.ENSEMBLE_WEIGHTS), eps: float = V.EPS) -> Column:
    """Sigmoid of the weighted sum of log-odds."""
    total = sum((F.lit(w) * logit(p, eps) for p, w in zip(probs, weights)), F.lit(0.0))
    return sigmoid(total)


def score_stage1(probs, weights=tuple(V.ENSEMBLE_WEIGHTS), temperature: float | None = V.TEMPERATURE,
                 eps: float = V.EPS) -> Column:
    """Calibrated attack probability of the member probabilities."""
    fused = fuse_logit(probs, weights, eps)
    return fused if temperature is None else temperature_scale(fused, temperature, eps)


def business_hours(ts, zone: str = "UTC") -> Column:
    """True inside business hours on a weekday."""
    local = F.from_utc_timestamp(_col(ts), zone)
    return (F.weekday(local) < 5) & F.hour(local).between(V.BUSINESS_START, V.BUSINESS_END)


def post_holiday(ts, holidays=tuple(V.HOLIDAYS), zone: str = V.HOLIDAY_ZONE,
                 hours: int = V.HOLIDAY_HOURS) -> Column:
    """On a holiday, or in the first hours of the day after one, in the given zone."""
    local = F.from_utc_timestamp(_col(ts), zone)
    days = [F.lit(d).cast("date") for d in holidays]
    day = F.to_date(local)
    return day.isin(*days) | (F.date_sub(day, 1).isin(*days) & (F.hour(local) < hours))
