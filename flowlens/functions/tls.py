"""TLS and name expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowlens import values as V
from flowlens.functions.ip import any_of, let


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _dashes(arr, drop_grease: bool) -> Column:
    a = F.coalesce(_col(arr), F.array().cast("array<int>"))
    if drop_grease:
        a = F.filter(a, lambda x: ~x.isin(V.GREASE))
    return F.array_join(F.transform(a, lambda x: x.cast("string")), "-")


def ja3_hash(version, ciphers, extensions, curves, formats, drop_grease: bool = True) -> Column:
    """MD5 of the client-hello fields; optionally without randomised values."""
    parts = [_dashes(x, drop_grease) for x in (ciphers, extensions, curves, formats)]
    return F.md5(F.concat_ws(",", _col(version).cast("string"), *parts))


def ja3s_hash(version, cipher, extensions) -> Column:
    return F.md5(F.concat_ws(",", _col(version).cast("string"), _col(cipher).cast("string"),
                             _dashes(extensions, False)))


def sni_is_ip(c) -> Column:
    """Empty, an address literal, or a placeholder name."""
    s = F.lower(F.trim(_col(c)))
    return (F.coalesce(_col(c), F.lit("")) == "") | s.isin(V.SNI_PLACEHOLDERS) | s.rlike(
        r"^\d{1,3}(\.\d{1,3}){3}$|^\[?[0-9a-f:]+\]?$")


def normal_tls_version(c) -> Column:
    """Lower-cased version text; sensor spellings folded to the scored ones."""
    v = F.lower(F.trim(_col(c)))
    for seen, meant in V.TLS_VERSION_ALIASES.items():
        v = F.when(v == seen, meant).otherwise(v)
    return v


def tls_version_score(c) -> Column:
    v = normal_tls_version(c)
    out = F.lit(0.0)
    for names, score in reversed(V.TLS_VERSION_SCORES):
        out = F.when(v.isin(names), score).otherwise(out)
    return out


def _sum(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def byte_entropy(counts) -> Column:
    """Shannon entropy in bits of an array of counts."""
    a = F.filter(F.transform(_col(counts), lambda x: x.cast("double")), lambda x: x > 0)
    # H = log2(total) - sum(c * log2(c)) / total
    parts = F.aggregate(a, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("h")),
                        lambda s, x: F.struct((s["n"] + x).alias("n"), (s["h"] + x * F.log2(x)).alias("h")),
                        lambda s: F.when(s["n"] > 0, F.log2(s["n"]) - s["h"] / s["n"]).otherwise(F.lit(0.0)))
    return parts


def _moments(a) -> Column:
    """STRUCT(n, mean, std) of an array, population deviation about the mean."""
    return let(F.try_divide(_sum(a), F.size(a)), lambda m: F.struct(
        F.size(a).alias("n"), m.alias("mean"),
        F.sqrt(F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)), F.size(a))).alias("std")))


def splt_score(lengths, times) -> Column:
    """Score of packet-length and timing regularity, at most 0.50."""
    ln = F.transform(F.coalesce(_col(lengths), F.array().cast("array<double>")), lambda x: x.cast("double"))
    tm = F.transform(F.coalesce(_col(times), F.array().cast("array<double>")), lambda x: x.cast("double"))

    def by_length(m):
        cv = F.try_divide(m["std"], m["mean"])
        return (F.when((m["n"] < 5) | (m["mean"] <= 0), 0.0).when((cv < 0.05) & (m["mean"] < 500), 0.35)
                .when((cv < 0.10) & (m["mean"] < 200), 0.20).otherwise(0.0))

    def by_time(m):
        cv = F.try_divide(m["std"], m["mean"])
        return (F.when((m["n"] < 4) | (m["mean"] <= 0.1), 0.0).when((cv < 0.05) & (m["mean"] > 5), 0.30)
                .when((cv < 0.15) & (m["mean"] > 10), 0.15).otherwise(0.0))

    def by_direction(a):
        out_avg = _sum(F.filter(a, lambda x, i: i % 2 == 0)) / F.greatest(F.ceil(F.size(a) / 2), F.lit(1))
        in_avg = _sum(F.filter(a, lambda x, i: i % 2 == 1)) / F.greatest(F.floor(F.size(a) / 2), F.lit(1))
        return let(F.struct(out_avg.alias("o"), in_avg.alias("i")), lambda d: F.when(
            (F.size(a) >= 6) & (d["o"] > 0) & (d["i"] > 0) & (F.try_divide(d["o"], d["i"]) > 10) & (d["o"] > 1000), 0.25).otherwise(0.0))

    def gaps(t):
        k = F.greatest(F.size(t) - 1, F.lit(0))
        return F.filter(F.zip_with(F.slice(t, 2, k), F.slice(t, 1, k), lambda b, a: b - a), lambda g: g > 0)

    def score(a):
        timing = F.when(F.size(tm) >= 5, let(gaps(tm), lambda g: let(_moments(g), by_time))).otherwise(0.0)
        return F.least(let(_moments(a), by_length) + F.coalesce(timing, F.lit(0.0)) + by_direction(a), F.lit(0.50))

    return F.when(F.size(ln) >= 5, let(ln, score)).otherwise(F.lit(0.0))


def domain_suffixes(c) -> Column:
    """The name and each of its parents, most specific first."""
    p = F.split(F.lower(_col(c)), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(p)),
                       lambda i: F.array_join(F.slice(p, i, F.size(p)), "."))


def sld(c) -> Column:
    """Last two labels; null for names with one label."""
    p = F.split(F.lower(_col(c)), r"\.")
    return F.when(F.size(p) >= 2, F.array_join(F.slice(p, -2, 2), "."))


def first_pattern(c, patterns) -> Column:
    """First of a fixed list of substrings found in the text, else null."""
    s = F.lower(_col(c))
    return F.coalesce(*[F.when(s.contains(p), F.lit(p)) for p in patterns])


def bank_lookalike(c, patterns=tuple(V.BANK_LOOKALIKES)) -> Column:
    return first_pattern(c, patterns)


def sni_device_hint(c, patterns=tuple(V.SNI_DEVICE_PATTERNS)) -> Column:
    """STRUCT(vendor, os, device_type) of the first matching pattern, else null."""
    s = F.lower(_col(c))
    return F.coalesce(*[F.when(s.contains(m), F.struct(F.lit(v).alias("vendor"), F.lit(o).alias("os"),
                                                       F.lit(d).alias("device_type")))
                        for m, v, o, d in patterns])


def sysdescr_class(c) -> Column:
    """Device class of a description text, null when nothing matches."""
    s = F.lower(_col(c))
    out = F.lit(None).cast("string")
    for cls, words in reversed(V.SYSDESCR_KEYWORDS):
        out = F.when(any_of([s.contains(w) for w in words]), cls).otherwise(out)
    return out
