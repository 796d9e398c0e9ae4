"""Address expressions: parsing, scope, reachability, subnet patterns."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, functions as F

from flowlens import values as V

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_RE = rf"^({_OCTET}\.){{3}}{_OCTET}$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ip4(c) -> Column:
    """IPv4 text -> LONG, null when it is not a valid dotted quad."""
    c = _col(c)
    o = F.split(c, r"\.")
    num = reduce(lambda a, b: a * F.lit(256) + b,
                 [F.get(o, F.lit(i)).try_cast("long") for i in range(4)])
    return F.when(c.rlike(IPV4_RE), num)


def ip6(c) -> Column:
    """IPv6 text -> 32 hex digits, null when it is not a valid address."""
    c = F.lower(_col(c))

    def with_quad(q):
        h = F.lpad(F.lower(F.hex(q)), 8, "0")
        return F.when(q.isNotNull(), F.concat(F.regexp_replace(c, r"[0-9.]+$", ""), F.substring(h, 1, 4),
                                              F.lit(":"), F.substring(h, 5, 4))).otherwise(c)

    def filled(lr):
        gap = F.lit(8) - F.size(lr["l"]) - F.size(lr["r"])
        return F.when(gap >= 1, F.concat(lr["l"], F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), lr["r"])
                      ).otherwise(F.array().cast("array<string>"))

    def groups(h):
        words = lambda i: F.filter(F.split(F.get(h, F.lit(i)), ":"), lambda x: x != "")
        return (F.when(F.size(h) == 1, F.split(F.get(h, F.lit(0)), ":"))
                .when(F.size(h) == 2, let(F.struct(words(0).alias("l"), words(1).alias("r")), filled)))

    def render(g):
        return F.when((F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")),
                      F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), ""))

    text = F.when(c.contains("."), let(ip4(F.regexp_extract(c, r":([0-9.]+)$", 1)), with_quad)).otherwise(c)
    return F.when(c.contains(":") & ~c.rlike(r"(^:[^:])|([^:]:$)|:::"),
                  let(F.split(text, "::"), lambda h: let(groups(h), render)))


def is_valid_ip(c) -> Column:
    c = _col(c)
    return F.when(c.contains(":"), ip6(c).isNotNull()).otherwise(ip4(c).isNotNull())


def _bounds(cidr: str):
    net = ipaddress.ip_network(cidr, strict=False)
    return net.version, int(net.network_address), int(net.broadcast_address)


def _within(num: Column, cidrs) -> Column:
    """Numeric or hex address within one of the networks of its own version."""
    return any_of([num.between(*b) for b in cidrs])


def _split_versions(cidrs):
    v4, v6 = [], []
    for cidr in cidrs:
        version, lo, hi = _bounds(cidr)
        if version == 4:
            v4.append((lo, hi))
        else:
            v6.append((f"{lo:032x}", f"{hi:032x}"))
    return v4, v6


def in_cidrs(c, cidrs) -> Column:
    """True when the address lies in one of a fixed list of networks."""
    c = _col(c)
    v4, v6 = _split_versions(cidrs)
    six = let(ip6(c), lambda h: F.coalesce(_within(h, v6), F.lit(False))) if v6 else F.lit(False)
    four = let(ip4(c), lambda n: F.coalesce(_within(n, v4), F.lit(False))) if v4 else F.lit(False)
    return F.when(c.contains(":"), six).otherwise(F.coalesce(four, F.lit(False)))


def ip_scope(c, extra=()) -> Column:
    """'internal', 'external' or 'invalid'."""
    c = _col(c)
    v4, v6 = _split_versions(V.INTERNAL_CIDRS_V4 + V.INTERNAL_CIDRS_V6 + list(extra))

    def name(n, ranges):
        return (F.when(n.isNull(), "invalid").when(_within(n, ranges), "internal").otherwise("external"))

    return F.when(c.contains(":"), let(ip6(c), lambda h: name(h, v6))).otherwise(
        let(ip4(c), lambda n: name(n, v4)))


def is_internal(c, extra=()) -> Column:
    return ip_scope(c, extra) == "internal"


def is_external(c, extra=()) -> Column:
    return ip_scope(c, extra) == "external"


def _special4(n: Column) -> Column:
    return (_within(n, _split_versions(V.SPECIAL_CIDRS_V4)[0])
            & ~_within(n, _split_versions(V.SPECIAL_EXCEPTIONS_V4)[0]))


def _special6(h: Column) -> Column:
    return (_within(h, _split_versions(V.SPECIAL_CIDRS_V6)[1])
            & ~_within(h, _split_versions(V.SPECIAL_EXCEPTIONS_V6)[1]))


def ip_is_public(c) -> Column:
    """Globally routable: not special-purpose, multicast or reserved; bad text is False."""
    c = _col(c)
    multicast = _split_versions(["224.0.0.0/4"])[0]
    unicast6 = _split_versions(["2000::/3"])[1]

    def public4(n):
        return F.coalesce(~(_special4(n) | _within(n, multicast)), F.lit(False))

    def public6(h):
        mapped = F.conv(F.substring(h, 25, 8), 16, 10).cast("long")
        return F.coalesce(F.when(h.startswith("00000000000000000000ffff"), public4(mapped))
                          .otherwise(_within(h, unicast6) & ~_special6(h)), F.lit(False))

    return F.coalesce(F.when(c.contains(":"), let(ip6(c), public6)).otherwise(let(ip4(c), public4)), F.lit(False))


def is_private(c) -> Column:
    """Private, loopback or link-local; bad text is False."""
    c = _col(c)
    return F.coalesce(F.when(c.contains(":"), let(ip6(c), _special6)).otherwise(let(ip4(c), _special4)),
                      F.lit(False))


def is_multicast(c) -> Column:
    return in_cidrs(c, ["224.0.0.0/4", "ff00::/8"])


def is_non_unicast(c) -> Column:
    """Multicast, link-local, loopback, unspecified, or an IPv4 address ending in .255."""
    return in_cidrs(c, ["224.0.0.0/4", "169.254.0.0/16", "127.0.0.0/8", "0.0.0.0/32",
                        "ff00::/8", "fe80::/10", "::1/128", "::/128"]) | (
        _col(c).endswith(".255") & ip4(c).isNotNull())


def is_device_endpoint(c, extra=()) -> Column:
    """Addresses that can be an office device."""
    c = _col(c)
    low, first = F.lower(c), F.split_part(c, F.lit("."), F.lit(1)).try_cast("int")
    drop = ((c == "") | c.isin("0.0.0.0", "255.255.255.255") | c.startswith("127.")
            | c.startswith("169.254") | F.coalesce(first.between(224, 239), F.lit(False))
            | (c.contains(":") & (low.startswith("ff") | c.startswith("::") | low.startswith("fe80")))
            | c.endswith(".255"))
    return c.isNotNull() & ~drop & is_internal(c, extra)


def subnet_pattern(c) -> Column:
    """Private addresses to their /24 pattern, others to /16, anything else to ''."""
    c = _col(c)
    p = F.split(c, r"\.")
    o = [F.get(p, F.lit(i)) for i in range(3)]
    second = o[1].try_cast("int")
    private = (o[0] == "10") | ((o[0] == "192") & (o[1] == "168")) | (
        (o[0] == "172") & F.coalesce(second.between(16, 31), F.lit(False)))
    return (F.when(c.isNull() | (F.size(p) != 4), "")
            .when(private, F.concat_ws(".", o[0], o[1], o[2], F.lit("*")))
            .otherwise(F.concat_ws(".", o[0], o[1], F.lit("*"))))


def pseudonymize_ip(c, salt: str) -> Column:
    """First 16 hex digits of SHA-256 over salt and address."""
    return F.substring(F.sha2(F.concat(F.lit(salt), F.coalesce(_col(c), F.lit(""))), 256), 1, 16)
