"""IPv4 helpers: dotted quad <-> long, CIDR bounds."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bind

_QUAD = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def ip_to_long(col) -> Column:
    """Dotted IPv4 text -> long; anything else (or an octet > 255) -> NULL."""
    c = F.col(col) if isinstance(col, str) else col
    parts = [F.regexp_extract(c, _QUAD, i).try_cast("long") for i in range(1, 5)]
    ok = c.rlike(_QUAD)
    for p in parts:
        ok = ok & (p <= 255)
    val = parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3]
    return F.when(F.coalesce(ok, F.lit(False)), val)


def ip_key(ip: str) -> str:
    """Driver-side: an address as hex of fixed width (8 digits, IPv6 32), in address order."""
    a = ipaddress.ip_address(ip.strip())
    return f"{int(a):0{a.max_prefixlen // 4}x}"


_GROUPS = r"(?i)^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$"


def _hex(group: Column, width: int) -> Column:
    return F.lpad(F.lower(group), width, "0")


def _v4_key(c: Column) -> Column:
    """Dotted quad -> 8 hex digits; anything else -> NULL."""
    def key(parts: Column) -> Column:
        ok = (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike("^[0-9]{1,3}$") & (p.try_cast("int") <= 255))
        return F.when(ok, F.array_join(F.transform(parts, lambda p: _hex(F.hex(p.try_cast("long")), 2)), ""))
    return bind(F.split(c, "[.]"), key)


def _v6_key(c: Column) -> Column:
    """IPv6 text, perhaps with one ``::`` and a dotted quad at its end -> 32 hex digits, else NULL."""
    def of_halves(h: Column) -> Column:
        left, right = F.get(h, F.lit(0)), F.coalesce(F.get(h, F.lit(1)), F.lit(""))
        groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
        plain = (F.size(h) <= 2) & left.rlike(_GROUPS) & right.rlike(_GROUPS)

        def key(g: Column) -> Column:
            n = F.size(g["l"]) + F.size(g["r"])
            ok = g["ok"] & F.when(F.size(h) == 2, n <= 7).otherwise(n == 8)
            all_ = F.concat(g["l"], F.array_repeat(F.lit("0"), F.lit(8) - n), g["r"])
            return F.when(ok, F.array_join(F.transform(all_, lambda x: _hex(x, 4)), ""))
        return bind(F.struct(groups(left).alias("l"), groups(right).alias("r"), plain.alias("ok")), key)

    def of_quad(quad: Column) -> Column:
        text = F.when(quad == "", c).otherwise(bind(_v4_key(quad), lambda q: F.concat(
            F.left(c, F.length(c) - F.length(quad)), F.left(q, F.lit(4)), F.lit(":"), F.right(q, F.lit(4)))))
        return bind(F.split(text, "::"), of_halves)
    return bind(F.regexp_extract(c, r":([0-9.]+[.][0-9.]+)$", 1), of_quad)


def ip_to_key(col) -> Column:
    """Address text -> the key of ``ip_key``; anything else -> NULL.  An IPv6 address may have
    one ``::`` and end in a dotted quad.  Every step is worked out once for a row."""
    c = F.col(col) if isinstance(col, str) else col
    return bind(c, lambda x: F.when(F.instr(x, ":") > 0, _v6_key(x)).otherwise(_v4_key(x)))


def cidr_bounds(cidr: str) -> tuple[int, int]:
    """Driver-side: 'a.b.c.d/n' (or a bare address) -> (lo, hi) as ints."""
    net = ipaddress.ip_network(cidr.strip(), strict=False)
    if net.version != 4:
        raise ValueError(f"only IPv4 is supported: {cidr}")
    return int(net.network_address), int(net.broadcast_address)


def cidr_is_valid(cidr: str) -> bool:
    try:
        ipaddress.ip_network(cidr.strip(), strict=False)
        return "/" in cidr
    except ValueError:
        return False


def ip_in_cidr(ip_col, cidr: str) -> Column:
    net = ipaddress.ip_network(cidr.strip(), strict=False)
    return ip_in_range(ip_col, str(net.network_address), str(net.broadcast_address))


def ip_in_range(ip_col, lo_ip: str, hi_ip: str) -> Column:
    lo, hi = ip_key(lo_ip), ip_key(hi_ip)
    # a reversed range holds nothing; an address of the other family is in no range
    return bind(ip_to_key(ip_col), lambda v: F.when(
        v.isNotNull(), v.between(F.lit(lo), F.lit(hi)) & (F.length(v) == len(lo))))


def cidr_expand(spark, cidr: str):
    """Row generator: one row per address of a CIDR (spark.range, distributed, any size)."""
    lo, hi = cidr_bounds(cidr)
    r = spark.range(lo, hi + 1)
    return r.select(F.concat_ws(".", *[((F.col("id") / (1 << s)).cast("long") % 256).cast("string")
                                      for s in (24, 16, 8, 0)]).alias("ip"))
