"""IP to network matching as an equi join on address prefixes.

A range of addresses is cut into the least set of CIDR prefixes, at most two of each length.  An
address is in a prefix of length n when its first n bits are the prefix, so a row is joined by
(length, prefix), once for each prefix length that the networks use: 33 lengths at most for IPv4 and
129 for IPv6, however many networks there are and however they crowd in one site.  Nothing is left to
test after the join.
"""

from __future__ import annotations

import ipaddress

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import ip_key, ip_to_key

_BITS = {8: 32, 32: 128}  # digits of an address key -> bits of an address


def networks_frame(spark, nets: list[tuple[str, str]]) -> DataFrame:
    """(net_id, cidr or 'lo-hi') list -> DataFrame(net_id, lo, hi) of address keys, IPv4 or IPv6.
    A reversed range is kept and holds nothing."""
    rows = []
    for nid, spec in nets:
        if "-" in spec:
            rows.append((nid, *map(ip_key, spec.split("-", 1))))
        else:
            net = ipaddress.ip_network(spec.strip(), strict=False)
            rows.append((nid, ip_key(str(net.network_address)), ip_key(str(net.broadcast_address))))
    return spark.createDataFrame(rows, "net_id string, lo string, hi string")


def range_prefixes(lo: int, hi: int, bits: int) -> list[tuple[int, int]]:
    """The least set of (length, first address) whose addresses are lo..hi."""
    out = []
    while lo <= hi:
        # the largest block that starts at lo, is aligned there and ends by hi
        size = min(lo & -lo if lo else 1 << bits, 1 << (hi - lo + 1).bit_length() - 1)
        out.append((bits - size.bit_length() + 1, lo))
        lo += size
    return out


def _prefix_text(key: str, length: int) -> str:
    """The first ``length`` bits of a key: its whole digits, and the rest of one with 0 bits behind."""
    whole, part = divmod(length, 4)
    return key[:whole] + (f"{int(key[whole], 16) & 15 << 4 - part & 15:x}" if part else "")


def _prefix_column(key: Column, length: int) -> Column:
    whole, part = divmod(length, 4)
    if not part:
        return F.left(key, F.lit(whole))
    digit = F.conv(F.substring(key, whole + 1, 1), 16, 10).cast("int").bitwiseAND(F.lit(15 << 4 - part & 15))
    return F.concat(F.left(key, F.lit(whole)), F.lower(F.hex(digit)))


def _prefixes(batches):
    for b in batches:
        at, digits, length, prefix = [], [], [], []
        for i, (lo, hi) in enumerate(zip(b.column("lo").to_pylist(), b.column("hi").to_pylist())):
            if lo is not None and hi is not None and len(lo) == len(hi):
                for n, first in range_prefixes(int(lo, 16), int(hi, 16), _BITS[len(lo)]):
                    at.append(i)
                    digits.append(len(lo))
                    length.append(n)
                    prefix.append(_prefix_text(f"{first:0{len(lo)}x}", n))
        rows = b.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(digits, pa.int32()), pa.array(length, pa.int32()),
                                          pa.array(prefix, pa.string())], [*b.schema.names, "_digits", "_len", "_prefix"])


def network_prefixes(nets: DataFrame) -> DataFrame:
    """``nets`` (lo, hi, ..) with a row for each prefix: plus _digits (of its keys), _len, _prefix."""
    schema = ", ".join(f"`{c}` {t}" for c, t in nets.dtypes) + ", _digits int, _len int, _prefix string"
    return nets.mapInArrow(_prefixes, schema)


def match_networks(df: DataFrame, ip_col: str, nets: DataFrame) -> DataFrame:
    """Rows x networks (lo, hi) with lo <= ip <= hi.  A prefix that holds much of the table is left
    to AQE's skew join, or to its broadcast of networks that are measured to be few."""
    prefixes = network_prefixes(nets)
    used = prefixes.select("_digits", "_len").distinct().collect()  # at most 33 + 129 lengths
    key = F.col("_ip")
    none = F.array().cast("array<struct<_len:int,_prefix:string>>")

    def of(digits: int) -> Column:
        lengths = sorted(r["_len"] for r in used if r["_digits"] == digits)
        if not lengths:
            return none
        return F.array(*[F.struct(F.lit(n).alias("_len"), _prefix_column(key, n).alias("_prefix")) for n in lengths])
    rows = df.withColumn("_ip", ip_to_key(ip_col)).filter(key.isNotNull()).withColumn("_digits", F.length(key))
    rows = rows.withColumn("_p", F.explode(F.when(F.col("_digits") == 8, of(8)).otherwise(of(32))))
    rows = rows.withColumn("_len", F.col("_p._len")).withColumn("_prefix", F.col("_p._prefix"))
    return rows.join(prefixes, ["_digits", "_len", "_prefix"]).drop("_digits", "_len", "_prefix", "_p", "_ip")
