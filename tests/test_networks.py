"""Address keys and the prefix index (J6, B13) against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from trustlens.functions import net
from trustlens.operators import networks


def addresses(n=400):
    rng = random.Random(4)
    out = [None, "", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1.2.3.4 ", "a.b.c.d", "::", "::1", "1::", ":::", "1:::2",
           "::1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::ffff:1.2.3.4", "::1.2.3.256",
           "1:2:3:4:5:6:1.2.3.4", "2001:DB8::A", "g::1", "12345::", ":1", "1:", "::1.2.3", "1.2.3.4::", "fe80::1%eth0"]
    for _ in range(n):
        a = ipaddress.ip_address(rng.getrandbits(rng.choice([32, 128])))
        out.append(rng.choice([str, lambda x: x.exploded, lambda x: str(x).upper()])(a))
    return out


def test_keys_are_the_library_s(spark):
    rows = addresses()
    df = spark.createDataFrame([(i, a) for i, a in enumerate(rows)], "i int, a string")
    for r in df.select("i", "a", net.ip_to_key("a").alias("k")).collect():
        text = rows[r["i"]]
        try:
            want = None if text is None or text != text.strip() or "%" in text else net.ip_key(text)
        except ValueError:
            want = None
        if text == "01.2.3.4":  # zeros in front are digits here
            want = "01020304"
        assert r["k"] == want, text


def test_the_plan_of_a_range_test_stays_small(spark):
    df = spark.createDataFrame([("10.0.0.1",)], "a string")
    plan = df.select(~net.ip_in_cidr(F.col("a"), "10.0.0.0/8"))._jdf.queryExecution().toString()
    assert len(plan) < 30_000


def test_prefixes_are_the_least_set():
    rng = random.Random(1)
    for bits, make in ((32, ipaddress.IPv4Address), (128, ipaddress.IPv6Address)):
        for _ in range(300):
            lo, hi = sorted((rng.getrandbits(bits) >> rng.randrange(bits)) for _ in range(2))
            want = [(x.prefixlen, int(x.network_address)) for x in ipaddress.summarize_address_range(make(lo), make(hi))]
            assert networks.range_prefixes(lo, hi, bits) == want
    assert networks.range_prefixes(0, 2**32 - 1, 32) == [(0, 0)] and networks.range_prefixes(5, 4, 32) == []


def test_matches_against_the_library(spark):
    rng = random.Random(3)
    nets = [(f"a{i}", f"10.{rng.randrange(4)}.{rng.randrange(256)}.0/{rng.randrange(0, 33)}") for i in range(40)]
    nets += [(f"b{i}", f"2001:db8:{rng.randrange(8):x}::/{rng.randrange(0, 129)}") for i in range(40)]
    nets += [("span", "10.0.0.7-10.2.255.9"), ("back", "10.3.0.0-10.0.0.0"), ("v6span", "2001:db8::5-2001:db8:3::7")]
    ips = [f"10.{rng.randrange(5)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(150)]
    ips += [f"2001:db8:{rng.randrange(9):x}::{rng.randrange(9):x}" for _ in range(150)] + ["bad", None, "::ffff:10.0.0.1"]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ips)], "i int, ip string")
    got = {(r["i"], r["net_id"]) for r in networks.match_networks(df, "ip", networks.networks_frame(spark, nets)).collect()}
    want = set()
    for i, a in enumerate(ips):
        if a in ("bad", None):
            continue
        x = ipaddress.ip_address(a)
        for n, spec in nets:
            if "-" in spec:
                lo, hi = map(ipaddress.ip_address, spec.split("-"))
            else:
                v = ipaddress.ip_network(spec, strict=False)
                lo, hi = v.network_address, v.broadcast_address
            if lo.version == x.version and lo <= x <= hi:
                want.add((i, n))
    assert got == want


def test_a_crowded_site_has_one_candidate_for_each_length(spark):
    """One IPv6 /32 with 10,000 subnets: a row meets the join once for each length in use."""
    nets = [(f"n{i}", f"2001:db8:{i:x}::/48") for i in range(10_000)] + [("all", "2001:db8::/32")]
    frame = networks.networks_frame(spark, nets)
    df = spark.createDataFrame([(i, f"2001:db8:{i:x}::1") for i in range(0, 10_000, 100)], "i int, ip string")
    out = networks.match_networks(df, "ip", frame)
    assert {(r["i"], r["net_id"]) for r in out.collect()} == {(i, f"n{i}") for i in range(0, 10_000, 100)} | {
        (i, "all") for i in range(0, 10_000, 100)}
    assert sorted(r["_len"] for r in networks.network_prefixes(frame).select("_len").distinct().collect()) == [32, 48]
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
