"""Window-state operators: previous login, health states, graph loops, stats."""

import numpy as np
from pyspark.sql import functions as F

from trustlens.functions.stats import exact_quantile, floor_index_pick, merge_moments, moments
from trustlens.operators import graphs, health, travel


def test_lag_within_crosses_slices(spark):
    rows = [("u", i * 3600 * 10**9, i) for i in range(60)]  # 60 hours, split by day
    df = spark.createDataFrame(rows, "user_did string, timestamp_ns long, event_id long")
    out = travel.lag_within(df, ["user_did"], "timestamp_ns", "event_id", ["event_id"])
    got = {r.event_id: r.prev_event_id for r in out.collect()}
    assert got[0] is None and all(got[i] == i - 1 for i in range(1, 60))


def _log(spark, rows):
    return spark.createDataFrame(rows, "node string, timestamp_ns long, seq long, sent boolean, backlog long, db_bytes long")


def test_health_degraded_then_panic_then_recover(spark):
    s = 10**9
    rows = [("n", i * s, i, True, 0, 0) for i in range(10)]
    rows += [("n", (10 + i) * s, 10 + i, False, i + 1, 0) for i in range(100)]
    st = {r.seq: r.state for r in health.health_states(_log(spark, rows)).collect()}
    assert st[9] == "NORMAL" and st[109] == "DEGRADED"
    rows2 = [("m", i * s // 100, i, False, i + 1, 0) for i in range(10_001)]
    st2 = {r.seq: r.state for r in health.health_states(_log(spark, rows2)).collect()}
    assert st2[10_000] == "PANIC" and st2[9_998] == "DEGRADED"
    # recovery needs backlog < 2000 and >= 30 s connected
    rows3 = [("k", 0, 0, False, 20_000, 0)] + [("k", (1 + i) * s, 1 + i, True, 1000, 0) for i in range(40)]
    st3 = {r.seq: r.state for r in health.health_states(_log(spark, rows3)).collect()}
    assert st3[0] == "PANIC" and st3[30] == "PANIC" and st3[31] == "DEGRADED"


def test_reachable_with_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "zz"), ("d", "e")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "node string")
    seeds = spark.createDataFrame([("a",), ("q",)], "node string")
    assert sorted(r.node for r in graphs.reachable(e, nodes, seeds).collect()) == ["a", "b", "c"]


def test_reachable_paths(spark):
    # d -> zz leaves the graph, c -> a repeats, "absent" is no node of the graph
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "zz")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    seeds = spark.createDataFrame([("a",), ("absent",)], "node string")
    got = sorted("".join(r.path) for r in graphs.reachable_paths(e, nodes, seeds).collect())
    assert got == ["abc", "abcd"]


def test_reachable_has_no_round_limit(spark):
    n = 30
    e = spark.createDataFrame([(i, i + 1) for i in range(n)], "src int, dst int")
    nodes = spark.createDataFrame([(i,) for i in range(n + 1)], "node int")
    assert graphs.reachable(e, nodes, spark.createDataFrame([(0,)], "node int")).count() == n + 1


def test_exact_quantiles_match_numpy(spark):
    vals = [float(x) for x in np.random.default_rng(1).integers(0, 50, 501)]
    df = spark.createDataFrame([("k", v) for v in vals], "k string, v double")
    q = exact_quantile(df, ["k"], "v", 0.99, "q").first()["q"]
    assert abs(q - float(np.quantile(vals, 0.99))) < 1e-9
    p = floor_index_pick(df, ["k"], "v", 0.95, "p").first()["p"]
    assert p == sorted(vals)[int(len(vals) * 0.95)]


def test_merge_moments_large_mean(spark):
    vals = [1e9 + x for x in (0.1, 0.2, 0.4, 0.8, 1.6, 3.2)]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(vals)], "g int, v double")
    st = df.groupBy("g").agg(*moments(F.col("v"))).withColumn("k", F.lit(1))
    got = merge_moments(st, ["k"]).first()
    assert abs(got["var_samp"] - float(np.var(vals, ddof=1))) < 1e-6
