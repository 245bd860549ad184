"""Operators that no registered query runs: membership, functions, sets, normal forms, sketches, snapshots."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustlens.functions import conditions as B
from trustlens.functions import events as ev
from trustlens.operators import revocations as RV
from trustlens.operators import rollups
from trustlens.operators import rules as R


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_membership(spark):
    """D6i: in an array, in an object's values, at a key; undefined is false."""
    a, m = F.array(F.lit(1), F.lit(2)), F.create_map(F.lit("k"), F.lit(7))
    none = F.lit(None).cast("array<int>")
    assert one(spark, R.in_(F.lit(2), a), R.in_(F.lit(3), a), R.in_(F.lit(7), m, "values"), R.in_(F.lit(8), m, "values"),
               R.in_(F.lit("k"), m, "key"), R.in_(F.lit("z"), m, "key"), R.in_(F.lit(1), none),
               R.in_(F.lit(None).cast("int"), a)) == (True, False, True, False, True, False, False, False)
    with pytest.raises(ValueError):
        R.in_(F.lit(1), a, "set")


def test_functions_with_several_definitions(spark):
    """U1 and U2, called from a rule; the first definition that holds gives the value."""
    rs = R.RuleSet().function("twice", lambda x: x * 2)
    rs.define("band", (lambda x: x > 10, lambda x: F.lit("high")), (lambda x: x > 5, lambda x: F.concat(F.lit("m"), x.cast("string"))),
              default="low")
    rs.define("none", default=0)
    rs.rule("big", rs.call("twice", F.col("v")) > 10)
    rs.chain("label", ([F.lit(True)], rs.call("band", F.col("v"))))
    df = spark.createDataFrame([(11,), (6,), (5,), (None,)], "v int")
    out = rs.apply(df).select("label", "big", rs.call("none").alias("n")).collect()
    assert [tuple(r) for r in out] == [("high", True, 0), ("m6", True, 0), ("low", None, 0), ("low", None, 0)]
    with pytest.raises(KeyError):
        rs.call("absent")


def test_rules_that_collect_over_the_table(spark):
    """D6k with a key that holds most rows, conflicts, undefined conditions and values."""
    rows = [("hot", i % 3, "x") for i in range(3000)] + [("a", None, "y"), (None, 1, "z"), ("b", 1, None)]
    df = spark.createDataFrame(rows, "k string, v int, g string")
    got = R.collect_table(df, [(F.col("v") >= 1, F.col("k")), (F.col("g") == "y", F.lit("lit"))], ("g",), "s")
    assert {tuple(r) for r in got.collect()} == {("x", "hot"), ("y", "lit"), (None, "b")} and got.count() == 3
    pairs = R.collect_pairs(df, [(F.col("v") >= 0, F.col("k"), F.col("v")), (F.lit(True), F.lit("all"), F.lit(5))])
    assert {tuple(r) for r in pairs.collect()} == {("hot", None, True), ("b", 1, False), ("all", 5, False)}
    assert R.collect_pairs(df.limit(0), [(F.lit(True), F.col("k"), F.col("v"))], ("g",)).count() == 0


def test_sets_of_sets(spark):
    s = lambda *x: F.array(*map(F.lit, x))
    sets = F.array(s("c", "a"), s("a", "b", "a"), s("a"))
    empty = F.array().cast("array<array<string>>")
    assert one(spark, RV.union_of_sets(sets), RV.intersection_of_sets(sets), RV.union_of_sets(empty), RV.intersection_of_sets(empty),
               RV.set_difference(s("b", "a"), s("b"))) == (["a", "b", "c"], ["a"], [], [], ["a"])


def test_normal_forms_of_condition_values(spark):
    """B22."""
    got = one(spark, B.to_lower(F.lit("AbÇ")), B.to_upper(F.lit("ab")), B.trim(F.lit("  x ")),
              F.sort_array(B.normalize_set(F.array(F.lit("b"), F.lit("a"), F.lit("b")))), B.normalize_list(F.lit("x")),
              F.date_format(B.add_days(F.lit("2024-02-28T23:00:00Z"), 2), "yyyy-MM-dd HH:mm"),
              F.date_format(B.add_days(F.lit("2024-01-01T01:00:00+02:00"), -1), "yyyy-MM-dd HH:mm"),
              B.to_time(F.lit("01:02:03")))
    assert got[:7] == ("abç", "AB", "x", ["a", "b"], ["x"], "2024-03-01 23:00", "2023-12-30 23:00")
    assert got[7] == 3723


def test_risk_with_an_anomaly(spark):
    """The anomaly adds 0.3 of itself; none adds nothing; the sum stays within 0 and 1."""
    cases = [(0.9, 10.0, 60.0, 0.5, 0.25), (0.9, 10.0, 60.0, None, 0.1), (0.2, 5000.0, 5.0, 1.0, 1.0), (1.0, 0.0, 0.0, 0.0, 0.0),
             (1.0, 10.0, 60.0, -1.0, 0.0)]
    df = spark.createDataFrame(cases, "t double, d double, m double, a double, want double")
    for r in df.select(ev.risk_score(F.col("t"), F.col("d"), F.col("m"), F.col("a")).alias("got"), "want").collect():
        assert r["got"] == pytest.approx(r["want"])


def test_merged_sketch_quantile_is_within_its_rank_error(spark):
    """The p99 of distance from merged per-minute sketches against the exact ranks."""
    rng = np.random.default_rng(2)
    values = np.round(rng.gamma(2.0, 300.0, 20_000), 3)
    rows = [(f"u{i % 2}", i * 3_000_000_000, float(v), float(v), "ALLOW") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "user_did string, timestamp_ns long, latency_ms double, distance_km double, decision string")
    stored = rollups.rollup_latency_1m(df, 3600)
    for r in rollups.merge_latency(stored).collect():
        mine = np.sort([v for u, _, _, v, _ in rows if u == r["user_did"]])
        low, high = (np.searchsorted(mine, r["p99"], side) / len(mine) for side in ("left", "right"))
        assert low - 0.02 <= 0.99 <= high + 0.02
    assert {r["user_did"] for r in rollups.merge_latency(stored).collect()} == {"u0", "u1"}


def test_unreadable_snapshots_are_rebuilt_and_other_faults_raised(spark, tmpdir_run, caplog):
    log = spark.createDataFrame([("c", "i", 5, "r")], f"{RV.KEY} string, issuer_did string, timestamp long, reason string")
    import os
    os.makedirs(f"{tmpdir_run}/bad")
    with open(f"{tmpdir_run}/bad/part-0.parquet", "w") as f:
        f.write("this is no parquet file, whatever its name says")
    spark.createDataFrame([(1,)], "other int").write.parquet(f"{tmpdir_run}/columns")
    for name in ("absent", "bad", "columns"):
        with caplog.at_level("WARNING"):
            assert RV.load_or_rebuild(spark, f"{tmpdir_run}/{name}", log).count() == 1
        assert name in caplog.text
    RV.current_revocations(log).write.parquet(f"{tmpdir_run}/good")
    assert RV.load_or_rebuild(spark, f"{tmpdir_run}/good", log.limit(0)).count() == 1
    with pytest.raises(Exception):  # noqa: B017 - a scheme that no file system has
        RV.load_or_rebuild(spark, "nosuchscheme://x/y", log)


def test_entry_says_what_is_missing(capsys):
    import __spark_entry__ as entry
    assert entry._optional("trustlens.llm.absent") is None and entry._optional("absent_module") is None
    assert capsys.readouterr().err == ""
    assert json.dumps(sorted(entry.queries())[:1])
