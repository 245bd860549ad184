"""Health states with timers, on the stream and as a batch; requests in panic periods."""

import glob
import os
import random

from pyspark.sql import functions as F

from trustlens.operators import decisions, health
from trustlens.operators.travel import lag_within, slice_seconds
from trustlens.streaming.health_stream import advance, health_stream

LOG = "node string, timestamp_ns long, seq long, sent boolean, backlog long, db_bytes long"
S = 1_000_000_000


def log_rows(seed=3, n=160):
    rng = random.Random(seed)
    out, seq = [], 0
    for node in "abc":
        t = 0
        for _ in range(n):
            t += rng.choice([1, 5, 20, 29, 31, 100, 301, 700]) * S
            out.append((node, t, seq, rng.random() < .6, rng.choice([0, 1, 1500, 2500, 12_000]), rng.choice([0] * 9 + [10**9])))
            seq += 1
    return out


def machine(rows, until):
    """Rows and timers one by one, per node."""
    out = set()
    for node in {r[0] for r in rows}:
        _, _, got = advance(None, [r[1:] for r in rows if r[0] == node], until)
        out |= {(node, *g) for g in got}
    return out


def test_batch_with_timers_is_the_machine(spark):
    rows = log_rows()
    until = max(r[1] for r in rows) + 1000 * S
    timed = health.with_timers(spark.createDataFrame(rows, LOG), until)
    got = health.health_states(timed).select("node", "timestamp_ns", "seq", "state", "timer")
    want = machine(rows, until)
    assert {tuple(r) for r in got.collect()} == want and any(w[4] for w in want)


def test_stream_is_the_batch_and_timers_fire_without_input(spark, tmpdir_run):
    rows = sorted(log_rows(n=60), key=lambda r: r[1])
    rows = [r for r in rows if r[0] != "c" or r[1] < 1500 * S]  # node c falls silent
    end = max(r[1] for r in rows)
    os.makedirs(f"{tmpdir_run}/in")
    cut = len(rows) // 3
    for i in range(3):
        part = rows[i * cut:] if i == 2 else rows[i * cut:(i + 1) * cut]
        spark.createDataFrame(part, LOG).coalesce(1).write.parquet(f"{tmpdir_run}/t{i}")
        os.rename(glob.glob(f"{tmpdir_run}/t{i}/part-*.parquet")[0], f"{tmpdir_run}/in/{i}.parquet")
        # a restart for each file
        log = spark.readStream.schema(LOG).parquet(f"{tmpdir_run}/in")
        q = (health_stream(log, "1 minute").writeStream.format("parquet").option("path", f"{tmpdir_run}/out")
             .option("checkpointLocation", f"{tmpdir_run}/ck").trigger(availableNow=True).start())
        q.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{tmpdir_run}/out").collect()}
    mark = (end - 60 * S) // 1_000_000 * 1_000_000
    want = machine(rows, mark)
    assert got == want
    silent = max(r[1] for r in rows if r[0] == "c")
    assert any(g[0] == "c" and g[1] > silent and g[4] for g in got)


def test_periods_and_requests(spark):
    rows = log_rows(seed=9)
    states = health.health_states(spark.createDataFrame(rows, LOG))
    by = {}
    for r in sorted(states.collect(), key=lambda r: (r["timestamp_ns"], r["seq"])):
        by.setdefault(r["node"], []).append((r["timestamp_ns"], r["state"]))
    rng = random.Random(1)
    points = [(i, rng.choice(["a", "b", "c", "zz", None]), rng.randrange(40_000) * S) for i in range(400)]
    points += [(1000 + i, n, t) for i, (n, t) in enumerate((n, t) for n, v in by.items() for t, _ in v[:40])] + [(5000, "a", None)]
    df = spark.createDataFrame(points, "id int, node string, timestamp_ns long").withColumn("allow", F.lit(True))
    out = decisions.deny_in_panic(df, health.panic_periods(states))
    got = {r["id"]: (r["denied_by_panic_mode"], r["allow"], r["block"]) for r in out.collect()}
    assert len(got) == len(points)
    for i, node, t in points:
        past = [s for at, s in by.get(node, []) if t is not None and at <= t]
        bad = bool(past) and past[-1] == "PANIC"
        assert got[i] == (bad, not bad, True if bad else None), (i, node, t)
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_no_periods(spark):
    states = health.health_states(spark.createDataFrame([], LOG))
    df = spark.createDataFrame([(1, "a", 5)], "id int, node string, timestamp_ns long")
    assert [r["in"] for r in health.in_periods(df, health.panic_periods(states), "in").collect()] == [False]


def test_slices_follow_the_rows(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), (F.col("id") * S).alias("t"), "id")
    assert slice_seconds(df, ["k"], "t") == 86_400
    fine = slice_seconds(df, ["k"], "t", 100)
    assert 1 <= fine <= 100 and slice_seconds(df.limit(0), ["k"], "t", 1) == 86_400
    got = lag_within(df, ["k"], "t", "id", ["id"], fine)
    assert {r["id"]: r["prev_id"] for r in got.collect()} == {i: i - 1 if i else None for i in range(1000)}
