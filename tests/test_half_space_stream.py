"""Half-Space Trees over micro-batches give what the batch operator gives over all events."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from trustlens.operators.halfspace import half_space_scores, score_windows
from trustlens.streaming.half_space import half_space_stream, scored_events

SCHEMA = "event_id long, timestamp_ns long, user_did string, a double, b double"
OPTIONS = dict(window_seconds=10, key="user_did", features=("a", "b"), n_trees=6, height=7)


def rows(n=900):
    rng = random.Random(6)
    out = []
    for i in range(n):
        t = i * 150_000_000 + rng.randrange(2_000_000_000)  # up to two seconds out of order
        out.append((i, t, rng.choice(["x", "x", "y", None]) if i % 300 < 240 else "x", rng.gauss(i // 300, 1), rng.random()))
    return out


def write(spark, part, path, i):
    spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{path}/tmp{i}")
    os.makedirs(f"{path}/in", exist_ok=True)
    os.rename(glob.glob(f"{path}/tmp{i}/part-*.parquet")[0], f"{path}/in/{i:03}.parquet")


def run(spark, d):
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    half_space_stream(events, f"{d}/out", f"{d}/state", f"{d}/ck", delay_seconds=3, **OPTIONS).awaitTermination()
    return {r["event_id"]: r for r in scored_events(spark, f"{d}/out").collect()}


def test_batches_retry_and_restart_equal_the_batch(spark, tmpdir_run):
    data = rows()
    for i in range(3):
        write(spark, data[i * 250:(i + 1) * 250], tmpdir_run, i)
    first = run(spark, tmpdir_run)
    # the last batch is tried again, as after a crash before its commit
    last = max(glob.glob(f"{tmpdir_run}/ck/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    os.remove(os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc"))
    again = run(spark, tmpdir_run)
    assert again == first
    # a restart with more events goes on from the stored model
    write(spark, data[750:], tmpdir_run, 3)
    late = [(9_000, 1_000_000_000, "x", 0.0, 0.5)]
    write(spark, late, tmpdir_run, 4)
    got = run(spark, tmpdir_run)
    closed = (max(r[1] for r in data) - 3_000_000_000) // 10_000_000_000
    assert set(got) == {r[0] for r in data if r[1] // 10_000_000_000 < closed} | {9_000}
    assert got.pop(9_000)["late"] and not any(r["late"] for r in got.values())
    df = spark.createDataFrame(data, SCHEMA)
    want = {r["event_id"]: r["hst_score"] for r in half_space_scores(df, **OPTIONS).collect()}
    assert any(v["hst_score"] is not None for v in got.values())
    for i, r in got.items():
        assert (r["hst_score"] is None) == (want[i] is None), i
        assert want[i] is None or r["hst_score"] == pytest.approx(want[i], abs=1e-9), i


def test_a_model_carried_over_equals_one_call(spark):
    """score_windows in two calls, cut between windows; a key that has no event in the second."""
    df = spark.createDataFrame(rows(600), SCHEMA)
    cut = 40_000_000_000
    one, two = df.filter(F.col("timestamp_ns") < cut), df.filter((F.col("timestamp_ns") >= cut) & (F.col("user_did") != "y"))
    a, stats, leaves = score_windows(one, **OPTIONS)
    b, stats2, _ = score_windows(two, before=(stats, leaves), **OPTIONS)
    whole, _, _ = score_windows(one.unionByName(two), **OPTIONS)
    got = {r[0]: r[1] for r in a.unionByName(b).collect()}
    want = {r[0]: r[1] for r in whole.collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in got)
    assert {r["user_did"] for r in stats2.collect()} == {None, "x", "y"}
