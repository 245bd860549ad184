"""Streaming jobs driven by availableNow over files; batch result = stream result."""

import json
import os

from pyspark.sql import functions as F

from trustlens.operators import revocations as RV
from trustlens.sources import audit as S
from trustlens.streaming import jobs as X

EVENTS = [
    {"timestamp_ns": 60_000_000_000 + i * 7_000_000_000, "session_id": f"s{i}", "user_did": f"u{i % 3}",
     "resource_hash": "h", "decision": ["ALLOW", "DENY", "CHALLENGE"][i % 3], "risk_score": 0.1,
     "context_snapshot": json.dumps({"env": {"distance_km": float(i)}, "geo": "US"}), "latency_ms": float(i)}
    for i in range(40)
]


def _write_stream_files(d):
    os.makedirs(d, exist_ok=True)
    with open(f"{d}/part-0.txt", "w") as f:
        for e in EVENTS:
            f.write(json.dumps({"data": json.dumps(e)}) + "\n")
        f.write("not json\n")
        f.write(json.dumps({"other": 1}) + "\n")
        f.write(json.dumps({"data": json.dumps({**EVENTS[0], "decision": "MAYBE"})}) + "\n")
        f.write(json.dumps({"data": json.dumps({k: v for k, v in EVENTS[0].items() if k != "user_did"})}) + "\n")


def test_split_valid_batch(spark, tmpdir_run):
    _write_stream_files(f"{tmpdir_run}/in")
    raw = spark.read.text(f"{tmpdir_run}/in").withColumnRenamed("value", "raw")
    good, bad = S.split_valid(raw)
    assert good.count() == 40
    reasons = sorted(r.reason for r in bad.collect())
    assert reasons == ["envelope not json", "missing user_did", "no data field", "unknown decision"]


def test_stream_rollup_equals_batch(spark, tmpdir_run):
    _write_stream_files(f"{tmpdir_run}/in")
    raw = S.read_audit_stream(spark, f"{tmpdir_run}/in")
    good, _ = S.split_valid(raw)
    q = (X.stream_rollup_1m(good, watermark="0 seconds").writeStream.format("memory").queryName("roll1m")
         .outputMode("append").option("checkpointLocation", f"{tmpdir_run}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    streamed = {(r.user_did, r.n) for r in spark.sql("select * from roll1m").collect()}
    b, _ = S.split_valid(spark.read.text(f"{tmpdir_run}/in").withColumnRenamed("value", "raw"))
    batch = b.withColumn("m", F.floor(F.col("timestamp_ns") / 60_000_000_000)).groupBy("user_did", "m").count()
    # the last window stays open under append mode until the watermark passes it
    last = max(r.m for r in batch.collect())
    assert streamed == {(r.user_did, r["count"]) for r in batch.collect() if r.m < last}


def test_write_audit_idempotent_and_dedupe(spark, tmpdir_run):
    _write_stream_files(f"{tmpdir_run}/in")
    good, _ = S.split_valid(S.read_audit_stream(spark, f"{tmpdir_run}/in"))
    X.write_audit(X.dedupe(good), f"{tmpdir_run}/out", f"{tmpdir_run}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmpdir_run}/out").count() == 40


def _lines(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")


def test_write_audit_keeps_what_other_checkpoints_wrote(spark, tmpdir_run):
    _write_stream_files(f"{tmpdir_run}/in")
    for ck in ("a", "b"):
        good, _ = S.split_valid(S.read_audit_stream(spark, f"{tmpdir_run}/in"))
        X.write_audit(good, f"{tmpdir_run}/out", f"{tmpdir_run}/{ck}").awaitTermination()
    out = spark.read.parquet(f"{tmpdir_run}/out")
    assert out.count() == 80 and out.filter("yyyymm = 197001").count() == 80


def test_latest_reads_only_new_files(spark, tmpdir_run):
    _write_stream_files(f"{tmpdir_run}/in")
    os.utime(f"{tmpdir_run}/in/part-0.txt", (1_600_000_000, 1_600_000_000))
    _lines(f"{tmpdir_run}/in/part-1.txt", [{"data": "new"}])
    raw = S.read_audit_stream(spark, f"{tmpdir_run}/in", start="latest", since="2022-01-01 00:00:00")
    q = (raw.writeStream.format("memory").queryName("latest_only").trigger(availableNow=True)
         .option("checkpointLocation", f"{tmpdir_run}/ck").start())
    q.awaitTermination()
    assert [r.raw for r in spark.sql("select raw from latest_only").collect()] == ['{"data": "new"}']
    try:
        S.read_audit_stream(spark, f"{tmpdir_run}/in", start="latest")
        raise AssertionError("since is needed")
    except ValueError:
        pass


def test_late_rows_are_routed_alike_on_a_retry(spark, tmpdir_run):
    schema = "id int, timestamp_ns long"
    sec = 1_000_000_000
    _lines(f"{tmpdir_run}/in/a.json", [{"id": 1, "timestamp_ns": 5000 * sec}])
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmpdir_run}/in")
    run = lambda: X.route_late(stream(), f"{tmpdir_run}/on", f"{tmpdir_run}/late", f"{tmpdir_run}/ck").awaitTermination()
    run()
    _lines(f"{tmpdir_run}/in/b.json", [{"id": 2, "timestamp_ns": 4000 * sec}, {"id": 3, "timestamp_ns": 9000 * sec}])
    run()
    for _ in range(2):  # the second time the last batch runs again, as after a crash before its commit
        assert {r.id for r in spark.read.parquet(f"{tmpdir_run}/on").collect()} == {1, 3}
        assert {r.id for r in spark.read.parquet(f"{tmpdir_run}/late").collect()} == {2}
        commits = sorted(int(x) for x in os.listdir(f"{tmpdir_run}/ck/commits") if x.isdigit())
        for name in (f"{commits[-1]}", f".{commits[-1]}.crc"):
            if os.path.exists(f"{tmpdir_run}/ck/commits/{name}"):
                os.remove(f"{tmpdir_run}/ck/commits/{name}")
        run()


def test_maintain_revocations_and_enforce(spark, tmpdir_run):
    d, root = f"{tmpdir_run}/revs", f"{tmpdir_run}/state"
    names = ["credential_id", "issuer_did", "timestamp", "reason"]
    schema = "credential_id string, issuer_did string, timestamp long, reason string"
    stream = lambda: spark.readStream.schema(schema).json(d)
    run = lambda: X.maintain_revocations(stream(), root, f"{tmpdir_run}/ck", compact_every=2).awaitTermination()
    requests = lambda: spark.readStream.schema("credential_id string").json(f"{tmpdir_run}/req")
    enforce = lambda: X.enforce_stream(requests(), root, f"{tmpdir_run}/flagged", f"{tmpdir_run}/ck2").awaitTermination()
    flagged = lambda: {(r.credential_id, r.revoked) for r in spark.read.parquet(f"{tmpdir_run}/flagged").collect()}
    state = lambda: sorted((r.credential_id, r.reason) for r in X.revocation_state(spark, root).collect())
    assert state() == []
    _lines(f"{d}/a.json", [dict(zip(names, r)) for r in [("c1", "i", 1, "x"), ("c2", "i", 2, "y"), ("c1", "i", 3, "z")]])
    run()
    assert state() == [("c1", "z"), ("c2", "y")] and RV.count_revoked(X.revocation_state(spark, root)).first()[0] == 2
    _lines(f"{tmpdir_run}/req/a.json", [{"credential_id": c} for c in ("c1", "c9")])
    enforce()
    assert flagged() == {("c1", True), ("c9", False)}
    for n, reason in enumerate("pqrstu"):  # c9 is revoked after the request stream has begun
        _lines(f"{d}/b{n}.json", [dict(zip(names, ("c9", "i", 10 + n, reason)))])
        run()
    assert state() == [("c1", "z"), ("c2", "y"), ("c9", "u")]
    assert len([x for x in os.listdir(root) if x[:2] in ("v=", "d=")]) < 9  # old batches and versions are gone
    _lines(f"{tmpdir_run}/req/b.json", [{"credential_id": "c9"}])
    enforce()
    assert ("c9", True) in flagged()


def test_score_stream_and_alerts(spark, tmpdir_run):
    _write_stream_files(f"{tmpdir_run}/in")
    good, _ = S.split_valid(spark.read.text(f"{tmpdir_run}/in").withColumnRenamed("value", "raw"))
    base = spark.createDataFrame([("u0", 0.0, 1.0), ("u1", 20.0, 10.0)], "user_did string, mean double, sd double")
    scored = X.score_stream(good, base)
    by = {}
    for r in scored.collect():
        by.setdefault(r.user_did, []).append(r)
    row = by["u0"][0]
    assert abs(row.z_score - row.raw_value) < 1e-9 and row.anomaly_score == min(abs(row.z_score) / 2.5, 1.0)
    hit = X.alerts(scored).collect()
    assert hit and all(r.anomaly_score > 0.8 for r in hit)


def test_two_consumers_have_their_own_offsets(spark, tmpdir_run):
    _write_stream_files(f"{tmpdir_run}/in")
    def sink(name):
        return lambda s, ck: (s.writeStream.format("memory").queryName(name).option("checkpointLocation", ck)
                              .trigger(availableNow=True).start())
    a, b = X.two_consumers(S.read_audit_stream(spark, f"{tmpdir_run}/in"), sink("cons_a"), sink("cons_b"), f"{tmpdir_run}/ck")
    a.awaitTermination(), b.awaitTermination()
    assert spark.table("cons_a").count() == spark.table("cons_b").count() == 44


def test_sinks_and_snapshots(spark, tmpdir_run):
    good, _ = S.split_valid(_raw(spark, tmpdir_run))
    S.save_audit(good, f"{tmpdir_run}/audit")
    assert S.load_audit(spark, f"{tmpdir_run}/audit", users=["u1"], since="1970-01-01 00:02:00").count() == good.filter(
        "user_did = 'u1' AND timestamp_ns >= 120000000000").count()
    S.save_rollup(good.selectExpr("user_did", "timestamp_ns AS window_start_ns"), f"{tmpdir_run}/roll")
    assert spark.read.parquet(f"{tmpdir_run}/roll").filter("yyyymm = 197001").count() == 40
    S.export_features(good.select("timestamp_ns", "latency_ms"), f"{tmpdir_run}/csv")
    S.export_features(good.select("timestamp_ns", "latency_ms"), f"{tmpdir_run}/csv3", limit=3)
    read = lambda p: spark.read.option("header", True).csv(p).count()
    assert (read(f"{tmpdir_run}/csv"), read(f"{tmpdir_run}/csv3")) == (40, 3)
    S.save_json_rows(good.select("user_did"), f"{tmpdir_run}/json")
    assert spark.read.json(f"{tmpdir_run}/json").count() == 40
    for run in ("1", "2", "3"):
        kept = S.snapshot({"t": good.select("user_did")}, f"{tmpdir_run}/snap", run, keep=2)
    assert kept == ["3", "2"] and spark.read.parquet(f"{tmpdir_run}/snap/run=3/t").count() == 40


def _raw(spark, tmpdir_run):
    _write_stream_files(f"{tmpdir_run}/in")
    return spark.read.text(f"{tmpdir_run}/in").withColumnRenamed("value", "raw")


def test_panic_denials_finds_what_fail_closed_tags(spark):
    from trustlens.operators import decisions as D
    d = spark.createDataFrame([("u", "s1", "{}"), ("u", "s2", '{"a":{"b":1}}'), ("u", "s3", None), ("v", "s4", '{"a":2}')],
                              "user_did string, session_id string, context_snapshot string")
    out = D.fail_closed(d, F.col("user_did") == "u")
    assert {(r.user_did, r.sessions) for r in S.panic_denials(out).collect()} == {("u", 3)}
    assert out.filter("session_id = 's2'").select(F.get_json_object("context_snapshot", "$.a.b")).first()[0] == "1"


def test_trigger_options():
    assert S.trigger_opts(50, 200) == {"trigger": {"processingTime": "200 milliseconds"}, "maxOffsetsPerTrigger": 50}


def test_score_request_checks(spark):
    import pytest
    from trustlens.operators.anomaly import check_param_rows, check_params
    check_params("u", 300, "avg_latency")
    for bad in ((" ", 300, "avg_latency"), ("u", 0, "avg_latency"), ("u", 300, "nope")):
        with pytest.raises(ValueError):
            check_params(*bad)
    rows = spark.createDataFrame([("u", 300, "avg_latency"), (" ", 300, "avg_latency"), ("u", 90000, "avg_latency"), ("u", 1, "x")],
                                 "user_did string, window_seconds int, metric string")
    assert [r.error for r in check_param_rows(rows).collect()] == [None, "blank user", "window out of range", "unknown metric"]
