from pyspark.sql import functions as F

from trustlens.model import REQUEST_SCHEMA
from trustlens.operators import decisions as D

# (trust, distance, minutes, resource) -> allow, 2fa, biometric, block, alert, audit label, metric label
CASES = [
    (0.9, 10.0, 60.0, "Dashboard", (True, False, False, False, False), "ALLOW", "ALLOW"),
    (0.5, 10.0, 60.0, "Dashboard", (True, True, False, False, False), "CHALLENGE", "CHALLENGE"),
    (0.9, 5000.0, 5.0, "Dashboard", (False, False, False, True, True), "DENY", "DENY"),
    (0.9, 10.0, 60.0, "Admin", (True, False, True, False, False), "CHALLENGE", "ALLOW"),
    (0.7, 10.0, 60.0, "Dashboard", (True, False, False, False, False), "ALLOW", "ALLOW"),
    (0.9, 1000.0, 9.0, "Dashboard", (True, False, False, False, False), "ALLOW", "ALLOW"),
    (0.9, 5.0, 0.0, "Dashboard", (True, False, False, False, False), "ALLOW", "ALLOW"),
]


def _requests(spark):
    rows = [(f"s{i}", "u", (t, "d"), (d, m, None), (r, "h")) for i, (t, d, m, r, *_ ) in enumerate(CASES)]
    return spark.createDataFrame(rows, REQUEST_SCHEMA)


def test_policy_flags_and_labels(spark):
    out = D.metric_label(D.audit_label(D.decide(_requests(spark)))).orderBy("session_id").collect()
    for row, case in zip(out, CASES):
        flags = tuple(row[k] for k in ("allow", "requires_2fa", "requires_biometric", "block", "alert"))
        assert flags == case[4], case
        assert row["audit_label"] == case[5]
        assert row["metric_label"] == case[6]


def test_risk_zero_minutes(spark):
    r = _requests(spark).filter("session_id = 's6'")
    row = r.select(D.request_risk(r).alias("risk"),
                   F.col("context.distance_km")).first()
    # speed 9999 > 15 -> +0.5; 1 - 0.9 + 0.5 = 0.6
    assert abs(row["risk"] - 0.6) < 1e-9


def test_missing_input_is_false(spark):
    r = spark.createDataFrame([("s", "u", (None, "d"), (None, None, None), (None, "h"))], REQUEST_SCHEMA)
    row = D.decide(r).first()
    assert (row.requires_2fa, row.block, row.alert, row.requires_biometric, row.allow) == (False, False, False, False, True)


def test_fail_closed(spark):
    d = D.decide(_requests(spark)).withColumn("risk_score", F.lit(0.1)).withColumn("latency_ms", F.lit(3.0))
    out = D.fail_closed(d, F.col("session_id") == "s0").filter("session_id = 's0'").first()
    assert (out.allow, out.requires_2fa, out.block, out.risk_score, out.latency_ms) == (False, True, True, 1.0, 0.0)
    assert out.denied_by_panic_mode


def test_flatten_context_matches_binding_map(spark):
    from trustlens.functions.events import ctx, ctx_number, flatten_context
    from trustlens.plans.bindings import audit_events
    a = audit_events(spark, "/root/testdata/sf0.001")
    rows = a.select(flatten_context("context_snapshot").alias("f"), "context").collect()
    assert rows and all(r.f == r.context for r in rows)
    row = spark.createDataFrame([('{"a": "x", "b": {"c": 1}, "n": null}',), ("[1]",)], "j string") \
        .select(flatten_context("j").alias("m")).collect()
    assert row[0].m == {"a": "x", "b": '{"c":1}', "n": "null"} and row[1].m == {}
    one = spark.createDataFrame([({"env": '{"distance_km": "bad"}'},)], "m map<string,string>")
    r = one.select(ctx("m", "geo").alias("g"), ctx_number("m", "env", "$.distance_km").alias("d")).first()
    assert (r.g, r.d) == ("", 0.0)
