"""Queries over the request binding (orders): decisions, labels, risk, rule sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import events as ev
from ..operators import decisions as D, health as H
from ..operators.rules import RuleSet, collect_pairs, collect_table, not_
from .bindings import REQUESTS_CTE, access_requests, table
from .q_anomaly import R
from .registry import query

FLAG_SQL = """coalesce(trust_score < 0.7, false) AS requires_2fa,
       coalesce(distance_km > 1000 AND time_delta_mins < 10, false) AS block,
       coalesce(distance_km > 1000 AND time_delta_mins < 10, false) AS alert,
       coalesce(resource_name = 'Admin', false) AS requires_biometric,
       NOT coalesce(distance_km > 1000 AND time_delta_mins < 10, false) AS allow"""

DECIDED = f"""{REQUESTS_CTE},
d AS (SELECT *, {FLAG_SQL} FROM requests),
l AS (SELECT *, CASE WHEN block THEN 'DENY' WHEN requires_2fa OR requires_biometric THEN 'CHALLENGE'
                     WHEN allow THEN 'ALLOW' ELSE 'DENY' END AS audit_label,
                CASE WHEN NOT allow THEN 'DENY' WHEN requires_2fa THEN 'CHALLENGE' ELSE 'ALLOW' END AS metric_label,
                CASE WHEN time_delta_mins > 0 THEN distance_km / time_delta_mins
                     WHEN distance_km > 0 THEN 9999.0 ELSE 0.0 END AS geo_speed
      FROM d),
r AS (SELECT *, least(greatest(1.0 - trust_score + CASE WHEN geo_speed > 15 THEN 0.5 ELSE 0.0 END
                               + coalesce(anomaly_score * 0.3, 0.0), 0.0), 1.0) AS risk FROM l)"""


@query("decide", "D1", f"""WITH {DECIDED}
SELECT request_id, allow, requires_2fa, requires_biometric, block, alert FROM r""")
def decide(spark, sf_dir):
    return D.decide(access_requests(spark, sf_dir)).select("request_id", *D.FLAGS)


@query("decision_labels", "D2 D3", f"""WITH {DECIDED}
SELECT request_id, audit_label, metric_label FROM r""")
def decision_labels(spark, sf_dir):
    d = D.metric_label(D.audit_label(D.decide(access_requests(spark, sf_dir))))
    return d.select("request_id", "audit_label", "metric_label")


@query("request_risk", "P10 P11 P12", f"""WITH {DECIDED}
SELECT request_id, round(geo_speed, {R}) AS geo_speed, round(risk, {R}) AS risk_score,
       CASE WHEN risk <= 0.5 THEN 'green' WHEN risk <= 0.8 THEN 'amber' ELSE 'red' END AS severity,
       CAST(floor(risk * 100 + 0.5) AS BIGINT) AS severity_pct FROM r""")
def request_risk(spark, sf_dir):
    r = access_requests(spark, sf_dir)
    risk = D.request_risk(r)
    return r.select("request_id",
                    F.round(ev.geo_speed("context.distance_km", "context.time_delta_mins"), R).alias("geo_speed"),
                    F.round(risk, R).alias("risk_score"), ev.severity(risk).alias("severity"),
                    ev.severity_pct(risk).alias("severity_pct"))


@query("to_audit_events", "D4", f"""WITH {DECIDED}
SELECT session_id, user_did, resource_hash, audit_label AS decision, round(risk, {R}) AS risk_score,
       epoch_us(o.o_orderdate) * 1000 AS timestamp_ns
FROM r JOIN orders o ON o.o_orderkey = r.request_id""")
def to_audit_events(spark, sf_dir):
    a = D.to_audit_events(access_requests(spark, sf_dir))
    return a.select("session_id", "user_did", "resource_hash", "decision",
                    F.round("risk_score", R).alias("risk_score"), "timestamp_ns")


@query("fail_closed", "D5", f"""WITH {DECIDED}
SELECT request_id, resource_hash = 'P' AS denied_by_panic_mode,
       CASE WHEN resource_hash = 'P' THEN false ELSE allow END AS allow,
       CASE WHEN resource_hash = 'P' THEN true ELSE requires_2fa END AS requires_2fa,
       CASE WHEN resource_hash = 'P' THEN true ELSE requires_biometric END AS requires_biometric,
       CASE WHEN resource_hash = 'P' THEN true ELSE block END AS block,
       CASE WHEN resource_hash = 'P' THEN true ELSE alert END AS alert,
       round(CASE WHEN resource_hash = 'P' THEN 1.0 ELSE risk END, {R}) AS risk_score,
       CASE WHEN resource_hash = 'P' THEN 'true' END AS tag FROM r""")
def fail_closed(spark, sf_dir):
    r = access_requests(spark, sf_dir)
    d = D.decide(r).withColumn("risk_score", D.request_risk(r)).withColumn(
        "context_snapshot", F.to_json(F.struct(F.col("context.distance_km").alias("km"))))
    out = D.fail_closed(d, F.col("resource.hash") == "P")
    return out.select("request_id", "denied_by_panic_mode", *D.FLAGS, F.round("risk_score", R).alias("risk_score"),
                      F.get_json_object("context_snapshot", "$.denied_by_panic_mode").alias("tag"))


# B-HL: events as the delivery log of five nodes; requests get a node and a time within it.
HEALTH_CTE = """hl AS (SELECT 'n' || (user_id % 5) AS node, epoch_us(ts) * 1000 AS t, event_id AS seq,
         event_type <> 'error' AS sent, CAST(floor(value * 60) AS BIGINT) AS backlog FROM events),
h1 AS (SELECT *, lag(sent) OVER (PARTITION BY node ORDER BY t, seq) AS ps,
              row_number() OVER (PARTITION BY node ORDER BY t, seq) AS rn FROM hl),
h2 AS (SELECT *, max(CASE WHEN ps IS NULL OR ps <> sent THEN t END) OVER (PARTITION BY node ORDER BY rn) AS since FROM h1),
h3 AS (SELECT *, max(CASE WHEN backlog >= 10000 OR (NOT sent AND t - since >= 300000000000) THEN rn END)
                   OVER (PARTITION BY node ORDER BY rn) AS entered,
              max(CASE WHEN backlog < 2000 AND sent AND t - since >= 30000000000 THEN rn END)
                   OVER (PARTITION BY node ORDER BY rn) AS exited FROM h2),
hs AS (SELECT node, t, seq, CASE WHEN entered > coalesce(exited, 0) THEN 'PANIC'
                                 WHEN backlog > 0 OR NOT sent THEN 'DEGRADED' ELSE 'NORMAL' END AS state FROM h3)"""


def _health_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("n"), (F.col("user_id") % 5).cast("string")).alias("node"),
                    (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_ns"), F.col("event_id").alias("seq"),
                    (F.col("event_type") != "error").alias("sent"),
                    F.floor(F.col("value") * 60).cast("long").alias("backlog"), F.lit(0).cast("long").alias("db_bytes"))


@query("health_states", "X4", f"WITH {HEALTH_CTE} SELECT node, seq, state FROM hs")
def health_states(spark, sf_dir):
    return H.health_states(_health_log(spark, sf_dir)).select("node", "seq", "state")


@query("deny_in_panic", "D5 X4", f"""WITH {DECIDED}, {HEALTH_CTE},
at_ AS (SELECT node, t, arg_max(state, seq) AS state FROM hs GROUP BY node, t),
q AS (SELECT r.*, 'n' || (o_custkey % 5) AS node, 1704067200000000000 + (o_orderkey * 7919 % 2592000) * 1000000000 AS t
      FROM r JOIN orders ON o_orderkey = request_id),
p AS (SELECT q.*, coalesce(at_.state = 'PANIC', false) AS bad FROM q ASOF LEFT JOIN at_ ON q.node = at_.node AND q.t >= at_.t)
SELECT request_id, bad AS denied_by_panic_mode, allow AND NOT bad AS allow, requires_2fa OR bad AS requires_2fa,
       requires_biometric OR bad AS requires_biometric, block OR bad AS block, alert OR bad AS alert,
       round(CASE WHEN bad THEN 1.0 ELSE risk END, {R}) AS risk_score FROM p""")
def deny_in_panic(spark, sf_dir):
    r = access_requests(spark, sf_dir)
    k = F.col("o_orderkey")
    where = table(spark, sf_dir, "orders").select(
        k.alias("request_id"), F.concat(F.lit("n"), (F.col("o_custkey") % 5).cast("string")).alias("node"),
        (F.lit(1_704_067_200_000_000_000) + k * 7919 % 2592000 * 1_000_000_000).alias("timestamp_ns"))
    d = D.decide(r).withColumn("risk_score", D.request_risk(r)).select("request_id", *D.FLAGS, "risk_score")
    periods = H.panic_periods(H.health_states(_health_log(spark, sf_dir)))
    out = D.deny_in_panic(d.join(where, "request_id"), periods)
    return out.select("request_id", "denied_by_panic_mode", *D.FLAGS, F.round("risk_score", R).alias("risk_score"))


@query("decision_report", "D7", f"""WITH {DECIDED}
SELECT audit_label AS label,
       CASE WHEN block THEN 'impossible_travel' WHEN requires_2fa AND requires_biometric THEN 'low_trust+admin'
            WHEN requires_2fa THEN 'low_trust' WHEN requires_biometric THEN 'admin_resource' ELSE 'none' END AS reason,
       resource_name AS resource, count(*) AS requests
FROM r GROUP BY ALL""")
def decision_report(spark, sf_dir):
    return D.decision_report(access_requests(spark, sf_dir))


def product_rules(trust_2fa=0.7, block_km=1000.0) -> RuleSet:
    """The product policy written as a RuleSet (D6) with an else-chain label."""
    trust, dist, mins = F.col("device.trust_score"), F.col("context.distance_km"), F.col("context.time_delta_mins")
    rs = RuleSet()
    for n in ("allow", "requires_2fa", "requires_biometric", "block", "alert"):
        rs.default(n, False)
    rs.rule("requires_2fa", trust < trust_2fa)
    rs.rule("block", dist > block_km, mins < 10)
    rs.rule("alert", dist > block_km, mins < 10)
    rs.rule("requires_biometric", F.col("resource.name") == "Admin")
    rs.rule("allow", not_(F.col("block")))
    rs.chain("label", ([F.col("block")], "DENY"),
             ([F.col("requires_2fa") | F.col("requires_biometric")], "CHALLENGE"),
             ([F.col("allow")], "ALLOW"), ([F.lit(True)], "DENY"))
    return rs


@query("rule_set", "D6 D6a D6b D6c D6d D6e D6f", f"""WITH {DECIDED}
SELECT request_id, allow, requires_2fa, block, audit_label AS label,
       CASE WHEN trust_score < 0.3 AND distance_km > 1500 THEN NULL
            WHEN trust_score < 0.3 THEN 'high' WHEN distance_km > 1500 THEN 'elevated' ELSE 'normal' END AS risk_band,
       coalesce(trust_score < 0.3 AND distance_km > 1500, false) AS risk_band__conflict,
       coalesce(trust_score < 0.2 OR resource_name = 'Admin', false) AS watch
FROM r""")
def rule_set(spark, sf_dir):
    rs = product_rules()
    rs.default("risk_band", "normal")
    rs.rule("risk_band", F.col("device.trust_score") < 0.3, value="high")
    rs.rule("risk_band", F.col("context.distance_km") > 1500, value="elevated")
    rs.default("watch", False)
    rs.rule("watch", F.col("device.trust_score") < 0.2)
    rs.rule("watch", F.col("requires_biometric"))
    out = rs.apply(access_requests(spark, sf_dir))
    return out.select("request_id", "allow", "requires_2fa", "block", "label", "risk_band",
                      "risk_band__conflict", "watch")


@query("rule_set_what_if", "D6l", f"""WITH {REQUESTS_CTE}
SELECT request_id, coalesce(0.95 < 0.7, false) AS requires_2fa,
       NOT coalesce(distance_km > 1000 AND time_delta_mins < 10, false) AS allow FROM requests""")
def rule_set_what_if(spark, sf_dir):
    r = access_requests(spark, sf_dir)
    out = product_rules().apply(r, overrides={"device": F.col("device").withField("trust_score", F.lit(0.95))})
    return out.select("request_id", "requires_2fa", "allow")


@query("policy_diff", "D8", f"""WITH {DECIDED},
b AS (SELECT request_id, CASE WHEN coalesce(distance_km > 500 AND time_delta_mins < 10, false) THEN 'DENY'
                              WHEN coalesce(trust_score < 0.8, false) OR resource_name = 'Admin' THEN 'CHALLENGE'
                              ELSE 'ALLOW' END AS label_b FROM requests)
SELECT r.request_id, r.audit_label AS label_a, b.label_b FROM r JOIN b USING (request_id)
WHERE r.audit_label IS DISTINCT FROM b.label_b""")
def policy_diff(spark, sf_dir):
    r = access_requests(spark, sf_dir).select("request_id", "device", "context", "resource")
    a = lambda df: product_rules().apply(df).drop(*D.FLAGS)
    b = lambda df: product_rules(0.8, 500.0).apply(df).drop(*D.FLAGS)
    return D.policy_diff(r, a, b).select("request_id", "label_a", "label_b")


@query("collected_values", "D6k", f"""WITH {REQUESTS_CTE}
SELECT DISTINCT resource_name, v FROM (
  SELECT resource_name, 'far' AS v FROM requests WHERE distance_km > 1000
  UNION ALL SELECT resource_name, 't' || CAST(floor(trust_score * 10) AS BIGINT) FROM requests WHERE trust_score < 0.55)""")
def collected_values(spark, sf_dir):
    trust = F.col("device.trust_score")
    r = access_requests(spark, sf_dir).withColumn("resource_name", F.col("resource.name"))
    return collect_table(r, [(F.col("context.distance_km") > 1000, "far"),
                             (trust < 0.55, F.concat(F.lit("t"), F.floor(trust * 10).cast("string")))], ("resource_name",), "v")


@query("collected_pairs", "D6k", """WITH p AS (
  SELECT o_custkey % 97 AS key, o_orderstatus AS value FROM orders WHERE o_orderstatus = 'P' OR o_custkey % 3 = 0
  UNION ALL SELECT 1000 + o_orderkey % 7, 'late' FROM orders WHERE o_orderstatus = 'O')
SELECT key, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, count(DISTINCT value) > 1 AS conflict
FROM p GROUP BY key""")
def collected_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    st = F.col("o_orderstatus")
    return collect_pairs(o, [((st == "P") | (F.col("o_custkey") % 3 == 0), F.col("o_custkey") % 97, st),
                             (st == "O", 1000 + F.col("o_orderkey") % 7, "late")])
