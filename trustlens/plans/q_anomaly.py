"""Queries over the audit binding: anomaly scores (M1, M2) and their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly
from .bindings import AS_OF, AS_OF_NS, AUDIT_CTE, audit_events, audit_users
from .registry import query

R = 6  # doubles are rounded to 6 places on both sides (sums are order dependent)
W = 86400
NS = 1_000_000_000
BASE = 7 * 86400


def rnd(df, *cols):
    return df.select(*[F.round(c, R).alias(c) if c in cols else F.col(c) for c in df.columns])


def _m1_sql(metric: str, window: int) -> str:
    lo_w = AS_OF_NS - window * NS
    lo_b = AS_OF_NS - BASE * NS
    if metric == "avg_latency":
        raw = "avg(latency_ms)"
        base = f"""SELECT user_did, avg(latency_ms) AS m, stddev_pop(latency_ms) AS s
                   FROM audit WHERE timestamp_ns >= {lo_b} GROUP BY user_did"""
    else:
        expr = ("avg(CASE WHEN decision = 'DENY' THEN 1.0 ELSE 0.0 END)" if metric == "deny_rate"
                else "CAST(count(DISTINCT coalesce(geo, '')) AS DOUBLE) / count(*)")
        raw = expr
        base = f"""SELECT user_did, avg(v) AS m, stddev_pop(v) AS s FROM (
                     SELECT user_did, timestamp_ns // 300000000000 AS b, {expr} AS v
                     FROM audit WHERE timestamp_ns >= {lo_b} GROUP BY user_did, b) GROUP BY user_did"""
    return f"""WITH {AUDIT_CTE},
users AS (SELECT DISTINCT user_did FROM audit),
w AS (SELECT user_did, count(*) AS n, {raw} AS raw FROM audit WHERE timestamp_ns >= {lo_w} GROUP BY user_did),
b AS ({base}),
j AS (SELECT u.user_did, coalesce(w.n, 0) AS n, coalesce(w.raw, 0.0) AS raw,
             coalesce(b.m, 0.0) AS m, coalesce(b.s, 0.0) AS s
      FROM users u LEFT JOIN w ON u.user_did = w.user_did LEFT JOIN b ON u.user_did = b.user_did),
z AS (SELECT *, (raw - m) / greatest(s, 1e-9) AS z FROM j)
SELECT user_did, {window} AS window_seconds, '{metric}' AS metric, n AS event_count,
       round(raw, {R}) AS raw_value, round(m, {R}) AS mean_baseline, round(s, {R}) AS stddev_baseline,
       round(z, {R}) AS z_score, round(least(abs(z) / 2.5, 1.0), {R}) AS anomaly_score,
       abs(z) > 2.5 AS is_anomaly, CAST(2.5 AS DOUBLE) AS threshold
FROM z"""


SCORE_COLS = ("raw_value", "mean_baseline", "stddev_baseline", "z_score", "anomaly_score")


def m1(metric: str, window: int = W):
    def build(spark, sf_dir):
        df = anomaly.anomaly_scores(audit_events(spark, sf_dir, AS_OF_NS - BASE * NS), AS_OF, window, metric,
                                    users=audit_users(spark, sf_dir))
        return rnd(df, *SCORE_COLS)
    return build


for _metric in ("avg_latency", "deny_rate", "geo_velocity"):
    query(f"anomaly_{_metric}", "M1 A1-A6 J2 F2 F3", _m1_sql(_metric, W))(m1(_metric))
query("anomaly_avg_latency_300s", "M1 A1 A4 F2", _m1_sql("avg_latency", 300))(m1("avg_latency", 300))


@query("anomaly_matrix", "M2",
       " UNION ALL ".join(f"SELECT * FROM ({_m1_sql(m, 3600)})"
                          for m in ("avg_latency", "deny_rate", "geo_velocity")))
def anomaly_matrix(spark, sf_dir):
    recent = audit_events(spark, sf_dir, AS_OF_NS - BASE * NS)
    return rnd(anomaly.anomaly_matrix(recent, AS_OF, 3600, users=audit_users(spark, sf_dir)), *SCORE_COLS)
