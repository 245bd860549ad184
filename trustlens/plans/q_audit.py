"""Queries over the audit binding: event expressions, rollups, merges, 3-sigma scorer,
dashboard metrics, previous-login features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import events as ev
from ..operators import metrics, rollups, travel
from ..operators.anomaly import for_user, trailing
from .bindings import AS_OF, AS_OF_NS, AUDIT_CTE, COORDS_SQL, audit_events, audit_with_coords
from .q_anomaly import R, rnd
from .registry import query

NS = 1_000_000_000


@query("feature_rows", "P1 P2 P3 P4 P6 P7 P8", f"""WITH {AUDIT_CTE}
SELECT event_id, latency_ms, round(risk_score, {R}) AS risk_score, distance_km,
       CAST(hour(ts) AS INTEGER) AS hour_of_day,
       CASE decision WHEN 'DENY' THEN 1 WHEN 'CHALLENGE' THEN 2 ELSE 0 END AS decision,
       round(device_trust_score, {R}) AS device_trust_score,
       coalesce(geo, '') AS geo, strftime(ts, '%Y-%m-%d %H:%M') AS minute,
       CAST(year(ts) * 100 + month(ts) AS INTEGER) AS yyyymm
FROM audit""")
def feature_rows(spark, sf_dir):
    a = audit_events(spark, sf_dir)
    # P1 on the wire form: the context map is re-derived from the JSON snapshot here
    f = a.select("event_id", "timestamp_ns", "latency_ms", "risk_score", "decision",
                 ev.flatten_context("context_snapshot").alias("context"))
    return f.select("event_id", *ev.feature_columns(), ev.ctx("context", "geo").alias("geo"),
                    F.date_format(ev.ns_to_ts(ev.minute_ns("timestamp_ns")), "yyyy-MM-dd HH:mm").alias("minute"),
                    ev.yyyymm(ev.ns_to_ts("timestamp_ns")).alias("yyyymm")
                    ).withColumns({c: F.round(c, R) for c in ("risk_score", "device_trust_score")})


@query("stream_features", "P9", f"""WITH {AUDIT_CTE}
SELECT event_id, latency_ms AS latency, round(risk_score, {R}) AS risk_score, distance_km AS distance FROM audit""")
def stream_features(spark, sf_dir):
    a = audit_events(spark, sf_dir)
    return a.select("event_id", *ev.stream_columns()).withColumn("risk_score", F.round("risk_score", R))


@query("scan_user_window", "S8 F1 F2", f"""WITH {AUDIT_CTE}
SELECT event_id, user_did, latency_ms FROM audit
WHERE user_did = 'u7' AND timestamp_ns >= {AS_OF_NS - 10 * 86400 * NS}""")
def scan_user_window(spark, sf_dir):
    a = audit_events(spark, sf_dir, AS_OF_NS - 10 * 86400 * NS, "u7")
    return trailing(for_user(a, "u7"), AS_OF, 10 * 86400).select("event_id", "user_did", "latency_ms")


def _rollup_sql(grain: int) -> str:
    return f"""WITH {AUDIT_CTE}
SELECT user_did, (timestamp_ns // {grain * NS}) * {grain * NS} AS window_start_ns,
       count(latency_ms) AS n, round(sum(latency_ms), {R}) AS sum,
       round(var_pop(latency_ms) * count(latency_ms), {R}) AS m2
FROM audit GROUP BY ALL"""


def _rollup(grain):
    def build(spark, sf_dir):
        r = rollups.rollup_latency_1m(audit_events(spark, sf_dir), grain)
        return rnd(r.select("user_did", "window_start_ns", "n", "sum", "m2"), "sum", "m2")
    return build


query("rollup_latency_1m", "A7", _rollup_sql(60))(_rollup(60))
query("rollup_latency_1d", "A7", _rollup_sql(86400))(_rollup(86400))


@query("merge_latency", "A8", f"""WITH {AUDIT_CTE}
SELECT user_did, count(latency_ms) AS n, round(avg(latency_ms), {R}) AS mean,
       round(var_samp(latency_ms), {R}) AS var_samp FROM audit GROUP BY user_did""")
def merge_latency(spark, sf_dir):
    r = rollups.rollup_latency_1m(audit_events(spark, sf_dir), 60)
    m = rollups.merge_latency(r).select("user_did", "n", "mean", "var_samp")
    return rnd(m, "mean", "var_samp")


@query("merge_latency_by_day", "A8", f"""WITH {AUDIT_CTE}
SELECT user_did, (timestamp_ns // {86400 * NS}) AS day, count(latency_ms) AS n,
       round(avg(latency_ms), {R}) AS mean, round(var_samp(latency_ms), {R}) AS var_samp
FROM audit GROUP BY ALL""")
def merge_latency_by_day(spark, sf_dir):
    r = rollups.rollup_latency_1m(audit_events(spark, sf_dir), 60)
    r = r.withColumn("day", F.floor(F.col("window_start_ns") / (86400 * NS)).cast("long"))
    m = rollups.merge_latency(r, ("user_did", "day")).select("user_did", "day", "n", "mean", "var_samp")
    return rnd(m, "mean", "var_samp")


@query("p99_distance", "A9", f"""WITH {AUDIT_CTE}
SELECT user_did, round(quantile_cont(distance_km, 0.99), {R}) AS p99 FROM audit GROUP BY user_did""")
def p99_distance(spark, sf_dir):
    return rnd(rollups.p99_distance(audit_events(spark, sf_dir)), "p99")


def _logins_sql(grain: int | None) -> str:
    key = "" if grain is None else f", (timestamp_ns // {grain * NS}) * {grain * NS} AS window_start_ns"
    return f"""WITH {AUDIT_CTE}
SELECT user_did{key},
       count(*) FILTER (WHERE decision = 'ALLOW') AS allow_count,
       count(*) FILTER (WHERE decision = 'DENY') AS deny_count,
       count(*) FILTER (WHERE decision = 'CHALLENGE') AS challenge_count
FROM audit GROUP BY ALL"""


@query("rollup_logins_1m", "A10", _logins_sql(60))
def rollup_logins_1m(spark, sf_dir):
    return rollups.rollup_logins_1m(audit_events(spark, sf_dir)).drop("yyyymm")


@query("merge_logins_hour", "A11", _logins_sql(3600))
def merge_logins_hour(spark, sf_dir):
    r = rollups.rollup_logins_1m(audit_events(spark, sf_dir))
    return rollups.merge_logins(r, "hour")


@query("merge_logins_all", "A11", _logins_sql(None))
def merge_logins_all(spark, sf_dir):
    return rollups.merge_logins(rollups.rollup_logins_1m(audit_events(spark, sf_dir)), "all")


@query("latest_event", "W1", f"""WITH {AUDIT_CTE}
SELECT user_did, timestamp_ns, event_id, latency_ms, decision FROM (
  SELECT *, row_number() OVER (PARTITION BY user_did ORDER BY timestamp_ns DESC, event_id DESC) AS rn
  FROM audit) WHERE rn = 1""")
def latest_event(spark, sf_dir):
    a = audit_events(spark, sf_dir).select("user_did", "timestamp_ns", "event_id", "latency_ms", "decision")
    return rollups.latest_event(a)


@query("latest_outliers", "M3 J3 A8 A9 W1", f"""WITH {AUDIT_CTE},
st AS (SELECT user_did, avg(latency_ms) AS mean, var_samp(latency_ms) AS var,
              quantile_cont(distance_km, 0.99) AS p99 FROM audit GROUP BY user_did),
lt AS (SELECT user_did, latency_ms, distance_km FROM (
  SELECT *, row_number() OVER (PARTITION BY user_did ORDER BY timestamp_ns DESC, event_id DESC) AS rn
  FROM audit) WHERE rn = 1),
j AS (SELECT lt.user_did, lt.latency_ms, lt.distance_km, coalesce(st.mean, 0.0) AS mean,
             CASE WHEN coalesce(st.var, 0.0) > 0 THEN sqrt(st.var) ELSE 0.0 END AS sd,
             coalesce(st.p99, 0.0) AS p99
      FROM lt LEFT JOIN st ON lt.user_did = st.user_did),
k AS (SELECT *, CASE WHEN sd > 0 THEN (latency_ms - mean) / sd ELSE 0.0 END AS z,
             sd > 0 AND latency_ms > mean + 3 * sd AS lat_out, p99 > 0 AND distance_km > p99 AS dist_out FROM j)
SELECT user_did, latency_ms, distance_km, round(mean, {R}) AS baseline_mean, round(sd, {R}) AS std_dev,
       round(p99, {R}) AS p99, round(z, {R}) AS z_score,
       round(CASE WHEN dist_out THEN 0.99 WHEN z > 0 THEN 1.0 - 1.0 / (1.0 + z) ELSE 0.0 END, {R}) AS anomaly_score,
       lat_out OR dist_out AS is_outlier, CAST(0.7 AS DOUBLE) AS threshold
FROM k""")
def latest_outliers(spark, sf_dir):
    a = audit_events(spark, sf_dir)
    out = rollups.latest_outliers(a, rollups.baseline_exact(a))
    return rnd(out, "baseline_mean", "std_dev", "p99", "z_score", "anomaly_score")


@query("decision_totals", "A12", f"""WITH {AUDIT_CTE}
SELECT decision, count(*) AS total FROM audit GROUP BY decision""")
def decision_totals(spark, sf_dir):
    return metrics.decision_totals(audit_events(spark, sf_dir))


def _lat_seconds(spark, sf_dir):
    return audit_events(spark, sf_dir).select(
        "event_id", "timestamp_ns", F.col("resource_hash").alias("event_type"),
        (F.col("latency_ms") / 1000.0).alias("latency_s"), "user_did", "latency_ms")


_HIST_CTE = f"""{AUDIT_CTE},
lt AS (SELECT resource_hash AS event_type, latency_ms / 1000.0 AS latency_s FROM audit),
h AS (SELECT event_type, le, le_label, cum_count, sum, count FROM (
  SELECT event_type, sum(latency_s) AS sum, count(latency_s) AS count,
         count(*) FILTER (WHERE latency_s <= 0.01) AS b0, count(*) FILTER (WHERE latency_s <= 0.05) AS b1,
         count(*) FILTER (WHERE latency_s <= 0.1) AS b2, count(*) FILTER (WHERE latency_s <= 0.5) AS b3,
         count(*) FILTER (WHERE latency_s <= 1.0) AS b4, count(latency_s) AS b5
  FROM lt GROUP BY event_type) x,
  LATERAL (VALUES (0.01::DOUBLE, '0.01', b0), (0.05::DOUBLE, '0.05', b1), (0.1::DOUBLE, '0.1', b2),
                  (0.5::DOUBLE, '0.5', b3), (1.0::DOUBLE, '1.0', b4), ('inf'::DOUBLE, '+Inf', b5)) v(le, le_label, cum_count))"""


@query("latency_histogram", "A13", f"""WITH {_HIST_CTE}
SELECT event_type, le_label, cum_count, round(sum, {R}) AS sum, count FROM h""")
def latency_histogram(spark, sf_dir):
    h = metrics.latency_histogram(_lat_seconds(spark, sf_dir), "latency_s", by=("event_type",))
    return rnd(h.drop("le"), "sum")


def _hq_sql(q: float) -> str:
    return f"""WITH {_HIST_CTE},
x AS (SELECT *, lag(le) OVER w AS prev_le, coalesce(lag(cum_count) OVER w, 0) AS prev_cum,
             max(cum_count) OVER (PARTITION BY event_type) AS total
      FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le)),
f AS (SELECT event_type, arg_min(struct_pack(le, prev_le, prev_cum, cum_count, total), le) AS b
      FROM x WHERE cum_count >= {q} * total AND total > 0 GROUP BY event_type)
SELECT event_type, round(CASE WHEN b.le = 'inf'::DOUBLE THEN b.prev_le
  ELSE coalesce(b.prev_le, 0.0) + (b.le - coalesce(b.prev_le, 0.0)) *
       coalesce(({q} * b.total - b.prev_cum) / nullif(b.cum_count - b.prev_cum, 0), 0.0) END, {R}) AS quantile
FROM f"""


def _hq(q):
    def build(spark, sf_dir):
        h = metrics.latency_histogram(_lat_seconds(spark, sf_dir), "latency_s", by=("event_type",))
        return rnd(metrics.histogram_quantile(h, q, by=("event_type",)), "quantile")
    return build


query("histogram_quantile_p50", "A14", _hq_sql(0.5))(_hq(0.5))
query("histogram_quantile_p99", "A14", _hq_sql(0.99))(_hq(0.99))


@query("counter_increase", "A15", f"""WITH {AUDIT_CTE},
s AS (SELECT user_did, timestamp_ns, event_id, risk_score * 100 AS v FROM audit
      WHERE timestamp_ns >= {AS_OF_NS - 3 * 86400 * NS} AND timestamp_ns <= {AS_OF_NS}),
d AS (SELECT user_did, v, lag(v) OVER (PARTITION BY user_did ORDER BY timestamp_ns, event_id) AS p FROM s)
SELECT user_did, round(coalesce(sum(CASE WHEN p IS NULL THEN NULL WHEN v < p THEN v ELSE v - p END), 0.0), {R}) AS increase,
       round(coalesce(sum(CASE WHEN p IS NULL THEN NULL WHEN v < p THEN v ELSE v - p END), 0.0) / {3 * 86400}.0, {R}) AS rate
FROM d GROUP BY user_did""")
def counter_increase(spark, sf_dir):
    a = audit_events(spark, sf_dir).select("user_did", "timestamp_ns", "event_id",
                                            (F.col("risk_score") * 100).alias("v"))
    out = metrics.counter_increase(a, AS_OF_NS, 3 * 86400, series=("user_did",), value="v")
    return rnd(out, "increase", "rate")


@query("coverage", "A16 F5", f"""WITH {AUDIT_CTE},
g AS (SELECT count(*) AS total,
             count(*) FILTER (WHERE timestamp_ns >= {AS_OF_NS - 600 * NS}) AS recent_10m,
             count(*) FILTER (WHERE timestamp_ns >= {AS_OF_NS - 30 * NS}) AS recent_30s FROM audit)
SELECT total, recent_10m, recent_30s, 3 AS expected, round(recent_10m / 3.0 * 100, 1) AS coverage_pct,
       CASE WHEN recent_10m / 3.0 * 100 >= 95 THEN 'PASS' WHEN recent_10m / 3.0 * 100 >= 70 THEN 'WARN'
            ELSE 'FAIL' END AS verdict FROM g""")
def coverage(spark, sf_dir):
    return metrics.coverage(audit_events(spark, sf_dir), AS_OF_NS, expected=3)


@query("latency_summary", "A17 W6", f"""WITH {AUDIT_CTE},
s AS (SELECT resource_hash AS event_type, latency_ms,
             row_number() OVER (PARTITION BY resource_hash ORDER BY latency_ms) - 1 AS i,
             count(*) OVER (PARTITION BY resource_hash) AS n FROM audit)
SELECT event_type, max(n) AS n, round(avg(latency_ms), 2) AS lat_avg,
       round(max(CASE WHEN i = floor(n * 0.95) THEN latency_ms END), 2) AS lat_p95,
       round(max(CASE WHEN i = floor(n * 0.99) THEN latency_ms END), 2) AS lat_p99
FROM s GROUP BY event_type""")
def latency_summary(spark, sf_dir):
    a = _lat_seconds(spark, sf_dir)
    return metrics.latency_summary(a, "latency_ms", by=("event_type",))


_TP_START = AS_OF_NS - 30 * 86400 * NS


def _throughput(spark, sf_dir):
    a = audit_events(spark, sf_dir).select(
        "timestamp_ns", (F.col("decision") == "DENY").alias("is_error"),
        (F.col("latency_ms") * 1000).cast("long").alias("latency_us"))
    return metrics.throughput_report(a, _TP_START, 3600, 30 * 24, target_rate=20)


_TP_CTE = f"""{AUDIT_CTE},
e AS (SELECT (timestamp_ns - {_TP_START}) // {3600 * NS} AS t, decision = 'DENY' AS is_error,
             CAST(trunc(latency_ms * 1000) AS BIGINT) AS latency_us FROM audit)"""


@query("throughput_report", "A18", f"""WITH {_TP_CTE},
p AS (SELECT t, count(*) AS rate, count(*) FILTER (WHERE is_error) AS er, sum(latency_us) AS lat,
             count(latency_us) AS ns FROM e GROUP BY t)
SELECT t, sum(rate) OVER w AS total, rate, sum(er) OVER w AS errors,
       CAST(trunc(sum(lat) OVER w / sum(ns) OVER w) AS BIGINT) AS avg_lat_us
FROM p WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def throughput_report(spark, sf_dir):
    return _throughput(spark, sf_dir)[0]


@query("throughput_verdict", "A18", f"""WITH {_TP_CTE},
f AS (SELECT count(*) AS total_sent, count(*) FILTER (WHERE is_error) AS total_errors FROM e)
SELECT total_sent, total_errors, total_sent // 720 AS real_rate,
       CASE WHEN total_errors = 0 AND total_sent // 720 >= 16 THEN 'PASS'
            WHEN total_errors = 0 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM f""")
def throughput_verdict(spark, sf_dir):
    return _throughput(spark, sf_dir)[1]


@query("gauge_rollup", "A19", f"""WITH {AUDIT_CTE},
l AS (SELECT resource_hash AS event_type, user_did, arg_max(latency_ms - 10, (timestamp_ns, latency_ms - 10)) AS v
      FROM audit GROUP BY ALL)
SELECT event_type, round(sum(v), {R}) AS gauge_sum, count(*) FILTER (WHERE v > 0) AS series_up,
       count(*) AS series FROM l GROUP BY event_type""")
def gauge_rollup(spark, sf_dir):
    a = audit_events(spark, sf_dir).select(F.col("resource_hash").alias("event_type"), "user_did",
                                            "timestamp_ns", (F.col("latency_ms") - 10).alias("value"))
    return rnd(metrics.gauge_rollup(a, series="user_did", group=("event_type",)), "gauge_sum")


_PREV_SQL = f"""{AUDIT_CTE},
c AS (SELECT *, {COORDS_SQL} FROM audit),
p AS (SELECT event_id, user_did, timestamp_ns, lat, lon,
             lag(timestamp_ns) OVER w AS pts, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon
      FROM c WINDOW w AS (PARTITION BY user_did ORDER BY timestamp_ns, event_id)),
q AS (SELECT event_id, user_did, (timestamp_ns - pts) / 60000000000.0 AS time_delta_mins,
             2 * 6371.0 * asin(sqrt(pow(sin((radians(lat) - radians(plat)) / 2), 2)
               + cos(radians(plat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(plon)) / 2), 2))) AS distance_km
      FROM p)"""


@query("previous_login", "W2", f"""WITH {_PREV_SQL}
SELECT event_id, user_did, round(time_delta_mins, {R}) AS time_delta_mins, round(distance_km, 3) AS distance_km FROM q""")
def previous_login(spark, sf_dir):
    a = audit_with_coords(spark, sf_dir).select("event_id", "user_did", "timestamp_ns", "lat", "lon")
    x = travel.with_previous_login(a)
    return x.select("event_id", "user_did", F.round("time_delta_mins", R).alias("time_delta_mins"),
                    F.round("distance_km", 3).alias("distance_km"))


@query("impossible_travel", "W3", f"""WITH {_PREV_SQL}
SELECT event_id, user_did, round(time_delta_mins, {R}) AS time_delta_mins, round(distance_km, 3) AS distance_km
FROM q WHERE distance_km > 1000 AND time_delta_mins < 10""")
def impossible_travel(spark, sf_dir):
    a = audit_with_coords(spark, sf_dir).select("event_id", "user_did", "timestamp_ns", "lat", "lon")
    x = travel.impossible_travel(travel.with_previous_login(a))
    return x.select("event_id", "user_did", F.round("time_delta_mins", R).alias("time_delta_mins"),
                    F.round("distance_km", 3).alias("distance_km"))


@query("newest_events_top100", "W4", f"""WITH {AUDIT_CTE}
SELECT event_id, user_did, timestamp_ns FROM audit ORDER BY timestamp_ns DESC, event_id DESC LIMIT 100""")
def newest_events_top100(spark, sf_dir):
    a = audit_events(spark, sf_dir)
    return (a.orderBy(F.col("timestamp_ns").desc(), F.col("event_id").desc()).limit(100)
             .select("event_id", "user_did", "timestamp_ns"))


@query("half_space_scores", "M4 P9")
def half_space_scores(spark, sf_dir):
    from ..operators.halfspace import half_space_scores as hst
    a = audit_events(spark, sf_dir)
    f = a.select("event_id", "timestamp_ns", F.col("latency_ms").alias("latency"), "risk_score",
                 ev.ctx_number("context", "env", "$.distance_km").alias("distance"))
    return hst(f, window_seconds=86400).select("event_id", F.round("hst_score", R).alias("hst_score"))
