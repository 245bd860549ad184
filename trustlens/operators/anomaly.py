"""Per-user anomaly scoring over the audit table.

One job scores every user at once.  The plan is a single partial+final hash
aggregate keyed by ``user_did`` with conditional aggregates for the window and the
7-day baseline (no self-join of window vs baseline), plus - for the two-level
metrics - a (user, 5-minute bucket) aggregate whose result is joined back on the
same ``user_did`` hash partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Column
from pyspark.sql import functions as F

from ..functions.events import bucket_ns, ctx
from ..model import (BASELINE_SECONDS, METRICS, NS_PER_SEC, STDDEV_EPSILON,
                     Z_THRESHOLD, to_ns)

BUCKET_SECONDS = 300


def check_params(user_did: str | None, window_seconds: int, metric: str) -> None:
    """driver-side parameter check for one score request."""
    if user_did is not None and not str(user_did).strip():
        raise ValueError("user must not be blank")
    if not (1 <= int(window_seconds) <= 86400):
        raise ValueError("window_seconds must be in [1, 86400]")
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; use one of {METRICS}")


def check_param_rows(df: DataFrame, user="user_did", window="window_seconds",
                     metric="metric") -> DataFrame:
    """F4 for a table of score requests: adds ``error`` (NULL when the row is valid)."""
    u, w, m = F.col(user), F.col(window), F.col(metric)
    err = (F.when(u.isNull() | (F.trim(u) == ""), F.lit("blank user"))
           .when(w.isNull() | (w < 1) | (w > 86400), F.lit("window out of range"))
           .when(~m.isin(*METRICS) | m.isNull(), F.lit("unknown metric")))
    return df.withColumn("error", err)


def for_user(df: DataFrame, did: str) -> DataFrame:
    """F1."""
    return df.filter(F.col("user_did") == F.lit(did))


def trailing(df: DataFrame, as_of, seconds: int, ts_col: str = "timestamp_ns") -> DataFrame:
    """rows with event time >= as_of - seconds (as in the reference, no upper bound)."""
    lo = to_ns(as_of) - int(seconds) * NS_PER_SEC
    return df.filter(F.col(ts_col) >= F.lit(lo))


def _geo(df: DataFrame) -> Column:
    # T5: a missing geo key reads as '' so it is counted once as a distinct value.
    return ctx("context", "geo") if "geo" not in df.columns else F.coalesce(F.col("geo"), F.lit(""))


def _user_stats(df: DataFrame, as_of, window_seconds: int, metrics, users: DataFrame | None,
                exclude_window: bool) -> DataFrame:
    """Wide per-user table: event_count, raw_<m>, mean_<m>, sd_<m> for the asked metrics."""
    as_ns = to_ns(as_of)
    win_lo = as_ns - int(window_seconds) * NS_PER_SEC
    base_lo = as_ns - BASELINE_SECONDS * NS_PER_SEC
    ts = F.col("timestamp_ns")
    in_win = ts >= F.lit(win_lo)
    in_base = ts >= F.lit(base_lo)
    if exclude_window:
        in_base = in_base & ~in_win
    # With an explicit user list the scan is pruned to the baseline range; without one the
    # user universe is every user in the table, found in the same pass (no distinct + join).
    src = df.filter(ts >= F.lit(min(win_lo, base_lo))) if users is not None else df
    geo = _geo(src)
    is_deny = (F.col("decision") == "DENY").cast("double")
    aggs = [F.count(F.when(in_win, F.lit(1))).alias("event_count")]
    if "avg_latency" in metrics:
        aggs += [F.avg(F.when(in_win, F.col("latency_ms"))).alias("raw_avg_latency"),
                 F.avg(F.when(in_base, F.col("latency_ms"))).alias("mean_avg_latency"),
                 F.stddev_pop(F.when(in_base, F.col("latency_ms"))).alias("sd_avg_latency")]
    if "deny_rate" in metrics:
        aggs.append(F.avg(F.when(in_win, is_deny)).alias("raw_deny_rate"))
    if "geo_velocity" in metrics:
        aggs.append(F.try_divide(F.count_distinct(F.when(in_win, geo)), F.count(F.when(in_win, F.lit(1))))
                    .alias("raw_geo_velocity"))
    out = src.groupBy("user_did").agg(*aggs)
    two_level = [m for m in ("deny_rate", "geo_velocity") if m in metrics]
    if two_level:
        b = src.filter(in_base).withColumn("bucket_ns", bucket_ns("timestamp_ns", BUCKET_SECONDS))
        lvl1 = b.groupBy("user_did", "bucket_ns").agg(
            F.avg(is_deny).alias("deny_rate"),
            (F.count_distinct(geo) / F.count(F.lit(1))).alias("geo_velocity"))
        lvl2 = lvl1.groupBy("user_did").agg(*[
            e for m in two_level
            for e in (F.avg(m).alias(f"mean_{m}"), F.stddev_pop(m).alias(f"sd_{m}"))])
        out = out.join(lvl2, "user_did", "left")
    if users is not None:
        out = users.select("user_did").join(out, "user_did", "left")
    return out


def _score_cols(metric: str, window_seconds: int) -> list[Column]:
    """M1 arithmetic: z = (raw-mean)/max(sd,eps); score = min(|z|/2.5, 1); anomaly |z| > 2.5."""
    raw = F.coalesce(F.col(f"raw_{metric}"), F.lit(0.0))
    mean = F.coalesce(F.col(f"mean_{metric}"), F.lit(0.0))
    sd = F.coalesce(F.col(f"sd_{metric}"), F.lit(0.0))
    z = (raw - mean) / F.greatest(sd, F.lit(STDDEV_EPSILON))
    return [
        F.col("user_did"),
        F.lit(int(window_seconds)).alias("window_seconds"),
        F.lit(metric).alias("metric"),
        F.coalesce(F.col("event_count"), F.lit(0)).cast("long").alias("event_count"),
        raw.alias("raw_value"), mean.alias("mean_baseline"), sd.alias("stddev_baseline"),
        z.alias("z_score"),
        F.least(F.abs(z) / Z_THRESHOLD, F.lit(1.0)).alias("anomaly_score"),
        (F.abs(z) > Z_THRESHOLD).alias("is_anomaly"),
        F.lit(Z_THRESHOLD).alias("threshold")]


def anomaly_scores(df: DataFrame, as_of, window_seconds: int = 300, metric: str = "avg_latency",
                   users: DataFrame | None = None, exclude_window: bool = False) -> DataFrame:
    """M1: z-score per user for one metric.  ``df`` is the audit table."""
    check_params(None, window_seconds, metric)
    stats = _user_stats(df, as_of, window_seconds, (metric,), users, exclude_window)
    return stats.select(*_score_cols(metric, window_seconds))


def anomaly_matrix(df: DataFrame, as_of, window_seconds: int = 300,
                   users: DataFrame | None = None, exclude_window: bool = False) -> DataFrame:
    """M2: all three metrics for all users, long form.  One aggregation, then a
    row-local explode (no union, no second scan)."""
    check_params(None, window_seconds, "avg_latency")
    stats = _user_stats(df, as_of, window_seconds, METRICS, users, exclude_window)
    rows = F.explode(F.array(*[F.struct(*_score_cols(m, window_seconds)) for m in METRICS]))
    return stats.select(rows.alias("r")).select("r.*")
