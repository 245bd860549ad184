"""Minute rollups as mergeable state, their merge, and the 3-sigma scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.events import bucket_ns, ctx_number, ns_to_ts, yyyymm
from ..functions.stats import exact_quantile, merge_moments, moments
from ..model import DISTANCE_OUTLIER_SCORE, OUTLIER_THRESHOLD, SIGMA

GRAINS = {"minute": 60, "hour": 3600, "day": 86400}


def distance_col(df: DataFrame):
    """Distance in km read as a number (T3) from the context map, or a flat column."""
    return F.col("distance_km") if "distance_km" in df.columns else ctx_number("context", "env", "$.distance_km")


def rollup_latency_1m(df: DataFrame, grain_seconds: int = 60) -> DataFrame:
    """Per (user, minute) latency state n/sum/m2 and a KLL sketch of distance (p99 later)."""
    b = df.withColumn("window_start_ns", bucket_ns("timestamp_ns", grain_seconds))
    return (b.groupBy("user_did", "window_start_ns")
             .agg(*moments(F.col("latency_ms")),
                  F.kll_sketch_agg_double(distance_col(df)).alias("distance_sketch"))
             .withColumn("yyyymm", yyyymm(ns_to_ts("window_start_ns"))))


def merge_latency(rollup: DataFrame, keys=("user_did",), q: float = 0.99) -> DataFrame:
    """Merge rollup rows to mean, sample variance and the sketch quantile of distance."""
    keys = list(keys)
    m = merge_moments(rollup, keys)
    sk = (rollup.groupBy(*keys).agg(F.kll_merge_agg_double("distance_sketch").alias("_sk"))
                .select(*keys, F.kll_sketch_get_quantile_double("_sk", F.lit(q)).alias("p99")))
    return m.join(sk, keys, "inner")


def p99_distance(df: DataFrame, keys=("user_did",), q: float = 0.99) -> DataFrame:
    """Exact interpolated p99 of distance per user (distributed histogram, no group buffer)."""
    d = df.select(*keys, distance_col(df).alias("distance_km"))
    return exact_quantile(d, list(keys), "distance_km", q, "p99")


def rollup_logins_1m(df: DataFrame, grain_seconds: int = 60) -> DataFrame:
    """A10: per (user, minute) ALLOW / DENY / CHALLENGE counts."""
    b = df.withColumn("window_start_ns", bucket_ns("timestamp_ns", grain_seconds))
    d = F.col("decision")
    return (b.groupBy("user_did", "window_start_ns").agg(
        F.count(F.when(d == "ALLOW", 1)).alias("allow_count"),
        F.count(F.when(d == "DENY", 1)).alias("deny_count"),
        F.count(F.when(d == "CHALLENGE", 1)).alias("challenge_count"))
        .withColumn("yyyymm", yyyymm(ns_to_ts("window_start_ns"))))


def merge_logins(rollup: DataFrame, grain: str = "hour") -> DataFrame:
    """Merge login rollups to hour, day or all (one row per user)."""
    keys = ["user_did"]
    r = rollup
    if grain != "all":
        r = r.withColumn("window_start_ns", bucket_ns("window_start_ns", GRAINS[grain]))
        keys.append("window_start_ns")
    return r.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("allow_count", "deny_count", "challenge_count")])


def latest_event(df: DataFrame, key: str = "user_did") -> DataFrame:
    """Newest row per key by (timestamp_ns, event_id).  max_by is partially
    aggregated map-side, so a hot key never lands whole in one task."""
    cols = [c for c in df.columns if c != key]
    order = F.struct("timestamp_ns", *(["event_id"] if "event_id" in df.columns else []))
    return (df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_r"))
              .select(key, "_r.*"))


def latest_outliers(events: DataFrame, baseline: DataFrame) -> DataFrame:
    """M3: latest event per user against merged baseline (mean, var_samp, p99).

    latency outlier: sd > 0 and x > mean + 3 sd; distance outlier: p99 > 0 and d > p99;
    score = 1 - 1/(1+z) for z > 0 else 0, forced to 0.99 on a distance outlier.  The
    returned threshold 0.7 is not used by is_outlier (T12).  Users without a baseline
    row read mean = sd = p99 = 0, as in the reference.
    """
    last = latest_event(events.select("user_did", "timestamp_ns",
                                      *(["event_id"] if "event_id" in events.columns else []),
                                      "latency_ms", distance_col(events).alias("distance_km")))
    j = last.join(baseline.select("user_did", "mean", "var_samp", "p99"), "user_did", "left")
    mean = F.coalesce(F.col("mean"), F.lit(0.0))
    var = F.coalesce(F.col("var_samp"), F.lit(0.0))
    sd = F.when(var > 0, F.sqrt(var)).otherwise(F.lit(0.0))
    p99 = F.coalesce(F.col("p99"), F.lit(0.0))
    x, d = F.col("latency_ms"), F.col("distance_km")
    lat_out = (sd > 0) & (x > mean + SIGMA * sd)
    dist_out = (p99 > 0) & (d > p99)
    z = F.when(sd > 0, (x - mean) / sd).otherwise(F.lit(0.0))
    score = F.when(dist_out, F.lit(DISTANCE_OUTLIER_SCORE)).when(z > 0, 1.0 - 1.0 / (1.0 + z)).otherwise(F.lit(0.0))
    return j.select("user_did", x.alias("latency_ms"), d.alias("distance_km"),
                    mean.alias("baseline_mean"), sd.alias("std_dev"), p99.alias("p99"),
                    z.alias("z_score"), score.alias("anomaly_score"),
                    (lat_out | dist_out).alias("is_outlier"),
                    F.lit(OUTLIER_THRESHOLD).alias("threshold"))


def baseline_exact(df: DataFrame) -> DataFrame:
    """Exact twin of merge_latency (oracle path): moments from minute state, exact p99."""
    r = rollup_latency_1m(df).drop("distance_sketch")
    return merge_moments(r, ["user_did"]).join(p99_distance(df), "user_did", "left")
