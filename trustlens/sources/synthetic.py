"""Synthetic event tables (S13, S14), generated with spark.range (distributed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the load generator: geo codes by seq % 5, three decisions by seq % 3.
BENCH_GEOS = ("US", "EU", "ASIA", "LATAM", "AFRICA")
BENCH_DECISIONS = ("ALLOW", "DENY", "CHALLENGE")


def synthetic_events(spark: SparkSession, n: int, start_ns: int = 1_700_000_000 * 10**9) -> DataFrame:
    """Deterministic in the sequence number: decision = seq%3, geo = seq%5,
    risk = (seq%100)/100, latency = (seq%50)*0.1+0.05, user = seq%1000."""
    s = F.col("id")
    ctx = F.to_json(F.struct(F.element_at(F.array(*[F.lit(g) for g in BENCH_GEOS]), (s % 5 + 1).cast("int")).alias("geo")))
    return spark.range(n).select(
        (F.lit(start_ns) + s * 1_000_000).alias("timestamp_ns"),
        F.concat(F.lit("sess_"), s.cast("string")).alias("session_id"),
        F.concat(F.lit("user_"), (s % 1000).cast("string")).alias("user_did"),
        F.lit("bench").alias("resource_hash"),
        F.element_at(F.array(*[F.lit(d) for d in BENCH_DECISIONS]), (s % 3 + 1).cast("int")).alias("decision"),
        ((s % 100) / 100.0).alias("risk_score"),
        ctx.alias("context_snapshot"),
        ((s % 50) * 0.1 + 0.05).alias("latency_ms"))


def synthetic_outlier(spark: SparkSession, n: int = 100_000, start_ns: int = 1_700_000_000 * 10**9,
                      outlier_user: str = "user_test_42") -> DataFrame:
    """N baseline events over 100 users (latency 40-59 ms, distance 0-45 km, both
    from the sequence number) plus one outlier event (250 ms, 500 km)."""
    s = F.col("id")
    base = spark.range(n).select(
        (F.lit(start_ns) + s * 1_000_000_000).alias("timestamp_ns"),
        F.concat(F.lit("sess_"), s.cast("string")).alias("session_id"),
        F.concat(F.lit("user_test_"), (s % 100).cast("string")).alias("user_did"),
        (40.0 + (s * 7) % 20).alias("latency_ms"),
        ((s * 13) % 46).cast("double").alias("distance_km"))
    out = spark.range(1).select(
        F.lit(start_ns + n * 1_000_000_000).alias("timestamp_ns"), F.lit("sess_outlier").alias("session_id"),
        F.lit(outlier_user).alias("user_did"), F.lit(250.0).alias("latency_ms"), F.lit(500.0).alias("distance_km"))
    df = base.unionByName(out)
    return df.select("timestamp_ns", "session_id", "user_did", F.lit("h").alias("resource_hash"),
                     F.lit("ALLOW").alias("decision"), F.lit(0.1).alias("risk_score"),
                     F.to_json(F.struct(F.struct(F.col("distance_km").alias("distance_km")).alias("env")))
                     .alias("context_snapshot"), "latency_ms", "distance_km")
