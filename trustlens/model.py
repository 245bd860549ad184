"""Fixed schemas and constants shared by the operators."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import types as T

NS_PER_SEC = 1_000_000_000
BASELINE_SECONDS = 7 * 86400

# Fixed values that must equal the reference's for the same results:
# z-score threshold 2.5, stddev floor 1e-9 (anomaly endpoint); latency-outlier sigma 3,
# outlier threshold 0.7, forced score 0.99 on a distance outlier (3-sigma endpoint).
Z_THRESHOLD = 2.5
STDDEV_EPSILON = 1e-9
SIGMA = 3.0
OUTLIER_THRESHOLD = 0.7
DISTANCE_OUTLIER_SCORE = 0.99
METRICS = ("avg_latency", "deny_rate", "geo_velocity")
DECISIONS = ("ALLOW", "DENY", "CHALLENGE")

# Audit event as written to the table (one row per access decision).
AUDIT_SCHEMA = T.StructType([
    T.StructField("timestamp_ns", T.LongType(), False),
    T.StructField("session_id", T.StringType(), True),
    T.StructField("user_did", T.StringType(), False),
    T.StructField("resource_hash", T.StringType(), True),
    T.StructField("decision", T.StringType(), False),
    T.StructField("risk_score", T.DoubleType(), True),
    T.StructField("context_snapshot", T.StringType(), True),
    T.StructField("latency_ms", T.DoubleType(), True),
])

# Wire form of an audit event (JSON text under field `data` on the stream).
WIRE_SCHEMA = T.StructType([
    T.StructField("timestamp_ns", T.LongType(), True),
    T.StructField("session_id", T.StringType(), True),
    T.StructField("user_did", T.StringType(), True),
    T.StructField("resource_hash", T.StringType(), True),
    T.StructField("decision", T.StringType(), True),
    T.StructField("risk_score", T.DoubleType(), True),
    T.StructField("context_snapshot", T.StringType(), True),
    T.StructField("latency_ms", T.DoubleType(), True),
])

REQUEST_SCHEMA = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("user_did", T.StringType()),
    T.StructField("device", T.StructType([
        T.StructField("trust_score", T.DoubleType()),
        T.StructField("id", T.StringType())])),
    T.StructField("context", T.StructType([
        T.StructField("distance_km", T.DoubleType()),
        T.StructField("time_delta_mins", T.DoubleType()),
        T.StructField("anomaly_score", T.DoubleType())])),
    T.StructField("resource", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("hash", T.StringType())])),
])

REVOCATION_SCHEMA = T.StructType([
    T.StructField("credential_id", T.StringType(), False),
    T.StructField("issuer_did", T.StringType(), True),
    T.StructField("timestamp", T.LongType(), True),
    T.StructField("reason", T.StringType(), True),
])


def to_ns(as_of) -> int:
    """Driver-side: an explicit ``as_of`` (ns int, datetime or ISO text, UTC) -> epoch ns."""
    if isinstance(as_of, int):
        return as_of
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=timezone.utc)
    return int(as_of.timestamp()) * NS_PER_SEC + as_of.microsecond * 1000
