"""Event-level Column expressions.  All JVM-side, codegen friendly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_SEC = 1_000_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flatten_context(json_col) -> Column:
    """JSON object text -> map<string,string>, one level deep.

    Strings stay as they are; nested values become their JSON text; JSON null becomes
    the text ``null`` (the reference prints it); non-object input -> empty map.
    """
    m = F.from_json(_c(json_col), "map<string,string>")
    m = F.transform_values(m, lambda k, v: F.coalesce(v, F.lit("null")))
    return F.coalesce(m, F.create_map().cast("map<string,string>"))


def ctx(map_col, key: str) -> Column:
    """Context lookup, a missing key reads as ''."""
    return F.coalesce(F.try_element_at(_c(map_col), F.lit(key)), F.lit(""))


def ctx_number(map_col, key: str, path: str) -> Column:
    """Number inside nested JSON text held at ``key``; missing or bad -> 0.0."""
    raw = F.get_json_object(F.try_element_at(_c(map_col), F.lit(key)), path)
    return F.coalesce(raw.try_cast("double"), F.lit(0.0))


def ns_to_ts(ns_col) -> Column:
    """Epoch nanoseconds -> timestamp (microsecond precision)."""
    return F.timestamp_micros(F.floor(_c(ns_col) / 1000).cast("long"))


def ts_to_ns(ts_col) -> Column:
    return F.unix_micros(_c(ts_col).cast("timestamp")) * F.lit(1000)


def bucket_ns(ns_col, seconds: int) -> Column:
    """P5: start of the ``seconds``-wide bucket, as epoch ns (integer arithmetic)."""
    w = seconds * NS_PER_SEC
    return F.floor(_c(ns_col) / w).cast("long") * F.lit(w)


def minute_ns(ns_col) -> Column:
    return bucket_ns(ns_col, 60)


def yyyymm(ts_col) -> Column:
    """P5: month number, the partition key of the audit table."""
    return (F.year(_c(ts_col)) * 100 + F.month(_c(ts_col))).cast("int")


def hour_of_day(ts_col) -> Column:
    """P6."""
    return F.hour(_c(ts_col))


def decision_code(col) -> Column:
    """ALLOW 0, DENY 1, CHALLENGE 2, anything else 0."""
    c = _c(col)
    return (F.when(c == "DENY", 1).when(c == "CHALLENGE", 2).otherwise(0)).cast("int")


def geo_speed(dist, mins) -> Column:
    """P10: km/min; 9999 for an instant jump with distance; else 0."""
    d, m = _c(dist), _c(mins)
    return (F.when(m > 0, d / m).when(d > 0, F.lit(9999.0)).otherwise(F.lit(0.0))).cast("double")


def risk_score(trust, dist, mins, anomaly) -> Column:
    """clamp(1 - trust + 0.5*[speed > 15] + 0.3*anomaly, 0, 1); null anomaly adds 0."""
    r = (F.lit(1.0) - _c(trust)
         + F.when(geo_speed(dist, mins) > 15.0, F.lit(0.5)).otherwise(F.lit(0.0))
         + F.coalesce(_c(anomaly) * 0.3, F.lit(0.0)))
    return F.least(F.greatest(r, F.lit(0.0)), F.lit(1.0))


def severity(score) -> Column:
    """P12 band: green <= 0.5 < amber <= 0.8 < red."""
    s = _c(score)
    return F.when(s <= 0.5, "green").when(s <= 0.8, "amber").otherwise("red")


def severity_pct(score) -> Column:
    """P12 percent, JavaScript Math.round = floor(x + 0.5)."""
    return F.floor(_c(score) * 100 + 0.5).cast("long")


def feature_columns() -> list[Column]:
    """Training feature row (latency, risk, distance, hour, decision code, device trust)."""
    return [F.col("latency_ms"), F.col("risk_score"),
            ctx_number("context", "env", "$.distance_km").alias("distance_km"),
            hour_of_day(ns_to_ts("timestamp_ns")).alias("hour_of_day"),
            decision_code("decision").alias("decision"),
            ctx_number("context", "device", "$.trust_score").alias("device_trust_score")]


def feature_rows(df):
    return df.select(*feature_columns())


def stream_columns() -> list[Column]:
    """Streaming feature vector, each defaulting to 0.0."""
    return [F.coalesce(F.col("latency_ms").cast("double"), F.lit(0.0)).alias("latency"),
            F.coalesce(F.col("risk_score").cast("double"), F.lit(0.0)).alias("risk_score"),
            ctx_number("context", "env", "$.distance_km").alias("distance")]


def stream_features(df):
    return df.select(*stream_columns())
