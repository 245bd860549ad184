"""Access decisions over a request table.

The product policy becomes five boolean Columns; a comparison with a missing input
is false (coalesce to false), every flag defaults to false.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Column
from pyspark.sql import functions as F

from ..functions.events import risk_score, ts_to_ns
from .health import in_periods

FLAGS = ("allow", "requires_2fa", "requires_biometric", "block", "alert")

# Fixed values of the product policy: 2FA below trust 0.7; block and alert beyond
# 1000 km in under 10 minutes; biometric for the resource named "Admin".
TRUST_2FA = 0.7
BLOCK_KM = 1000.0
BLOCK_MINS = 10.0
BIOMETRIC_RESOURCE = "Admin"


def _f(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def policy_flags(trust: Column, dist: Column, mins: Column, resource: Column) -> dict[str, Column]:
    block = _f((dist > BLOCK_KM) & (mins < BLOCK_MINS))
    return {
        "requires_2fa": _f(trust < TRUST_2FA),
        "block": block,
        "alert": _f((dist > BLOCK_KM) & (mins < BLOCK_MINS)),
        "requires_biometric": _f(resource == F.lit(BIOMETRIC_RESOURCE)),
        "allow": ~block,
    }


def decide(requests: DataFrame) -> DataFrame:
    """Five decision flags from the nested request columns."""
    flags = policy_flags(F.col("device.trust_score"), F.col("context.distance_km"),
                         F.col("context.time_delta_mins"), F.col("resource.name"))
    return requests.withColumns({k: flags[k] for k in FLAGS})


def audit_label_col() -> Column:
    """Block -> DENY; 2FA or biometric -> CHALLENGE; allow -> ALLOW; else DENY."""
    return (F.when(F.col("block"), "DENY")
             .when(F.col("requires_2fa") | F.col("requires_biometric"), "CHALLENGE")
             .when(F.col("allow"), "ALLOW").otherwise("DENY"))


def metric_label_col() -> Column:
    """D3: not allow -> DENY; 2FA -> CHALLENGE; else ALLOW (biometric ignored, T7)."""
    return (F.when(~F.col("allow"), "DENY").when(F.col("requires_2fa"), "CHALLENGE").otherwise("ALLOW"))


def audit_label(df: DataFrame) -> DataFrame:
    return df.withColumn("audit_label", audit_label_col())


def metric_label(df: DataFrame) -> DataFrame:
    return df.withColumn("metric_label", metric_label_col())


def request_risk(df: DataFrame) -> Column:
    return risk_score(F.col("device.trust_score"), F.col("context.distance_km"),
                      F.col("context.time_delta_mins"), F.col("context.anomaly_score"))


def to_audit_events(requests: DataFrame, ts: str = "ts") -> DataFrame:
    """Request table -> audit-event table (label, risk, context snapshot JSON)."""
    d = decide(requests)
    snapshot = F.to_json(F.struct(F.col("context").alias("env"),
                                  F.struct(F.col("device.id").alias("id")).alias("device")),
                         {"ignoreNullFields": "false"})
    return d.select(
        ts_to_ns(F.col(ts)).alias("timestamp_ns"),
        "session_id", "user_did",
        F.col("resource.hash").alias("resource_hash"),
        audit_label_col().alias("decision"),
        request_risk(d).alias("risk_score"),
        snapshot.alias("context_snapshot"),
        # engine latency is a property of the serving process, not of the data
        F.lit(0.0).alias("latency_ms"),
    )


def fail_closed(df: DataFrame, bad: Column) -> DataFrame:
    """Rows that cannot be evaluated or fall in a panic period: allow false, every other
    flag true, risk 1.0, latency 0, tagged ``denied_by_panic_mode`` in the context."""
    out = df.withColumn("_bad", _f(bad))
    for k in FLAGS:
        val = F.lit(False) if k == "allow" else F.lit(True)
        if k in df.columns:
            out = out.withColumn(k, F.when(F.col("_bad"), val).otherwise(F.col(k)))
        else:
            out = out.withColumn(k, F.when(F.col("_bad"), val))
    if "risk_score" in df.columns:
        out = out.withColumn("risk_score", F.when(F.col("_bad"), F.lit(1.0)).otherwise(F.col("risk_score")))
    if "latency_ms" in df.columns:
        out = out.withColumn("latency_ms", F.when(F.col("_bad"), F.lit(0.0)).otherwise(F.col("latency_ms")))
    if "context_snapshot" in df.columns:
        c = F.trim(F.coalesce(F.col("context_snapshot"), F.lit("{}")))
        head = F.rtrim(F.expr("substring(trim(coalesce(context_snapshot, '{}')), 1, "
                              "length(trim(coalesce(context_snapshot, '{}'))) - 1)"))
        tagged = F.concat(head, F.when(c.rlike(r"^\{\s*\}$"), F.lit("")).otherwise(F.lit(",")),
                          F.lit('"denied_by_panic_mode":"true"}'))
        out = out.withColumn("context_snapshot", F.when(F.col("_bad"), tagged).otherwise(F.col("context_snapshot")))
    return out.withColumnRenamed("_bad", "denied_by_panic_mode")


def deny_in_panic(decided: DataFrame, periods: DataFrame, node: str = "node", ts: str = "timestamp_ns") -> DataFrame:
    """Decided requests, failed closed where the node that serves them was in PANIC at the time
    (``periods`` as of ``health.panic_periods``)."""
    flagged = in_periods(decided, periods, "_in_panic", node, ts)
    return fail_closed(flagged, F.col("_in_panic")).drop("_in_panic")


def decision_reason_col() -> Column:
    return (F.when(F.col("block"), "impossible_travel")
             .when(F.col("requires_2fa") & F.col("requires_biometric"), "low_trust+admin")
             .when(F.col("requires_2fa"), "low_trust")
             .when(F.col("requires_biometric"), "admin_resource").otherwise("none"))


def decision_report(df: DataFrame) -> DataFrame:
    """Counts by label, reason and resource."""
    d = df if "block" in df.columns else decide(df)
    return (d.groupBy(audit_label_col().alias("label"), decision_reason_col().alias("reason"),
                      F.col("resource.name").alias("resource"))
             .agg(F.count(F.lit(1)).alias("requests")))


def policy_diff(df: DataFrame, a, b, label: str = "label") -> DataFrame:
    """Apply two rule sets (callables DataFrame -> DataFrame adding ``label``) to the
    same history in one pass (no self-join); keep rows whose label changes (null-safe)."""
    x = a(df).withColumnRenamed(label, "label_a")
    x = b(x).withColumnRenamed(label, "label_b")
    return x.filter(~F.col("label_a").eqNullSafe(F.col("label_b")))
