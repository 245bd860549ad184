"""Audit-event sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.events import flatten_context, ns_to_ts, yyyymm
from ..model import DECISIONS, WIRE_SCHEMA, to_ns

REQUIRED = ("timestamp_ns", "session_id", "user_did", "decision")


def read_audit_stream(spark: SparkSession, path: str, fmt: str = "text", start: str = "earliest",
                      max_files_per_trigger: int | None = None, kafka_options: dict | None = None,
                      since: str | None = None) -> DataFrame:
    """A stream of envelopes ``{"data": "<event json>"}`` one per line (files), or
    Kafka records whose value is the envelope.  Returns raw text in ``raw``.

    ``start="latest"`` reads only what is new: Kafka's latest offsets, or files written at or
    after ``since`` (a UTC timestamp that the caller keeps over restarts)."""
    if fmt == "kafka":
        opts = dict(kafka_options or {})
        opts.setdefault("startingOffsets", "earliest" if start == "earliest" else "latest")
        r = spark.readStream.format("kafka").options(**opts).load()
        return r.select(F.col("value").cast("string").alias("raw"))
    rs = spark.readStream.format("text")
    if start == "latest" and since is None:
        raise ValueError('start="latest" on files needs since, the time from which files are new')
    if max_files_per_trigger:
        rs = rs.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = rs.load(path)
    if start == "latest":
        lines = lines.filter(F.col("_metadata.file_modification_time") >= F.lit(since).cast("timestamp"))
    return lines.select(F.col("value").alias("raw"))


def trigger_opts(max_rows: int = 1000, interval_ms: int = 500) -> dict:
    """S3: micro-batch by age (processing-time trigger) with a per-trigger size bound
    (``maxOffsetsPerTrigger`` for Kafka, ``maxFilesPerTrigger`` for files)."""
    return {"trigger": {"processingTime": f"{int(interval_ms)} milliseconds"},
            "maxOffsetsPerTrigger": int(max_rows)}


def split_valid(raw: DataFrame, raw_col: str = "raw"):
    """Parse the envelope and the event; rows that cannot be read go to a quarantine
    frame with a reason and the raw text instead of being dropped."""
    env = F.from_json(F.col(raw_col), "data string, _corrupt_record string",
                      {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    x = raw.withColumn("_env", env)
    data = F.col("_env.data")
    wire = T.StructType(WIRE_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType())])
    ev = F.from_json(data, wire,
                     {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    x = x.withColumn("_ev", ev)
    missing = None
    for c in REQUIRED:
        cond = F.col(f"_ev.{c}").isNull()
        missing = F.when(cond, F.lit(f"missing {c}")) if missing is None else missing.when(cond, F.lit(f"missing {c}"))
    reason = (F.when(F.col("_env").isNull() | F.col("_env._corrupt_record").isNotNull(), F.lit("envelope not json"))
               .when(data.isNull(), F.lit("no data field"))
               .when(F.col("_ev").isNull() | F.col("_ev._corrupt_record").isNotNull(), F.lit("event not json"))
               .when(~F.col("_ev.decision").isin(*DECISIONS), F.lit("unknown decision")))
    reason = F.coalesce(reason, missing)
    x = x.withColumn("_reason", reason)
    good = x.filter(F.col("_reason").isNull()).select("_ev.*").drop("_corrupt_record")
    good = good.withColumn("context", flatten_context("context_snapshot")) \
               .withColumn("ts", ns_to_ts("timestamp_ns"))
    bad = x.filter(F.col("_reason").isNotNull()).select(F.col(raw_col).alias("raw"), F.col("_reason").alias("reason"))
    return good, bad


def save_audit(df: DataFrame, path: str, mode: str = "append") -> None:
    """Month-partitioned, sorted by (user, time) inside each file so parquet
    row-group min/max prune user and time filters.  Repartitioning by (yyyymm, user)
    spreads a month over many tasks; a hot user is split by AQE's skew handling only at
    join time, so the write key also includes a time slice."""
    out = df.withColumn("yyyymm", yyyymm(ns_to_ts("timestamp_ns")))
    slice_ = F.floor(F.col("timestamp_ns") / F.lit(3600 * 1_000_000_000))
    (out.repartition("yyyymm", "user_did", slice_)
        .sortWithinPartitions("user_did", "timestamp_ns")
        .write.mode(mode).partitionBy("yyyymm").parquet(path))


def save_rollup(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rollups partitioned by month of the window start."""
    out = df if "yyyymm" in df.columns else df.withColumn("yyyymm", yyyymm(ns_to_ts("window_start_ns")))
    out.sortWithinPartitions("user_did", "window_start_ns").write.mode(mode).partitionBy("yyyymm").parquet(path)


def load_audit(spark: SparkSession, path: str, users=None, since=None) -> DataFrame:
    """Scan with partition pruning (``yyyymm`` derived from ``since``) and pushed
    filters on user and time."""
    df = spark.read.parquet(path)
    if since is not None:
        ns = to_ns(since)
        from datetime import datetime, timezone
        d = datetime.fromtimestamp(ns / 1e9, tz=timezone.utc)
        df = df.filter((F.col("yyyymm") >= d.year * 100 + d.month) & (F.col("timestamp_ns") >= F.lit(ns)))
    if users is not None:
        df = df.filter(F.col("user_did").isin(*users))
    return df


def export_features(df: DataFrame, path: str, limit: int | None = None, order=("timestamp_ns",)) -> None:
    """Feature rows as CSV with a header, all of them or the first ``limit`` (a total order
    makes the cut deterministic; TakeOrderedAndProject keeps only ``limit`` rows per task)."""
    rows = df.orderBy(*order)
    (rows if limit is None else rows.limit(limit)).write.mode("overwrite").option("header", True).csv(path)


def save_json_rows(df: DataFrame, path: str) -> None:
    """One JSON object per line."""
    df.write.mode("overwrite").json(path)


def panic_denials(df: DataFrame) -> DataFrame:
    """Distinct (user, session) among events flagged ``denied_by_panic_mode``, with
    counts per user.  ``df`` is a denial log read with ``spark.read.json``."""
    flag = F.get_json_object(F.col("context_snapshot"), "$.denied_by_panic_mode") == "true"
    d = df.filter(F.coalesce(flag, F.lit(False))).select("user_did", "session_id").distinct()
    return d.groupBy("user_did").agg(F.count(F.lit(1)).alias("sessions"))


def snapshot(tables: dict[str, DataFrame], root: str, run_id: str, keep: int = 7) -> list[str]:
    """Write each table under ``root/run=<run_id>/<name>`` and delete all but the
    newest ``keep`` runs (run ids sort by time, e.g. yyyymmddHHMMSS).  Returns the runs
    kept."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/run={run_id}/{name}")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(conf)
    runs = sorted((st.getPath().getName()[4:] for st in fs.listStatus(p)
                   if st.isDirectory() and st.getPath().getName().startswith("run=")), reverse=True)
    for old in runs[keep:]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/run={old}"), True)
    return runs[:keep]
