"""Structured Streaming jobs.

Every query writes through a checkpoint location (exactly-once sinks or idempotent
foreachBatch keyed by batch id), so a restarted or re-tried batch never duplicates.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.events import yyyymm
from ..model import STDDEV_EPSILON, Z_THRESHOLD
from ..operators.revocations import ENTRY, KEY, merge_replicas


def with_event_time(df: DataFrame) -> DataFrame:
    """Event time as TIMESTAMP (watermarks reject timestamp_ntz)."""
    if "ts" in df.columns:
        return df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withColumn("ts", F.timestamp_micros(F.floor(F.col("timestamp_ns") / 1000).cast("long")))


def _fs(spark, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _numbered(spark, root: str, prefix: str) -> list[int]:
    """The numbers of the complete folders ``root/<prefix><number>``, in order."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    return sorted(int(x[len(prefix):]) for x in names if x.startswith(prefix)
                  and fs.exists(_fs(spark, f"{root}/{x}/_SUCCESS")[1]))


def stream_id(spark, checkpoint: str) -> str:
    """The id that a query keeps over restarts, from its checkpoint; a new checkpoint has another."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def write_audit(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Idempotent by stream and batch id - each batch overwrites only its own
    ``stream=<id>/batch=<id>`` folder, partitioned by month, so a retried batch replaces
    itself, and a stream with a new checkpoint, whose batches count from 0 again, leaves
    what others have written; the offset is committed after the write."""
    def sink(batch: DataFrame, batch_id: int):
        out = with_event_time(batch)
        folder = f"{path}/stream={stream_id(batch.sparkSession, checkpoint)}/batch={batch_id}"
        out.withColumn("yyyymm", yyyymm(F.col("ts"))).write.mode("overwrite").partitionBy("yyyymm").parquet(folder)
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def stream_rollup_1m(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Tumbling one-minute per-user latency state and decision counts, append mode
    (a window is emitted once the watermark passes it)."""
    e = with_event_time(events).withWatermark("ts", watermark)
    d = F.col("decision")
    return (e.groupBy(F.window("ts", "1 minute").alias("w"), "user_did").agg(
        F.count("latency_ms").alias("n"), F.sum("latency_ms").alias("sum"),
        (F.var_pop("latency_ms") * F.count("latency_ms")).alias("m2"),
        F.count(F.when(d == "ALLOW", 1)).alias("allow_count"),
        F.count(F.when(d == "DENY", 1)).alias("deny_count"),
        F.count(F.when(d == "CHALLENGE", 1)).alias("challenge_count"))
        .select(F.col("w.start").alias("window_start"), "user_did", "n", "sum", "m2",
                "allow_count", "deny_count", "challenge_count"))


def route_late(stream: DataFrame, on_time_path: str, late_path: str, checkpoint: str,
               delay_seconds: int = 600, trigger: dict | None = None):
    """Rows older than (max event time seen so far - delay) go to a side table.  Each
    batch leaves its mark in a folder of its own next to the checkpoint and starts from the
    mark of the batch before it, so a retried or restarted batch routes its rows alike."""
    marks = f"{checkpoint.rstrip('/')}-late-watermark"

    def sink(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        before = [n for n in _numbered(spark, marks, "batch=") if n < batch_id]
        wm = spark.read.parquet(f"{marks}/batch={before[-1]}").first()["wm"] if before else None
        b = with_event_time(batch)
        late = F.lit(False) if wm is None else (F.unix_micros("ts") < F.lit(int(wm)))
        b = b.withColumn("_late", late).persist()
        b.filter(~F.col("_late")).drop("_late").write.mode("overwrite").parquet(f"{on_time_path}/batch={batch_id}")
        b.filter(F.col("_late")).drop("_late").write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")
        mx = b.agg(F.max(F.unix_micros("ts"))).first()[0]
        b.unpersist()
        seen = [x for x in (wm, None if mx is None else mx - delay_seconds * 1_000_000) if x is not None]
        if seen:
            spark.createDataFrame([(max(seen),)], "wm long").write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def dedupe(events: DataFrame, watermark: str = "10 minutes", keys=("session_id", "timestamp_ns")) -> DataFrame:
    """Drop re-inserted duplicates within the watermark (bounded state)."""
    return with_event_time(events).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))


def two_consumers(stream: DataFrame, first, second, checkpoint_root: str):
    """Two independent queries over one source, each with its own checkpoint (its own
    offsets), like two consumer groups.  ``first`` / ``second`` map a stream to a started
    query given a checkpoint path."""
    return first(stream, f"{checkpoint_root}/a"), second(stream, f"{checkpoint_root}/b")


def revocation_state(spark, state_root: str) -> DataFrame:
    """The current state: the newest compacted version and the batches after it."""
    base = _numbered(spark, state_root, "v=")
    after = [n for n in _numbered(spark, state_root, "d=") if not base or n > base[-1]]
    parts = ([f"{state_root}/v={base[-1]}"] if base else []) + [f"{state_root}/d={n}" for n in after]
    if not parts:
        schema = f"{KEY} string, issuer_did string, timestamp long, reason string"
        return spark.createDataFrame([], schema).select(KEY, *ENTRY)
    return merge_replicas(*[spark.read.parquet(p) for p in parts])


def maintain_revocations(changes: DataFrame, state_root: str, checkpoint: str, trigger: dict | None = None,
                         compact_every: int = 50):
    """Each batch writes only its own entries, merged, to ``state_root/d=<batch_id>``; a
    retried batch replaces its folder.  Every ``compact_every`` batches the state becomes a
    version ``v=<batch_id>``, and batches and versions before the version before it are
    deleted, so readers of the previous version are not disturbed."""
    def sink(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        merge_replicas(batch.select(KEY, *ENTRY)).write.mode("overwrite").parquet(f"{state_root}/d={batch_id}")
        if batch_id % compact_every == compact_every - 1:
            versions = [n for n in _numbered(spark, state_root, "v=") if n < batch_id]
            parts = ([f"{state_root}/v={versions[-1]}"] if versions else []) + [
                f"{state_root}/d={n}" for n in _numbered(spark, state_root, "d=")
                if n <= batch_id and (not versions or n > versions[-1])]
            merge_replicas(*[spark.read.parquet(p) for p in parts]).write.mode("overwrite").parquet(
                f"{state_root}/v={batch_id}")
            if versions:
                fs, _ = _fs(spark, state_root)
                for prefix in ("v=", "d="):
                    for n in _numbered(spark, state_root, prefix):
                        if n < versions[-1] or (prefix == "d=" and n == versions[-1]):
                            fs.delete(_fs(spark, f"{state_root}/{prefix}{n}")[1], True)

    w = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def flag_revoked(requests: DataFrame, revocations: DataFrame, key: str = KEY) -> DataFrame:
    """J10 on a batch: each request gets ``revoked`` from a revocation table."""
    revs = revocations.select(key).distinct().withColumn("revoked", F.lit(True))
    return requests.join(revs, key, "left").withColumn("revoked", F.coalesce("revoked", F.lit(False)))


def enforce_stream(requests: DataFrame, state_root: str, path: str, checkpoint: str, trigger: dict | None = None):
    """Each micro-batch of requests is joined with the revocation state as R11 has it
    when the batch starts, and written to ``path/batch=<id>``."""
    def sink(batch: DataFrame, batch_id: int):
        state = revocation_state(batch.sparkSession, state_root)
        flag_revoked(batch, state).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    w = requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def score_stream(events: DataFrame, baseline: DataFrame, watermark: str = "10 minutes",
                 window: str = "1 minute") -> DataFrame:
    """M5: live per-user score: windowed mean latency joined with a static baseline
    (user_did, mean, sd); z-score, score and flag as in M1."""
    e = with_event_time(events).withWatermark("ts", watermark)
    w = e.groupBy(F.window("ts", window).alias("w"), "user_did").agg(
        F.count(F.lit(1)).alias("event_count"), F.avg("latency_ms").alias("raw_value"))
    j = w.join(baseline.select("user_did", "mean", "sd"), "user_did", "left")
    mean, sd = F.coalesce("mean", F.lit(0.0)), F.coalesce("sd", F.lit(0.0))
    z = (F.col("raw_value") - mean) / F.greatest(sd, F.lit(STDDEV_EPSILON))
    return j.select(F.col("w.start").alias("window_start"), "user_did", "event_count", "raw_value",
                    z.alias("z_score"), F.least(F.abs(z) / Z_THRESHOLD, F.lit(1.0)).alias("anomaly_score"),
                    (F.abs(z) > Z_THRESHOLD).alias("is_anomaly"))


def alerts(scored: DataFrame, threshold: float = 0.8, col: str = "anomaly_score") -> DataFrame:
    """alert filter."""
    return scored.filter(F.col(col) > threshold)
