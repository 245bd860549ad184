"""Half-Space Trees on the stream (X6): score first, learn after, over micro-batches.

The model of a key is what its last complete window left: the scaling statistics and the leaf counts
of each tree.  A window is complete once the greatest event time seen, less a delay, has passed its
end; its events wait until then.  The events of the windows that a batch completes are scored by the
batch operator with the stored model before them, and what their last windows leave is stored.

Each batch reads the state that the batch before it left and writes its scores, the waiting events
and the new state to folders of its own number; the mark is written last.  A batch that is tried again
or restarted so reads the same state and replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.halfspace import FEATURES, score_windows
from .jobs import _fs, _numbered

_NS = 1_000_000_000


def scored_events(spark, path: str) -> DataFrame:
    """What ``half_space_stream`` has written so far."""
    return spark.read.parquet(*[f"{path}/batch={n}" for n in _numbered(spark, path, "batch=")])


def half_space_stream(events: DataFrame, path: str, state_root: str, checkpoint: str, window_seconds: int = 3600,
                      key: str | None = None, delay_seconds: int = 600, id_col: str = "event_id",
                      ts: str = "timestamp_ns", features=FEATURES, trigger: dict | None = None, **trees):
    """Writes (id, [key,] time, hst_score, late) of the events of completed windows to
    ``path/batch=<id>``.

    ``hst_score`` is the one of ``half_space_scores`` over all events so far: NULL in a key's first
    window, and for an event whose window was already complete when it came (``late``), which the model
    does not learn from either.  ``trees`` are the operator's other parameters.  The state is a row per
    key and feature, and per key and tree at most as many counts as a tree has leaves; the events that
    wait are those of windows not complete.
    """
    keys, feats = [key] if key else [], list(features)
    columns = [id_col, ts, *keys, *feats]
    window = F.floor(F.col(ts) / F.lit(window_seconds * _NS)).cast("long")

    def sink(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        done = [n for n in _numbered(spark, state_root, "mark=") if n < batch_id]
        old = {}
        if done:
            old = {x: spark.read.parquet(f"{state_root}/{x}={done[-1]}") for x in ("mark", "waiting", "stats", "leaves")}
        seen, closed = tuple(old["mark"].first()) if old else (None, None)
        new = batch.select(*columns).withColumn("_t0", window)
        top = batch.agg(F.max(ts)).first()[0]
        seen = max([x for x in (seen, top) if x is not None], default=None)
        # windows with a number below ``upto`` are complete
        upto = closed if seen is None else (seen - delay_seconds * _NS) // (window_seconds * _NS)
        upto = max([x for x in (closed, upto) if x is not None], default=None)
        late = F.lit(False) if closed is None else F.col("_t0") < F.lit(closed)
        complete = F.lit(False) if upto is None else F.col("_t0") < F.lit(upto)
        rows = new.withColumn("late", late)
        if old:
            rows = old["waiting"].withColumn("_t0", window).withColumn("late", F.lit(False)).unionByName(rows)
        now = rows.filter(complete & ~F.col("late"))
        before = (old["stats"], old["leaves"]) if old else None
        scored, stats, leaves = score_windows(now.select(*columns), window_seconds, key, id_col=id_col, ts=ts,
                                              features=features, before=before, **trees)
        out = [id_col, *keys, ts]
        with_score = now.select(*out).join(scored, id_col, "left").withColumn("late", F.lit(False))
        too_late = rows.filter("late").select(*out, F.lit(None).cast("double").alias("hst_score"), "late")
        with_score.unionByName(too_late).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        stats.write.mode("overwrite").parquet(f"{state_root}/stats={batch_id}")
        leaves.write.mode("overwrite").parquet(f"{state_root}/leaves={batch_id}")
        (rows.filter(~complete & ~F.col("late")).select(*columns)
         .write.mode("overwrite").parquet(f"{state_root}/waiting={batch_id}"))
        (spark.createDataFrame([(seen, upto)], "seen long, closed long").coalesce(1)
         .write.mode("overwrite").parquet(f"{state_root}/mark={batch_id}"))
        fs, _ = _fs(spark, state_root)
        for n in done[:-1]:  # the state before the one that a retry reads
            for x in ("mark", "waiting", "stats", "leaves"):
                fs.delete(_fs(spark, f"{state_root}/{x}={n}")[1], True)

    w = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return w.trigger(**(trigger or {"availableNow": True})).start()
