"""Pipeline-health state per node from a delivery log (X4) as window computations.

The state machine (NORMAL / DEGRADED / PANIC with hysteresis) only remembers whether
it is in PANIC: outside PANIC the state follows the current row.  A row enters PANIC
(backlog >= 10,000, or >= 300 s disconnected, or > 900 MiB) and a row can leave it
(backlog < 2,000, >= 30 s connected, disk ok); both cannot hold on one row.  So a row
is in PANIC iff the latest entry row so far is newer than the latest exit row - two
running maxima.  Run starts (connected / disconnected since) are running maxima too.
All running values use the split-and-carry scheme of ``travel.lag_within``, so a node
with most of the log is not one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .travel import lag_within, slice_seconds

# Fixed values of the state machine.
PANIC_BACKLOG = 10_000
PANIC_DISCONNECTED_S = 300
PANIC_DB_BYTES = 900 * 1024 * 1024
EXIT_BACKLOG = 2_000
EXIT_CONNECTED_S = 30


def running_max_within(df: DataFrame, keys: list[str], order: list[str], col: str, out: str,
                       ts: str, split_seconds: int | None = None) -> DataFrame:
    """Running max of ``col`` per key in ``order``; computed per (key, time slice) and
    patched with the max of all earlier slices of the key."""
    split_seconds = split_seconds or slice_seconds(df, keys, ts)
    d = df.withColumn("_split", F.floor(F.col(ts) / F.lit(split_seconds * 1_000_000_000)).cast("long"))
    w = Window.partitionBy(*keys, "_split").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_rm", F.max(col).over(w))
    per = d.groupBy(*keys, "_split").agg(F.max(col).alias("_sm"))
    ws = Window.partitionBy(*keys).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_carry", F.max("_sm").over(ws)).drop("_sm")
    d = d.join(per, keys + ["_split"], "left")
    return d.withColumn(out, F.greatest("_rm", "_carry")).drop("_split", "_rm", "_carry")


def health_states(log: DataFrame, node: str = "node", ts: str = "timestamp_ns", sent: str = "sent",
                  backlog: str = "backlog", db_bytes: str = "db_bytes", tie: str | None = "seq",
                  initial_panic: bool = False) -> DataFrame:
    """State after each delivery-log row."""
    order = [ts] + ([tie] if tie and tie in log.columns else [])
    split = slice_seconds(log, [node], ts)
    x = lag_within(log, [node], ts, tie, [sent], split)
    run_start = F.when(F.col(f"prev_{sent}").isNull() | (F.col(f"prev_{sent}") != F.col(sent)), F.col(ts))
    x = x.withColumn("_run_start", run_start)
    x = running_max_within(x, [node], order, "_run_start", "_run_since", ts, split)
    since_s = (F.col(ts) - F.col("_run_since")) / F.lit(1_000_000_000)
    connected_s = F.when(F.col(sent), since_s)
    disconnected_s = F.when(~F.col(sent), since_s)
    disk_full = F.col(db_bytes) > PANIC_DB_BYTES
    enter = (F.col(backlog) >= PANIC_BACKLOG) | F.coalesce(disconnected_s >= PANIC_DISCONNECTED_S, F.lit(False)) | disk_full
    exit_ok = (F.col(backlog) < EXIT_BACKLOG) & F.coalesce(connected_s >= EXIT_CONNECTED_S, F.lit(False)) & ~disk_full
    # index rows by (ts, tie) as a sortable long pair encoded in a struct
    pos = F.struct(*[F.col(c) for c in order])
    x = x.withColumn("_enter_at", F.when(enter, pos)).withColumn("_exit_at", F.when(exit_ok, pos))
    x = running_max_within(x, [node], order, "_enter_at", "_last_enter", ts, split)
    x = running_max_within(x, [node], order, "_exit_at", "_last_exit", ts, split)
    in_panic = F.col("_last_enter").isNotNull() & (F.col("_last_exit").isNull() | (F.col("_last_enter") > F.col("_last_exit")))
    if initial_panic:
        in_panic = in_panic | (F.col("_last_exit").isNull())
    state = (F.when(in_panic, "PANIC")
              .when((F.col(backlog) > 0) | ~F.col(sent), "DEGRADED").otherwise("NORMAL"))
    return x.withColumn("state", state).drop("_run_start", "_run_since", "_enter_at", "_exit_at",
                                             "_last_enter", "_last_exit", f"prev_{sent}", f"prev_{ts}")


def with_timers(log: DataFrame, until_ns: int, node: str = "node", ts: str = "timestamp_ns", sent: str = "sent",
                tie: str = "seq") -> DataFrame:
    """The log plus a row (``timer`` true) where a state can change though nothing is logged: 300 s into a
    disconnected run or 30 s into a connected one, up to ``until_ns``.  Such a row repeats the last one
    before it."""
    split = slice_seconds(log, [node], ts)
    x = lag_within(log, [node], ts, tie, [sent], split)
    x = x.withColumn("_start", F.when(F.col(f"prev_{sent}").isNull() | (F.col(f"prev_{sent}") != F.col(sent)), F.col(ts)))
    x = running_max_within(x, [node], [ts, tie], "_start", "_since", ts, split).drop(f"prev_{sent}", f"prev_{ts}", "_start")
    # the row after: the one before in the opposite order
    x = x.withColumn("_back", -F.col(ts)).withColumn("_tie", -F.col(tie))
    x = lag_within(x, [node], "_back", "_tie", [ts], split).withColumnRenamed(f"prev_{ts}", "_next")
    limit = F.when(F.col(sent), F.lit(EXIT_CONNECTED_S * 1_000_000_000)).otherwise(F.lit(PANIC_DISCONNECTED_S * 1_000_000_000))
    at = F.col("_since") + limit
    fires = (at > F.col(ts)) & (at <= F.lit(until_ns)) & (F.col("_next").isNull() | (F.col("_next") > at))
    timers = x.filter(fires).withColumn(ts, at).select(*log.columns, F.lit(True).alias("timer"))
    return log.withColumn("timer", F.lit(False)).unionByName(timers)


OPEN_END = (1 << 63) - 1


def panic_periods(states: DataFrame, node: str = "node", ts: str = "timestamp_ns", tie: str = "seq") -> DataFrame:
    """(node, start, end): when each node was in PANIC, from ``health_states``; ``end`` is the first
    moment after, ``OPEN_END`` where the log ends in PANIC.  Periods of a node do not overlap."""
    ensure_checkpoint_dir(states.sparkSession)  # lineage ends at the narrow states, then at their changes
    x = states.select(node, ts, tie, (F.col("state") == "PANIC").alias("_in")).checkpoint()
    x = lag_within(x, [node], ts, tie, ["_in"])
    turns = (x.filter(F.col("_in") != F.coalesce("prev__in", F.lit(False))).select(node, ts, tie, "_in")
             .checkpoint())
    closed = (lag_within(turns, [node], ts, tie, []).filter(~F.col("_in"))
              .select(node, F.col(f"prev_{ts}").alias("start"), F.col(ts).alias("end")))
    last = turns.groupBy(node).agg(F.max_by(F.struct(ts, "_in"), F.struct(ts, tie)).alias("l")).filter("l._in")
    open_ = last.select(node, F.col(f"l.{ts}").alias("start"), F.lit(OPEN_END).alias("end"))
    return closed.unionByName(open_).filter(F.col("end") > F.col("start"))


def in_periods(rows: DataFrame, periods: DataFrame, out: str, node: str = "node", ts: str = "timestamp_ns") -> DataFrame:
    """``rows`` with a flag ``out``: whether ``ts`` is within a period (start <= ts < end) of its node.

    An interval join without pairs: rows and period starts are one sequence per node, the running
    maximum of (start, end) is the latest period that has begun, and its end decides.  Nodes are split by
    time slices with a carry, so one that holds much of the table is many tasks.  A NULL node or time
    is in no period.
    """
    at = F.struct("start", "end")
    marks = periods.filter(F.col(node).isNotNull()).select(
        F.col(node), F.col("start").alias(ts), F.lit(0).alias("_kind"), at.alias("_period"))
    both = rows.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    split = slice_seconds(rows.select(node, ts), [node], ts)
    both = running_max_within(both, [node], [ts, "_kind"], "_period", "_now", ts, split)
    inside = F.coalesce(F.col("_now.end") > F.col(ts), F.lit(False)) & F.col(node).isNotNull() & F.col(ts).isNotNull()
    return both.filter(F.col("_kind") == 1).withColumn(out, inside).drop("_kind", "_period", "_now")
