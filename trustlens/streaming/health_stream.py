"""X4 on the stream: the health state machine of each node, with timers in event time.

The state of a node is a few numbers and the rows that the watermark has not passed yet.  Rows and
timers are taken in order of time up to the watermark.  A timer is due 300 s into a disconnected run and
30 s into a connected one; it fires when the watermark passes it, also when the node logs nothing more.
The result is that of ``health.health_states`` over ``health.with_timers`` up to the watermark.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.health import (EXIT_BACKLOG, EXIT_CONNECTED_S, PANIC_BACKLOG, PANIC_DB_BYTES,
                                PANIC_DISCONNECTED_S)

_S = 1_000_000_000
OUT = "node string, timestamp_ns long, seq long, state string, timer boolean"
# the last row taken, since when its run lasts, whether in PANIC; and the rows that wait
STATE = ("ts long, seq long, sent boolean, backlog long, db_bytes long, since long, panic boolean, "
         "w_ts array<long>, w_seq array<long>, w_sent array<boolean>, w_backlog array<long>, w_db array<long>")


def due(last: dict | None) -> int | None:
    """When the state can change next though nothing is logged."""
    if last is None:
        return None
    at = last["since"] + (EXIT_CONNECTED_S if last["sent"] else PANIC_DISCONNECTED_S) * _S
    return at if at > last["ts"] else None


def take(last: dict | None, ts: int, seq: int, sent: bool, backlog: int, db_bytes: int) -> tuple[dict, str]:
    """The machine after one row or timer, and its state."""
    since = last["since"] if last is not None and last["sent"] == sent else ts
    full, lasts = db_bytes > PANIC_DB_BYTES, ts - since
    panic = last is not None and last["panic"]
    if backlog >= PANIC_BACKLOG or full or not sent and lasts >= PANIC_DISCONNECTED_S * _S:
        panic = True
    elif backlog < EXIT_BACKLOG and sent and lasts >= EXIT_CONNECTED_S * _S:
        panic = False
    now = {"ts": ts, "seq": seq, "sent": sent, "backlog": backlog, "db_bytes": db_bytes, "since": since, "panic": panic}
    return now, "PANIC" if panic else "DEGRADED" if backlog > 0 or not sent else "NORMAL"


def advance(last: dict | None, waiting: list[tuple], until: int) -> tuple[dict | None, list[tuple], list[tuple]]:
    """(machine, rows that still wait, output): all rows and timers up to ``until`` ns, in order."""
    out = []
    waiting = sorted(waiting)
    at = 0
    while True:
        timer = due(last)
        row = waiting[at] if at < len(waiting) else None
        if row is not None and (timer is None or row[0] <= timer):
            if row[0] > until:
                break
            last, state = take(last, *row)
            out.append((row[0], row[1], state, False))
            at += 1
        elif timer is not None and timer <= until:
            last, state = take(last, timer, last["seq"], last["sent"], last["backlog"], last["db_bytes"])
            out.append((timer, last["seq"], state, True))
        else:
            break
    return last, waiting[at:], out


_NAMES = ("ts", "seq", "sent", "backlog", "db_bytes", "since", "panic")


def _step(key, batches, state):
    last, waiting = None, []
    if state.exists:
        values = state.get
        if values[0] is not None:
            last = dict(zip(_NAMES, values[:7]))
        waiting = list(zip(*values[7:]))
    for df in batches:
        waiting += [(int(t), int(q), bool(s), int(b), int(d)) for t, q, s, b, d in zip(
            df["timestamp_ns"], df["seq"], df["sent"], df["backlog"], df["db_bytes"])]
    mark = state.getCurrentWatermarkMs()
    last, waiting, out = advance(last, waiting, mark * 1_000_000)
    cols = [list(c) for c in zip(*waiting)] if waiting else [[]] * 5
    state.update((*(last[n] if last else None for n in _NAMES), *cols))
    times = [t for t in (due(last), waiting[0][0] if waiting else None) if t is not None]
    if times:
        # the next whole millisecond, and one that is still ahead
        state.setTimeoutTimestamp(max(-(-min(times) // 1_000_000), mark + 1))
    rows = list(zip(*out)) if out else [[]] * 4
    yield pd.DataFrame({"node": [key[0]] * len(out), "timestamp_ns": pd.Series(rows[0], dtype="int64"),
                        "seq": pd.Series(rows[1], dtype="int64"), "state": list(rows[2]),
                        "timer": pd.Series(rows[3], dtype="bool")})


def health_stream(log: DataFrame, watermark: str = "1 minute") -> DataFrame:
    """(node, timestamp_ns, seq, state, timer) of a streamed delivery log (node, timestamp_ns, seq, sent,
    backlog, db_bytes), once the watermark has passed; append mode.  Rows behind the watermark are dropped
    by the engine.  A node's state holds as many rows as it logs within the watermark's delay."""
    rows = log.withColumn("_ts", F.timestamp_micros(F.floor(F.col("timestamp_ns") / 1000).cast("long")))
    return (rows.withWatermark("_ts", watermark).groupBy("node")
            .applyInPandasWithState(_step, OUT, STATE, "append", "EventTimeTimeout"))
