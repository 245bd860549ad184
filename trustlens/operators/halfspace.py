"""Half-Space-Trees anomaly scores, parallel form.

Tan, Ting & Liu (IJCAI 2011): random half-space trees over a workspace of the
(scaled) features; the node masses of one window score the events of the next window
that has events, so "score first, learn after" holds between windows.  Windows are
event-time buckets (per optional key), never a global row number.

Plan: (1) the statistics of the window before scale a window; (2) events, in salted parts of a
window, are shuffled once; each part counts its events by leaf in each tree (numpy, vectorized),
and a window's counts are gathered to one row per tree (at most as many leaves as a tree has);
(3) a part meets the 25 rows of the window before.  A node's mass is the number of events in a
range of leaves, so it is a difference of two running counts: no node above the leaves is stored.

What a key's last window leaves behind, its statistics and its leaf counts, is the whole model;
``streaming/half_space.py`` keeps it between micro-batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ("latency", "risk_score", "distance")


def _trees(n_trees: int, height: int, n_dims: int, seed: int):
    rng = np.random.default_rng(seed)
    dims = rng.integers(0, n_dims, size=(n_trees, 2 ** (height + 1)), dtype=np.int8)
    sq = rng.random((n_trees, n_dims))
    r = 2 * np.maximum(sq, 1 - sq)
    return dims, sq - r, sq + r


def _leaves(x: np.ndarray, trees, height: int) -> np.ndarray:
    """The leaf of each row of ``x`` in each tree (heap numbering, the root is 1); all trees at once."""
    dims, lo0, hi0 = trees
    n, n_trees = x.shape[0], len(dims)
    each = np.arange(n_trees)
    node = np.ones((n, n_trees), dtype=np.int64)
    lo = np.broadcast_to(lo0, (n, *lo0.shape)).copy()
    hi = np.broadcast_to(hi0, (n, *hi0.shape)).copy()
    for _ in range(height):
        d = dims[each, node].astype(np.int64)[:, :, None]
        low, high = np.take_along_axis(lo, d, 2), np.take_along_axis(hi, d, 2)
        mid = (low + high) / 2
        left = np.take_along_axis(x, d[:, :, 0], 1)[:, :, None] < mid
        np.put_along_axis(hi, d, np.where(left, mid, high), 2)
        np.put_along_axis(lo, d, np.where(left, low, mid), 2)
        node = node * 2 + ~left[:, :, 0]
    return node.astype(np.int32)


def _count(trees, height: int, by: list[str], feats: list[str]):
    """The events of a part of a window by tree and leaf."""
    def run(events: pd.DataFrame) -> pd.DataFrame:
        at = _leaves(events[feats].to_numpy(dtype=float), trees, height)
        found = [np.unique(at[:, t], return_counts=True) for t in range(at.shape[1])]
        out = pd.DataFrame({"_t": np.repeat(np.arange(len(found)), [len(x) for x, _ in found]),
                            "_leaf": np.concatenate([x for x, _ in found]),
                            "_c": np.concatenate([c for _, c in found])})
        for i, c in enumerate(by):
            out.insert(i, c, events[c].iloc[0])
        return out
    return run


def _score(trees, height: int, id_col: str, feats: list[str]):
    """Scores a part of a window: its events, and per tree the leaf counts of the window before."""
    def run(events: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        total, n = np.zeros(len(events)), events["_n"].to_numpy(dtype=float)
        if len(events):
            at = _leaves(events[feats].to_numpy(dtype=float), trees, height).astype(np.int64)
            depth = np.arange(height + 1)
            for t, leaf, count in zip(model["_t"], model["_leaf"], model["_c"]):
                leaf, before = np.asarray(leaf), np.concatenate(([0], np.cumsum(np.asarray(count))))
                # the first leaf below each node of the path
                first = at[:, t, None] >> height - depth << height - depth
                mass = (before[np.searchsorted(leaf, first + (1 << height - depth))]
                        - before[np.searchsorted(leaf, first)])
                # nodes after the first node whose mass is under the limit do not count
                small = mass < n[:, None] * 0.1
                total += np.where(np.cumsum(small, axis=1) - small == 0, mass * 2.0 ** depth, 0.0).sum(axis=1)
        most = len(trees[0]) * (2.0 ** (height + 1) - 1) * n
        return pd.DataFrame({id_col: events[id_col], "hst_score": 1.0 - total / most})
    return run


def score_windows(df: DataFrame, window_seconds: int = 3600, key: str | None = None, n_trees: int = 25,
                  height: int = 15, seed: int = 42, id_col: str = "event_id", ts: str = "timestamp_ns",
                  features=FEATURES, part_rows: int = 50_000, before: tuple[DataFrame, DataFrame] | None = None,
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, statistics, leaves): the events' ids and scores (M4), and of each key's last window the
    statistics and the leaf counts.  ``before`` is what an earlier call left: its windows come before
    all of ``df``."""
    keys, feats = [key] if key else [], list(features)
    trees = _trees(n_trees, height, len(feats), seed)
    x = df.select(id_col, ts, *keys, *feats).withColumn(
        "_t0", F.floor(F.col(ts) / F.lit(window_seconds * 1_000_000_000)).cast("long"))
    # (1) scale a window with the statistics of the one before it (logistic squash to [0, 1]);
    # a key's first window has none: it is scaled with its own and only learned from
    stats = x.groupBy(*keys, "_t0").agg(F.count(F.lit(1)).alias("_n"),
                                        *[F.avg(f).alias(f"_m_{f}") for f in feats],
                                        *[F.stddev_pop(f).alias(f"_s_{f}") for f in feats])
    if before is not None:
        stats = stats.unionByName(before[0].select(*stats.columns))
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_t0")  # a row a window
    stats = stats.withColumn("_w", F.row_number().over(order)).withColumn("_last", F.lead("_t0").over(order).isNull())
    moments = [c for c in stats.columns if c.startswith(("_m_", "_s_"))]
    st = stats.select(*keys, "_t0", "_w", F.col("_n").alias("_here"), F.lag("_n").over(order).alias("_n"),
                      *[F.coalesce(F.lag(c).over(order), F.col(c)).alias(c) for c in moments])
    parts = F.greatest(F.lit(1), F.ceil(F.col("_here") / part_rows)).cast("int")
    st = st.withColumn("_parts", parts)
    same = [x[c].eqNullSafe(st[c]) for c in keys] + [x["_t0"] == st["_t0"]]
    x = x.join(st, same).drop(*[st[c] for c in [*keys, "_t0"]])
    scaled = [(1 / (1 + F.exp(-(F.col(f) - F.col(f"_m_{f}")) / F.greatest(F.col(f"_s_{f}"), F.lit(1e-9)))))
              .alias(f"_x{i}") for i, f in enumerate(feats)]
    names = [f"_x{i}" for i in range(len(feats))]
    x = x.select(id_col, *keys, "_w", "_n", F.pmod(F.xxhash64(id_col), F.col("_parts")).alias("_part"), *scaled)
    # (2) leaf counts per (window, tree)
    by = [*keys, "_w", "_part"]
    kinds = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys) + ", " * bool(keys)
    counts = (x.groupBy(*by).applyInPandas(_count(trees, height, [*keys, "_w"], names),
                                           f"{kinds}_w int, _t int, _leaf int, _c long")
              .groupBy(*keys, "_w", "_t", "_leaf").agg(F.sum("_c").alias("_c")))
    if before is not None:  # a key's earlier window is its first here
        counts = counts.unionByName(before[1].withColumn("_w", F.lit(1)).select(*counts.columns))
    leaves = F.array_sort(F.collect_list(F.struct("_leaf", "_c")))
    model = counts.groupBy(*keys, "_w", "_t").agg(leaves.alias("_l"))
    # (3) a window's parts meet the counts of the window before
    after = st.select(*[F.col(c).alias(f"_k{c}") for c in keys], (F.col("_w") - 1).alias("_v"), "_parts")
    on = [F.col(c).eqNullSafe(F.col(f"_k{c}")) for c in keys] + [F.col("_w") == F.col("_v")]
    model = (model.join(after, on)
             .select(*[F.col(c).alias(f"_m{c}") for c in keys], (F.col("_w") + 1).alias("_m_w"), "_t",
                     F.col("_l._leaf").alias("_leaf"), F.col("_l._c").alias("_c"),
                     F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_p")))
    model = model.select("*", F.col("_p").cast("long").alias("_m_part")).drop("_p")
    scored = (x.filter(F.col("_n").isNotNull()).groupBy(*by).cogroup(model.groupBy(*[f"_m{c}" for c in by]))
              .applyInPandas(_score(trees, height, id_col, names), f"{id_col} {dict(df.dtypes)[id_col]}, hst_score double"))
    last = stats.filter("_last")
    ends = last.select(*[F.col(c).alias(f"_k{c}") for c in keys], F.col("_w").alias("_v"))
    left = counts.join(ends, on, "left_semi").drop("_w")
    return scored, last.drop("_w", "_last"), left


def half_space_scores(df: DataFrame, window_seconds: int = 3600, key: str | None = None,
                      n_trees: int = 25, height: int = 15, seed: int = 42, id_col: str = "event_id",
                      ts: str = "timestamp_ns", features=FEATURES, part_rows: int = 50_000) -> DataFrame:
    """M4: per event ``hst_score`` in [0, 1] (high = anomalous); NULL in a key's first
    window (no model yet).  A window without events is no window: the next one is scored by
    the last one that has some."""
    scored, _, _ = score_windows(df, window_seconds, key, n_trees, height, seed, id_col, ts, features, part_rows)
    return df.join(scored, id_col, "left")
