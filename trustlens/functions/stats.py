"""Distributed exact order statistics and moment merging.

An exact quantile of a key is found without sorting the key's values: a mergeable quantile
sketch with a guaranteed rank error gives a bracket that holds the wanted rank, rows below the
bracket are only counted, and only the distinct values inside it (a few thousandths of the key)
are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Column, Window
from pyspark.sql import functions as F

ACCURACY = 1000  # the sketch's rank error is at most 1 / ACCURACY of the key's rows


def _bracket(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Per key: the values near rank q with ``_c`` (how often) and ``_cum`` (how many rows up to
    and including them), and ``_n`` (all rows)."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    lo, hi = q - 3 / ACCURACY, q + 3 / ACCURACY
    # an end beyond the first or last rank takes in everything on that side
    # below 2 * ACCURACY rows one rank is more than the slack: the bracket is all of the key
    few = F.count(F.lit(1)) <= 2 * ACCURACY
    near = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        (F.when(few, F.min("_v")).otherwise(F.percentile_approx("_v", lo, ACCURACY)) if lo > 0
         else F.min("_v")).alias("_lo"),
        (F.when(few, F.max("_v")).otherwise(F.percentile_approx("_v", hi, ACCURACY)) if hi < 1
         else F.max("_v")).alias("_hi"))
    near = near.withColumns({f"_k{i}": F.col(k) for i, k in enumerate(keys)}).drop(*keys)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    j = (rows.join(near, on) if keys else rows.join(F.broadcast(near), F.col("_v") <= F.col("_hi")))
    j = j.filter(F.col("_v") <= F.col("_hi"))
    inside = F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))  # null: below the bracket
    h = j.groupBy(*keys, inside.alias("_x")).agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.col("_x").asc_nulls_first())
    return (h.withColumn("_cum", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
             .filter(F.col("_x").isNotNull()))


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, out: str) -> DataFrame:
    """Linear-interpolated quantile (position (n-1)q), equal to percentile / quantile_cont."""
    h = _bracket(df, keys, value, q)
    pos = (F.col("_n") - 1) * F.lit(float(q))
    lo, hi = F.floor(pos), F.ceil(pos)
    # a row covers 0-based ranks [_cum - _c, _cum - 1]
    sel = h.filter((F.col("_cum") - F.col("_c") <= hi) & (F.col("_cum") - 1 >= lo))
    g = sel.groupBy(*keys).agg(F.min("_x").alias("_vlo"), F.max("_x").alias("_vhi"),
                               F.first(pos).alias("_pos"))
    res = F.col("_vlo") + (F.col("_pos") - F.floor(F.col("_pos"))) * (F.col("_vhi") - F.col("_vlo"))
    return g.select(*keys, res.cast("double").alias(out))


def floor_index_pick(df: DataFrame, keys: list[str], value: str, p: float, out: str) -> DataFrame:
    """sorted(values)[int(n*p)] per key (T13: floor index, no interpolation)."""
    h = _bracket(df, keys, value, p)
    idx = F.least(F.floor(F.col("_n") * F.lit(float(p))), F.col("_n") - 1)
    sel = h.filter((F.col("_cum") - F.col("_c") <= idx) & (F.col("_cum") - 1 >= idx))
    return sel.groupBy(*keys).agg(F.min("_x").cast("double").alias(out))


def moments(value: Column, prefix: str = "") -> list[Column]:
    """Mergeable latency state: n, sum, m2 (sum of squared deviations from the group mean)."""
    n = F.count(value)
    return [n.alias(f"{prefix}n"), F.sum(value).alias(f"{prefix}sum"),
            (F.var_pop(value) * n).alias(f"{prefix}m2")]


def merge_moments(state: DataFrame, keys: list[str], n="n", s="sum", m2="m2") -> DataFrame:
    """Merge (n, sum, m2) rows per key: mean = S/N,
    var_samp = (sum m2_i + sum n_i (mean_i - mean)^2) / (N - 1).  Two aggregates and a
    key join (both sides hash-partitioned on the keys), no sum-of-squares cancellation."""
    tot = state.groupBy(*keys).agg(F.sum(n).alias("_N"), F.sum(s).alias("_S"))
    tot = tot.withColumn("_mean", F.try_divide(F.col("_S"), F.col("_N")))
    j = state.join(tot, keys, "inner")
    dev = F.col(n) * F.pow(F.try_divide(F.col(s), F.col(n)) - F.col("_mean"), 2)
    out = j.groupBy(*keys).agg(F.first("_N").alias("n"), F.first("_mean").alias("mean"),
                               (F.sum(F.coalesce(F.col(m2), F.lit(0.0))) + F.sum(dev)).alias("_M2"))
    return out.select(*keys, "n", "mean",
                      F.try_divide(F.col("_M2"), (F.col("n") - 1).cast("double")).alias("var_samp"))
