"""Dashboard and load-report metrics re-aimed as table jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import floor_index_pick

# Latency histogram upper bounds in seconds (plus +Inf) used by the
# decision-point metrics.
LATENCY_BOUNDS = (0.01, 0.05, 0.1, 0.5, 1.0)


def decision_totals(df: DataFrame, by=("decision",)) -> DataFrame:
    """Count per label."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))


def latency_histogram(df: DataFrame, value: str, bounds=LATENCY_BOUNDS, by=()) -> DataFrame:
    """Cumulative bucket counts (le = bound, '+Inf' last), plus sum and count.

    One aggregate with a conditional count per bound, then a row-local explode to
    long form (no per-bound rescans)."""
    v = F.col(value)
    aggs = [F.count(F.when(v <= b, 1)).alias(f"_b{i}") for i, b in enumerate(bounds)]
    aggs += [F.count(v).alias("_inf"), F.sum(v).alias("sum"), F.count(v).alias("count")]
    g = df.groupBy(*by).agg(*aggs)
    entries = [F.struct(F.lit(float(b)).alias("le"), F.lit(str(b)).alias("le_label"),
                        F.col(f"_b{i}").alias("cum_count")) for i, b in enumerate(bounds)]
    entries.append(F.struct(F.lit(float("inf")).alias("le"), F.lit("+Inf").alias("le_label"),
                            F.col("_inf").alias("cum_count")))
    return g.select(*by, "sum", "count", F.explode(F.array(*entries)).alias("_e")).select(
        *by, "_e.le", "_e.le_label", "_e.cum_count", "sum", "count")


def histogram_quantile(h: DataFrame, q: float, by=()) -> DataFrame:
    """Quantile from cumulative buckets, linear inside the bucket; if the rank falls
    in +Inf, the top finite bound.  The window is over one series' buckets only."""
    w = Window.partitionBy(*by).orderBy("le") if by else Window.orderBy("le")
    x = (h.withColumn("_prev_le", F.lag("le").over(w))
          .withColumn("_prev_cum", F.coalesce(F.lag("cum_count").over(w), F.lit(0)))
          .withColumn("_total", F.max("cum_count").over(Window.partitionBy(*by) if by else Window.partitionBy()))
          .withColumn("_rank", F.lit(float(q)) * F.col("_total")))
    hit = x.filter((F.col("cum_count") >= F.col("_rank")) & (F.col("_total") > 0))
    first = hit.groupBy(*by).agg(F.min_by(F.struct("le", "_prev_le", "_prev_cum", "cum_count", "_rank"),
                                          F.col("le")).alias("_b"))
    lower = F.coalesce(F.col("_b._prev_le"), F.lit(0.0))
    frac = F.try_divide(F.col("_b._rank") - F.col("_b._prev_cum"),
                        (F.col("_b.cum_count") - F.col("_b._prev_cum")).cast("double"))
    val = (F.when(F.col("_b.le") == float("inf"), F.col("_b._prev_le"))
            .otherwise(lower + (F.col("_b.le") - lower) * F.coalesce(frac, F.lit(0.0))))
    return first.select(*by, val.alias("quantile"))


def counter_increase(samples: DataFrame, as_of_ns: int, range_seconds: int, series=("series",),
                     ts="timestamp_ns", value="value", tie="event_id") -> DataFrame:
    """Increase and per-second rate of a counter over a trailing range.  A drop is a
    restart from 0 (the new value counts whole).  No edge extrapolation (unlike PromQL)."""
    from .travel import lag_within
    s = samples.filter((F.col(ts) >= F.lit(as_of_ns - range_seconds * 1_000_000_000)) &
                       (F.col(ts) <= F.lit(as_of_ns)))
    s = lag_within(s, list(series), ts, tie, [value])
    prev = F.col(f"prev_{value}")
    delta = F.when(prev.isNull(), F.lit(None)).when(F.col(value) < prev, F.col(value)).otherwise(F.col(value) - prev)
    return (s.groupBy(*series).agg(F.coalesce(F.sum(delta), F.lit(0.0)).cast("double").alias("increase"))
             .withColumn("rate", F.col("increase") / F.lit(float(range_seconds))))


def coverage(df: DataFrame, as_of_ns: int, expected: int, ts="timestamp_ns") -> DataFrame:
    """Total, last 10 min, last 30 s, pct of expected (from the 10-minute count);
    PASS >= 95, WARN >= 70, else FAIL.  One aggregate row."""
    t = F.col(ts)
    g = df.agg(F.count(F.lit(1)).alias("total"),
               F.count(F.when(t >= F.lit(as_of_ns - 600 * 1_000_000_000), 1)).alias("recent_10m"),
               F.count(F.when(t >= F.lit(as_of_ns - 30 * 1_000_000_000), 1)).alias("recent_30s"))
    pct = (F.col("recent_10m") / F.lit(float(expected)) * 100) if expected > 0 else F.lit(0.0)
    return g.select("*", F.lit(int(expected)).alias("expected"), F.round(pct, 1).alias("coverage_pct"),
                    F.when(pct >= 95, "PASS").when(pct >= 70, "WARN").otherwise("FAIL").alias("verdict"))


TICKS_PER_SLICE = 4096


def latency_summary(df: DataFrame, value: str, by=()) -> DataFrame:
    """Avg, p95, p99 by floor index sorted[int(n*p)], all rounded to 2."""
    out_by = list(by)
    if not out_by:  # one summary row: group by a constant so every part joins on a key
        df = df.withColumn("_all", F.lit(1))
    keys = out_by or ["_all"]
    avg = df.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.avg(value), 2).alias("lat_avg"))
    p95 = floor_index_pick(df, keys, value, 0.95, "p95")
    p99 = floor_index_pick(df, keys, value, 0.99, "p99")
    j = avg.join(p95, keys, "left").join(p99, keys, "left")
    return j.select(*out_by, "n", "lat_avg", F.round("p95", 2).alias("lat_p95"), F.round("p99", 2).alias("lat_p99"))


def throughput_report(df: DataFrame, start_ns: int, tick_seconds: int, duration_ticks: int,
                      target_rate: int, ts="timestamp_ns", err="is_error", lat_us="latency_us"):
    """Per-tick running total, rate, cumulative errors and mean latency (integer us),
    and the final verdict.  Ticks are aggregated first and summed in slices, so no task sees
    more than a slice's ticks or a row per slice."""
    tick = F.floor((F.col(ts) - F.lit(start_ns)) / F.lit(tick_seconds * 1_000_000_000)).cast("long")
    per = df.groupBy(tick.alias("t")).agg(F.count(F.lit(1)).alias("rate"),
                                          F.count(F.when(F.col(err), 1)).alias("_err"),
                                          F.sum(lat_us).alias("_lat"), F.count(lat_us).alias("_ns"))
    # running sums inside slices of ticks, started from the sums of the slices before
    names = ["rate", "_err", "_lat", "_ns"]
    per = per.withColumn("_s", F.floor(F.col("t") / TICKS_PER_SLICE))
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    carry = per.groupBy("_s").agg(*[F.sum(c).alias(c) for c in names]).select(
        "_s", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b{c}") for c in names])
    w = Window.partitionBy("_s").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    inside = per.select("_s", "t", "rate", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"i{c}") for c in names])
    run = {c: F.col(f"b{c}") + F.col(f"i{c}") for c in names}
    rep = inside.join(carry, "_s").select(
        "t", run["rate"].alias("total"), "rate", run["_err"].alias("errors"),
        F.coalesce(F.try_divide(run["_lat"], run["_ns"]).cast("long"), F.lit(0)).alias("avg_lat_us"))
    fin = df.agg(F.count(F.lit(1)).alias("total_sent"), F.count(F.when(F.col(err), 1)).alias("total_errors"))
    real = F.floor(F.col("total_sent") / F.lit(max(duration_ticks, 1))).cast("long")
    verdict = (F.when((F.col("total_errors") == 0) & (real >= F.lit(target_rate * 80 // 100)), "PASS")
                .when(F.col("total_errors") == 0, "PARTIAL").otherwise("FAIL"))
    return rep, fin.select("*", real.alias("real_rate"), verdict.alias("verdict"))


def gauge_rollup(samples: DataFrame, series="series", ts="timestamp_ns", value="value",
                 group=()) -> DataFrame:
    """Latest value per series (max_by, map-side combined), then sum over series
    and count of series that are up (latest value > 0)."""
    last = samples.groupBy(*group, series).agg(F.max_by(value, F.struct(ts, value)).alias("_v"))
    return last.groupBy(*group).agg(F.sum("_v").alias("gauge_sum"),
                                    F.count(F.when(F.col("_v") > 0, 1)).alias("series_up"),
                                    F.count(F.lit(1)).alias("series"))
