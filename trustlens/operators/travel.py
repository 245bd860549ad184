"""Previous-login features and impossible travel (W2, W3), with a skew-safe lag.

A plain ``lag().over(partitionBy(user))`` sends all rows of a user to one task; a
user holding a third of the table would stall the stage.  ``lag_within`` splits
each key by a time slice, lags inside (key, slice), and patches the first row of a
slice with the last row of the key's previous non-empty slice (found from a small
per-(key, slice) max_by aggregate).  Same result, bounded task size.
The slices are as fine as the fullest key needs (``slice_seconds``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Mean Earth radius in km for the great-circle distance.
EARTH_RADIUS_KM = 6371.0


SLICE_ROWS = 1_000_000  # rows of a key in one time slice, where finer slices can have that


def slice_seconds(df: DataFrame, keys: list[str], ts: str, most: int = SLICE_ROWS) -> int:
    """The time slices to split keys by: a day, or as much finer as the fullest slice of a key asks
    for, down to a second.  Counts are partial aggregates; usually one pass over two columns."""
    s = 86_400
    while s > 1:
        slot = F.floor(F.col(ts) / F.lit(s * 1_000_000_000))
        full = df.groupBy(*keys, slot.alias("_s")).count().agg(F.max("count")).first()[0] or 0
        if full <= most:
            break
        s = max(1, min(s // 2, s * most // full))
    return s


def lag_within(df: DataFrame, keys: list[str], ts: str, tie: str | None, cols: list[str],
               split_seconds: int | None = None) -> DataFrame:
    """Adds ``prev_<c>`` for each c in cols (and ``prev_<ts>``): the previous row of the same
    key in (ts, tie) order, or NULL for the key's first row.  Without ``split_seconds`` the slices
    follow the row counts."""
    split_seconds = split_seconds or slice_seconds(df, keys, ts)
    order = [ts] + ([tie] if tie and tie in df.columns else [])
    carry_cols = list(dict.fromkeys(cols + [ts]))
    d = df.withColumn("_split", F.floor(F.col(ts) / F.lit(split_seconds * 1_000_000_000)).cast("long"))
    w = Window.partitionBy(*keys, "_split").orderBy(*order)
    d = d.withColumn("_first", F.lag(F.lit(1)).over(w).isNull())
    for c in carry_cols:
        d = d.withColumn(f"_lag_{c}", F.lag(c).over(w))
    last = (d.groupBy(*keys, "_split")
             .agg(F.max_by(F.struct(*carry_cols), F.struct(*order)).alias("_last")))
    wl = Window.partitionBy(*keys).orderBy("_split")
    carry = last.select(*keys, "_split", F.lag("_last").over(wl).alias("_carry"))
    d = d.join(carry, keys + ["_split"], "left")
    for c in carry_cols:
        d = d.withColumn(f"prev_{c}", F.when(F.col("_first"), F.col(f"_carry.{c}")).otherwise(F.col(f"_lag_{c}")))
    return d.drop("_split", "_first", "_carry", *[f"_lag_{c}" for c in carry_cols])


def great_circle_km(lat1, lon1, lat2, lon2):
    """Haversine distance in km."""
    r = F.radians
    a = (F.pow(F.sin((r(lat2) - r(lat1)) / 2), 2)
         + F.cos(r(lat1)) * F.cos(r(lat2)) * F.pow(F.sin((r(lon2) - r(lon1)) / 2), 2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def with_previous_login(df: DataFrame, key: str = "user_did", ts: str = "timestamp_ns",
                        tie: str = "event_id", lat: str = "lat", lon: str = "lon",
                        split_seconds: int | None = None) -> DataFrame:
    """distance_km and time_delta_mins since the same user's previous event.
    First event of a user: NULLs.  Missing coordinates on either side: NULL distance."""
    x = lag_within(df, [key], ts, tie, [lat, lon], split_seconds)
    mins = (F.col(ts) - F.col(f"prev_{ts}")) / F.lit(60 * 1_000_000_000)
    dist = great_circle_km(F.col(f"prev_{lat}"), F.col(f"prev_{lon}"), F.col(lat), F.col(lon))
    return x.withColumn("time_delta_mins", mins.cast("double")).withColumn("distance_km", dist)


def impossible_travel(df: DataFrame, km: float = 1000.0, minutes: float = 10.0) -> DataFrame:
    """More than 1000 km in under 10 minutes (on W2 output)."""
    return df.filter((F.col("distance_km") > km) & (F.col("time_delta_mins") < minutes))
