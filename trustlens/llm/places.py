"""The place of each row within its group, however large a group is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import store

LARGE = 4_096  # groups of more rows are numbered by a range sort


def split_by_size(df: DataFrame, group: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of at most ``most`` rows, and the others (None where there are none)."""
    large = store(df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
                  .filter(F.col("_n") > most).select("_g"))
    if not large.limit(1).count():
        return df, None
    same = df[group].eqNullSafe(large["_g"])
    return df.join(large, same, "left_anti"), df.join(large, same, "left_semi")


def by_range(df: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with the place (from 0) of each row in its group.

    All rows are range-partitioned by (group, order), so that a large group is many tasks; a row's
    place is its place in its partition's run of the group, plus the lengths of the group's runs in
    the partitions before.  ``order`` should tell the rows of a group apart, since equal rows stay in
    one partition.
    """
    keys = [F.col(group), *order]
    at = F.monotonically_increasing_id()  # partition << 33 | row
    run = F.shiftright("_at", 33)
    rows = store(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", at))
    runs = rows.groupBy(F.col(group).alias("_g"), run.alias("_p")).agg(
        F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy("_g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = rows[group].eqNullSafe(runs["_g"]) & (run == runs["_p"])
    return (rows.join(runs, same).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before"))
            .drop("_g", "_p", "_at", "_first", "_before"))


def numbered(df: DataFrame, group: str, order: Sequence[Column], name: str, most: int = LARGE) -> DataFrame:
    """As ``by_range``; groups of at most ``most`` rows are numbered by a window instead."""
    small, large = split_by_size(df, group, most)
    out = small.withColumn(name, F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("long") - 1)
    return out if large is None else out.unionByName(by_range(large, group, order, name))
