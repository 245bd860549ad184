"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u > v).  Large star: every node hands the least node it knows to its greater
    neighbours.  Small star: to its smaller ones and itself.  The least neighbour comes from a
    partial aggregate, so a hub's edges are combined before they are shuffled."""
    e = edges
    if large:
        e = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    j = e.join(least, "u")
    if large:
        out = j.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (j.select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(least.select("u", F.col("m").alias("v"))))
    return out.filter(F.col("u") != F.col("v"))


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or a smaller and a greater one."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x"))
    at = ends.groupBy("x.id").agg(F.sum("x.up").alias("up"), F.max("x.down").alias("down"))
    return at.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).limit(1).count() > 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b): component is the least node reachable.

    The rounds go on until every component is a star around its least node; every round is a table
    in the shared folder.  Null ends, loops and repeated edges are ignored; no edges give no rows.
    """
    e = store(edges.filter(F.col("a") != F.col("b"))
              .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while _unsettled(e):
        e = store(_star(_star(e, True), False).distinct())
    roots = e.select(F.col("v").alias("id")).distinct()
    return (e.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .unionByName(roots.select("id", F.col("id").alias("component"))))
