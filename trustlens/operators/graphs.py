"""Reachability over an edge table.

Frontier loop: join the frontier with the edges, drop already-visited nodes with a
left-anti join, repeat until the frontier is empty.  Lineage is cut every few rounds
with ``checkpoint()`` into the shared ``spark.checkpoint.dir`` (reliable, survives
executor loss; never localCheckpoint).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _cut(df: DataFrame) -> DataFrame:
    """Materialize into the reliable checkpoint folder; the result is a plan leaf, so the
    loop's plans stay constant-size (no doubling lineage)."""
    ensure_checkpoint_dir(df.sparkSession)
    df = df.persist()
    out = df.checkpoint(eager=True)
    df.unpersist()
    return out


def reachable(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """G1: nodes reachable from the seeds (seeds included).  Only nodes of the graph
    (``nodes.node``) are reported; cycles are safe.  edges(src, dst).  Each round's new
    frontier and the visited set are checkpointed, so every round plans a fixed-size
    join (frontier x edges, anti-join visited) and survives executor loss.  The loop ends
    when the frontier is empty."""
    graph_nodes = nodes.select("node").distinct()
    e = _cut(edges.select("src", "dst").join(graph_nodes.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    visited = _cut(seeds.select("node").distinct().join(graph_nodes, "node", "left_semi"))
    frontier, i = visited, 0
    while True:
        nxt = _cut(frontier.join(e, frontier["node"] == e["src"]).select(F.col("dst").alias("node")).distinct()
                   .join(visited, "node", "left_anti"))
        if nxt.isEmpty():
            return visited
        # a union of checkpointed leaves grows linearly; re-cut it every 8 rounds
        visited, i = visited.unionByName(nxt), i + 1
        if i % 8 == 0:
            visited = _cut(visited)
        frontier = nxt


def reachable_paths(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Simple paths from the seeds, as arrays of nodes: one for each place where a walk
    stops.  It stops at a node without edges, and before a neighbour that is not in the graph
    (``nodes.node``) or already on the path; other neighbours continue it.  Seeds that are not
    in the graph give no path.  The number of paths can grow exponentially with the graph;
    their length cannot, as no node repeats."""
    graph_nodes = nodes.select("node").distinct()
    e = _cut(edges.select("src", "dst").distinct()
             .join(graph_nodes.select(F.col("node").alias("dst"), F.lit(True).alias("known")), "dst", "left"))
    seed = seeds.select("node").distinct().join(graph_nodes, "node", "left_semi")
    paths, done = seed.select(F.array("node").alias("path"), F.col("node").alias("tail")), []
    while True:
        go = F.coalesce(F.col("known") & ~F.array_contains("path", F.col("dst")), F.lit(False))
        step = _cut(paths.join(e, paths["tail"] == e["src"], "left").select("path", "dst", go.alias("go")))
        done.append(step.filter(~F.col("go")).select("path").distinct())
        paths = step.filter("go").select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("tail"))
        if paths.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
