"""Comparing the members of hash buckets inside tasks, in blocks of bounded size.

A bucket of m members is split by a hash of the member into ceil(m / block) blocks, and every
pair of blocks is a group of its own: a task holds two blocks at a time, however large the
bucket is, and yields what its comparison finds instead of candidate pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_blocks(rows: DataFrame, bucket: str, member: str, size: str, block: int) -> DataFrame:
    """``rows`` once for each group it is in: adds ``_a`` and ``_b`` (the group's blocks) and
    ``_own`` (the row's block); grouped and sorted within partitions."""
    n = F.ceil(F.col(size) / block).cast("int")
    out = (rows.withColumn("_n", n).withColumn("_own", F.pmod(F.xxhash64(member), F.col("_n")).cast("int"))
           .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
           .withColumn("_a", F.least("_own", "_o")).withColumn("_b", F.greatest("_own", "_o"))
           .drop("_n", "_o"))
    return out.repartition(bucket, "_a", "_b").sortWithinPartitions(bucket, "_a", "_b")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal ``keys`` (integers, not null) of a sorted partition."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if held and (i or (k[0] != last).any()):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
        last = k[-1]
    if held:
        yield pa.Table.from_batches(held)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of 0..n-1 reaches by the pairs (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare_groups(rows: DataFrame, bucket: str, found: Callable[[pa.Table, np.ndarray], list],
                   names: list[str], types: list[pa.DataType], schema) -> DataFrame:
    """``found`` gets each group of ``in_blocks`` rows and which rows are of its first block
    (all, where it has one block), and gives a list of columns."""
    def run(batches):
        for t in groups(batches, [bucket, "_a", "_b"]):
            if t.num_rows > 1:
                one = t.column("_a")[0].as_py() == t.column("_b")[0].as_py()
                first = None if one else (t.column("_own").to_numpy() == t.column("_a")[0].as_py())
                cols = found(t, first)
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays(
                        [c if isinstance(c, pa.Array) else pa.array(c, x) for c, x in zip(cols, types)], names)
    return rows.mapInArrow(run, schema)


def pair_mask(n: int, first: np.ndarray | None) -> np.ndarray:
    """The pairs (row < column, or across the two blocks) that a group is to compare."""
    if first is None:
        return np.triu(np.ones((n, n), dtype=bool), 1)
    return first[:, None] & ~first[None, :]
