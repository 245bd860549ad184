"""Embedding near-duplicates by p-stable hashing.

Normalised vectors are projected on random Gaussian directions; a projection, shifted and
divided by a width, falls into a cell.  The cells of ``k`` projections are a bucket of one table
and there are ``tables`` tables.  Vectors of one bucket are compared by exact cosine in double
precision.  At a cosine of 0.98 (distance 0.2) one projection agrees with probability 0.867, a
table with 0.24, and a pair is missed by all 64 tables with probability 2.4e-8.

Equal vectors are one class with a weight.  A bucket is compared in blocks within a task, and a
pair is counted only in the first table where it meets, so that no pair is ever a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import compare_groups, in_blocks, local_roots, pair_mask
from .common import store
from .components import connected_components

TABLES, PROJECTIONS, WIDTH, BLOCK = 64, 10, 1.2, 1024


def _codes(unit: np.ndarray, tables: int, k: int, width: float, seed: int) -> np.ndarray:
    """A 32-bit hash of the bucket of each vector (row) in each table (column)."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    a = rng.standard_normal((unit.shape[1], tables * k))
    cell = np.floor((unit @ a + rng.uniform(0, width, tables * k)) / width).astype(np.int64)
    h = np.zeros((len(unit), tables), dtype=np.uint64)
    for x in np.moveaxis(cell.reshape(len(unit), tables, k), 2, 0):
        h = (h ^ (x.astype(np.uint64) & np.uint64(0xFFFFFFFF))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(16)).astype(np.uint32).astype(np.int32)


def _hashed(tables: int, k: int, width: float, seed: int):
    def run(batches):
        for b in batches:
            raw = [np.frombuffer(v, dtype="<f8") for v in b.column("vec").to_pylist()]
            codes: list = [b""] * len(raw)
            for d in {len(v) for v in raw}:
                at = [i for i, v in enumerate(raw) if len(v) == d]
                x = np.stack([raw[i] for i in at])
                for i, c in zip(at, _codes(x / np.linalg.norm(x, axis=1)[:, None], tables, k, width, seed)):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("node", "label", "vec", "weight")), pa.array(codes, pa.binary())],
                ["node", "label", "vec", "weight", "codes"])
    return run


def _binary(batches):
    """Valid vectors, divided by their largest component, as bytes of doubles; else null."""
    for b in batches:
        out = []
        for v in b.column("e").to_pylist():
            x = np.array(v, dtype=np.float64) if v and None not in v else np.zeros(1)
            top = np.abs(x).max()
            out.append((x / top + 0.0).tobytes() if np.isfinite(x).all() and top > 0 else None)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(out, pa.binary())],
                                         ["id", "label", "vec"])


def _table_rows(tables: int):
    def run(batches):
        for b in batches:
            c = np.frombuffer(b"".join(b.column("codes").to_pylist()), dtype="<i4").reshape(-1, tables)
            d = np.array([len(v) for v in b.column("vec").to_pylist()], dtype=np.int64)
            lab = b.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            # table, label and width of the vector go into the key; a clash only costs a comparison
            mix = (lab * 1_000_003 + d)[:, None] * tables + np.arange(tables)[None, :]
            key = (mix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (
                c.astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            n = np.repeat(b.column("node").to_numpy(), tables)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.astype(np.int64).ravel()), pa.array(n),
                 pa.array(np.tile(np.arange(tables, dtype=np.int32), len(c)))], ["key", "node", "t"])
    return run


def _links(least: float, tables: int):
    def found(t: pa.Table, first):
        node, weight = t.column("node").to_numpy(), t.column("weight").to_numpy()
        vec = [np.frombuffer(v, dtype="<f8") for v in t.column("vec").to_pylist()]
        label, table = t.column("label").to_numpy(), t.column("t").to_numpy()
        dims = np.array([len(v) for v in vec])
        mask = pair_mask(len(node), first)
        mask &= (label[:, None] == label[None, :]) & (dims[:, None] == dims[None, :]) & (
            table[:, None] == table[None, :])
        x = np.zeros((len(vec), dims.max()))
        for i, v in enumerate(vec):
            x[i, :len(v)] = v
        x /= np.linalg.norm(x, axis=1)[:, None]
        i, j = np.nonzero(mask & (x @ x.T >= least))
        if not len(i):
            return [[], [], []]
        codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), dtype="<i4").reshape(-1, tables)
        here = (codes[i] == codes[j]).argmax(axis=1) == table[i]  # the first table where they meet
        i, j = i[here], j[here]
        n = np.zeros(len(node), dtype=np.int64)
        np.add.at(n, i, weight[j])
        np.add.at(n, j, weight[i])
        at = np.flatnonzero(n)
        return [node[at], n[at], node[local_roots(len(node), i, j)[at]]]
    return found


def embedding_near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id",
                              vector_col: str = "embedding", label_col: str = "label",
                              tables: int = TABLES, projections: int = PROJECTIONS,
                              width: float = WIDTH, block: int = BLOCK, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept, label) per row.

    Only rows with the same label that is not null are compared, and only vectors of one length.
    A null, empty or zero vector, or one with a null or non-finite component, links with nothing:
    0 links, its own component.  Repeated rows and equal vectors link with each other.  A null id
    links like any other; it is never a component's id unless all its ids are null.  An empty
    table gives no rows; other columns are ignored.
    """
    base = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                          F.col(vector_col).alias("e"))
    kinds = dict(base.dtypes)
    rows = store(base.mapInArrow(_binary, f"id {kinds['id']}, label {kinds['label']}, vec binary"))
    usable = rows.filter(F.col("label").isNotNull() & F.col("vec").isNotNull())
    classes = store(usable.groupBy("label", "vec")
                    .agg(F.count("*").alias("weight"), F.min("id").alias("least_id"))
                    .withColumn("node", F.monotonically_increasing_id()))
    hashed = store(classes.select("node", F.xxhash64("label").alias("label"), "vec", "weight")
                   .mapInArrow(_hashed(tables, projections, width, seed),
                               "node long, label long, vec binary, weight long, codes binary"))
    cells = hashed.mapInArrow(_table_rows(tables), "key long, node long, t int")
    shared = cells.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > 1)
    met = cells.join(shared, "key").join(hashed, "node")
    blocks = in_blocks(met, "key", "node", "m", block)
    found = store(compare_groups(blocks, "key", _links(least, tables), ["node", "n", "root"],
                                 [pa.int64()] * 3, "node long, n long, root long"))
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of = (classes.join(links, "node", "left").join(parts.withColumnRenamed("id", "node"), "node", "left")
          .select("label", "vec", "least_id", F.coalesce("component", "node").alias("component"),
                  (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    least_of = of.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of = of.join(least_of, "component").select("label", "vec", "n_links", "component_id")
    out = rows.join(of, ["label", "vec"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"), "label")
    return out.select(id_col, "n_links", "component_id",
                      F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept"),
                      F.col("label").alias(label_col))
