"""Best-fit packing in bulk-synchronous rounds.

Documents are cut into pieces of at most a sequence.  Pieces and the gaps of open sequences are
ranked: each has a size and a rank among those of its size.  A round sweeps the gap sizes
upwards; the successor of a gap is the largest piece size, still in stock, that is not larger.
Many gaps of one size ask for the same size of piece: the gap of rank j gets the pieces of rank
j, and gaps whose rank is past the stock go on to the next smaller size in the same sweep.  All
gaps are updated at once, gaps too small for any piece left are closed, and the next round
starts.  New sequences are opened when no gap takes a piece any more.

A sweep is a loop on the driver over how many pieces and gaps there are of each size, so over two lists that are no
longer than a sequence has tokens, however many documents there are.  Ranking, matching rows by
(size, rank) and updating gaps are Spark jobs; every round's result is a table in the shared
folder.  Where one size holds much of the table, ranks are counted within salted parts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LONG_ROWS, store
from .tokens import WordEncoder, encoder

SEQUENCE, ROWS_PER_SALT = 2048, 4_000


def _cut(file: str, size: int, end_id: bytes, with_ids: bool):
    def run(batches):
        enc, at = encoder(WordEncoder, file), TaskContext.get().partitionId() << 33
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = enc.ids(text or "") + end_id
                for k, i in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[i:i + 4 * size]
                    rows.append((at, doc, k, i // 4, len(part) // 4, zlib.crc32(part))
                                + ((part,) if with_ids else ()))
                    at += 1
            kinds = [pa.int64(), b.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(),
                     pa.int64()] + [pa.binary()] * with_ids
            cols = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)],
                ["pid", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
    return run


def cut_pieces(docs: DataFrame, file: str, size: int = SEQUENCE, end_id: int = 0,
               with_ids: bool = False) -> DataFrame:
    """(pid, doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and ``end_id``
    in pieces of ``size``; the last may be shorter.  pid is unique."""
    docs = docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(
        _cut(file, size, end_id.to_bytes(4, "little"), with_ids),
        f"pid long, doc_id {kind}, piece int, start long, length long, ids_crc32 long"
        + ", ids binary" * with_ids)


def ranked(rows: DataFrame, size_col: str, key: str, n_rows: int) -> DataFrame:
    """``rows`` plus ``rank``: 0, 1, ... among the rows of the same size, without gaps."""
    salts = max(1, -(-n_rows // ROWS_PER_SALT))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    part = [size_col, "_salt"]
    counts = salted.groupBy(*part).count()
    first = counts.select(*part, F.coalesce(
        F.sum("count").over(W.partitionBy(size_col).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)),
        F.lit(0)).alias("_first"))
    return (salted.withColumn("_in", F.row_number().over(W.partitionBy(*part).orderBy(key)) - 1)
            .join(first, part).withColumn("rank", F.col("_first") + F.col("_in"))
            .drop("_salt", "_in", "_first"))


def sweep(gaps: dict[int, int], stock: dict[int, int], taken: Counter) -> list[tuple]:
    """One round's matches, smallest gaps first: (gap, from rank, to rank, length, pieces each,
    first piece's rank).  Takes what it matches out of ``stock``; ``taken`` says how many pieces
    of each length have gone before.  A gap that has room for several pieces of the length takes
    a run of them, so rounds are few where documents are short."""
    lengths, moves = sorted(k for k, v in stock.items() if v), []
    for gap in sorted(gaps):
        rank, end = 0, gaps[gap]
        while rank < end:
            i = bisect_right(lengths, gap) - 1
            if i < 0:
                break
            length = lengths[i]
            each = gap // length
            n = min(end - rank, stock[length] // each)
            if not n:
                n, each = 1, stock[length]
            moves.append((gap, rank, rank + n, length, each, taken[length]))
            taken[length] += n * each
            stock[length] -= n * each
            rank += n
            if not stock[length]:
                lengths.pop(i)
    return moves


def best_fit(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """``pieces`` (a stored table with pid and length) plus sequence_id and offset."""
    spark = pieces.sparkSession
    full = pieces.filter(F.col("length") == size)
    items = pieces.filter(F.col("length") < size)
    stock = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}  # < size rows
    items = store(ranked(items, "length", "pid", sum(stock.values())))
    taken, placed, bins, n_bins = Counter(), [], None, 0
    while any(stock.values()):
        least = min(k for k, v in stock.items() if v)
        open_ = bins.filter(F.col("gap") >= least) if bins is not None else None
        gaps = {r["gap"]: r["count"] for r in open_.groupBy("gap").count().collect()} if open_ is not None else {}
        if not gaps:
            need = max(sum(v for k, v in stock.items() if 2 * k > size),
                       -(-sum(k * v for k, v in stock.items()) // size))
            # stored, so that the gap is a column to join by and not a constant
            open_ = store(spark.range(n_bins, n_bins + need).select(
                F.col("id").alias("bin"), F.lit(size).cast("long").alias("gap")))
            gaps, n_bins = {size: need}, n_bins + need
        moves = spark.createDataFrame(
            sweep(gaps, stock, taken),
            "gap long, r0 long, r1 long, length long, each long, first long")
        at = ranked(open_, "gap", "bin", sum(gaps.values())).alias("b")
        m = F.broadcast(moves).alias("m")  # at most a row for each size of gap and of piece
        bins = store(at.join(m, (F.col("b.gap") == F.col("m.gap")) & (F.col("rank") >= F.col("r0"))
                             & (F.col("rank") < F.col("r1")), "left")
                     .select("bin", (F.col("b.gap") - F.coalesce(F.col("each") * F.col("length"), F.lit(0)))
                             .alias("gap"),
                             F.col("b.gap").alias("was"), "length", "each",
                             (F.col("first") + (F.col("rank") - F.col("r0")) * F.col("each")).alias("first")))
        j = F.explode(F.sequence(F.lit(0).cast("long"), F.col("each") - 1)).alias("j")
        placed.append(bins.filter(F.col("length").isNotNull())
                      .select("bin", "was", "length", "first", j)
                      .select((2 * F.col("bin")).alias("sequence_id"), "length",
                              (F.col("first") + F.col("j")).alias("rank"),
                              (F.lit(size) - F.col("was") + F.col("j") * F.col("length")).alias("offset")))
        bins = bins.select("bin", "gap")
    out = full.select("*", (2 * F.col("pid") + 1).alias("sequence_id"),
                      F.lit(0).cast("long").alias("offset"))
    if placed:
        where = placed[0]
        for p in placed[1:]:
            where = where.unionByName(p)
        out = out.unionByName(items.join(where, ["length", "rank"]).drop("rank"))
    return out


def pack_documents(docs: DataFrame, file: str, size: int = SEQUENCE, end_id: int = 0,
                   with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) per piece.

    A null or empty text is the end id alone.  A null doc_id is kept; repeated rows are packed
    each; an empty table gives no rows; other columns of ``docs`` are ignored.
    """
    out = best_fit(store(cut_pieces(docs, file, size, end_id, with_ids), LONG_ROWS), size)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                      *["ids"] * with_ids)
