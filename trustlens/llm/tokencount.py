"""Token counts of whole texts; huge texts are counted by overlap resynchronisation.

A text of up to ``chunk`` characters is encoded in its task, by pieces that a worker remembers
(see ``tokens``).  A longer one is cut into chunks that
overlap their successor by ``overlap`` characters; every chunk is a row of its own, so one huge
text is the work of many tasks.  Each chunk is encoded with offsets.  Two neighbours are spliced
at a position of their overlap where both start a token and that is provably stable: the
character before is not white space and the one there is.  No pre-token of the byte-level
pattern spans such a position, what stands before it does not depend on what follows, and what
follows does not depend on what stands before.  Texts with a pair of chunks that has no such
position go into another round with a wider overlap; at last one chunk is the whole text.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import store
from .tokens import ByteEncoder, encoder

CHUNK, OVERLAP, WIDEN = 32_768, 512, 8

# Not white space to any reading of "white space", then white space to every reading of it.
_STABLE = re.compile("(?<=[^\\s\x1c-\x1f\x85])(?=[ \\t\\n\\r])")


def _count_whole(file: str):
    def run(batches):
        enc = encoder(ByteEncoder, file)
        for b in batches:
            n = [len(enc.ids(t)) // 4 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])
    return run


def _stable(text: str, starts: list[int], low: int, high: int) -> tuple[list[int], list[int]]:
    """Stable positions in [low, high) where a token starts, and that token's index."""
    at, index = [], []
    for m in _STABLE.finditer(text, max(low, 1), high):
        i = bisect_left(starts, m.start())
        if i < len(starts) and starts[i] == m.start():
            at.append(m.start())
            index.append(i)
    return at, index


def _encode_chunks(file: str, overlap: int):
    def run(batches):
        tok = encoder(ByteEncoder, file).tok
        for b in batches:
            rows = []
            for start, last, text in zip(b.column("start").to_pylist(), b.column("last").to_pylist(),
                                         b.column("text").to_pylist()):
                starts = [o[0] for o in tok.encode(text, add_special_tokens=False).offsets]
                lp, li = _stable(text, starts, 0, overlap) if start else ([], [])
                rp, ri = ([], []) if last else _stable(text, starts, len(text) - overlap, len(text))
                rows.append((len(starts), [start + p for p in lp], li, [start + p for p in rp], ri))
            cols = list(zip(*rows)) if rows else [[]] * 5
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("row", "k", "last")] + [pa.array(cols[0], pa.int64())]
                + [pa.array(c, longs) for c in cols[1:]],
                ["row", "k", "last", "n", "left_at", "left_i", "right_at", "right_i"])
    return run


def _cut(chunk: int, overlap: int):
    def run(batches):
        for b in batches:
            for row, text in zip(b.column("row").to_pylist(), b.column("text").to_pylist()):
                m = max(1, -(-(len(text) - overlap) // chunk))
                for k in range(m):
                    last = k == m - 1
                    part = text[k * chunk:None if last else (k + 1) * chunk + overlap]
                    yield pa.RecordBatch.from_pydict({
                        "row": pa.array([row], pa.int64()), "k": pa.array([k], pa.int32()),
                        "start": pa.array([k * chunk], pa.int64()), "last": pa.array([last]),
                        "text": pa.array([part], pa.string())})
    return run


def chunk_rows(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, k, start, last, text): the overlapping chunks, one row each."""
    return docs.select("row", "text").mapInArrow(
        _cut(chunk, overlap), "row long, k int, start long, last boolean, text string")


def splice(encoded: DataFrame) -> DataFrame:
    """(row, n_tokens): the chunks of each row spliced; null where some pair does not align."""
    w = W.partitionBy("row").orderBy("k")
    pair = encoded.select("row", "k", "last", "n", "left_at", "left_i",
                          F.lag("right_at").over(w).alias("r_at"), F.lag("right_i").over(w).alias("r_i"))
    cut = F.array_min(F.array_intersect("r_at", "left_at"))
    there = lambda at, i: F.element_at(F.col(i), F.array_position(F.col(at), F.col("cut")).cast("int"))
    return (pair.withColumn("cut", cut)
            .select("row", F.when(F.col("k") > 0, F.col("cut").isNull()).otherwise(F.lit(False)).alias("bad"),
                    (F.when(F.col("cut").isNotNull(), there("r_at", "r_i") - there("left_at", "left_i"))
                     .otherwise(F.lit(0)) + F.when(F.col("last"), F.col("n")).otherwise(F.lit(0))).alias("part"))
            .groupBy("row").agg(F.when(~F.max("bad"), F.sum("part")).alias("n_tokens")))


def count_tokens(docs: DataFrame, file: str, limit: int = 1024, chunk: int = CHUNK,
                 overlap: int = OVERLAP, widen: int = WIDEN) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``; ``file`` is the path of a
    byte-level tokenizers file.

    A null or empty text has 0 bytes and 0 tokens.  A null doc_id is kept.  Repeated rows and
    repeated ids each give their own row.  An empty table gives no rows; other columns are ignored.
    """
    if not 0 < overlap < chunk:
        raise ValueError("overlap must be positive and below chunk")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"),
        F.char_length("text").cast("long").alias("n_chars"))
    kind = dict(base.dtypes)["doc_id"]
    short = (base.filter(F.col("n_chars") <= chunk).select("doc_id", "n_bytes", "text")
             .mapInArrow(_count_whole(file), f"doc_id {kind}, n_bytes long, n_tokens long"))
    # The id only ties the chunks of a row together again; it comes with the scan's partitions,
    # which a rerun task deals out alike.
    todo = store(base.filter(F.col("n_chars") > chunk)
                 .select(F.monotonically_increasing_id().alias("row"), "*"))
    done, size = [short], todo.count()
    while size:
        rows = chunk_rows(todo, chunk, overlap)
        encoded = rows.repartition("row", "k").mapInArrow(
            _encode_chunks(file, overlap),
            "row long, k int, last boolean, n long, left_at array<long>, left_i array<long>, "
            "right_at array<long>, right_i array<long>")
        counted = store(todo.drop("text").join(splice(encoded), "row"), 200)
        done.append(counted.filter(F.col("n_tokens").isNotNull()).select("doc_id", "n_bytes", "n_tokens"))
        todo = todo.join(counted.filter(F.col("n_tokens").isNull()).select("row"), "row", "left_semi")
        size, overlap = todo.count(), overlap * widen
        chunk = max(chunk, overlap * 2)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
