"""Packed token ids: best-fit-decreasing with a segment tree over capacities.

Each task reads its share of the documents, turns them into token ids and cuts those longer than
a sequence into full pieces and a rest, without losing a token.  Pieces gather in a window of a
stated number of tokens; a full window is packed by best-fit-decreasing and written out, so a
task's memory does not grow with its input.  The open sequence with the least room that still
takes a piece is found in a segment tree over the possible amounts of room.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .tokens import ByteEncoder, RankEncoder, encoder

SEQUENCE, WINDOW_TOKENS = 2048, 4_000_000

def _schema(doc_id: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("sequence_id", T.LongType()), T.StructField("n_tokens", T.IntegerType()),
        T.StructField("ids", T.BinaryType()), T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
        T.StructField("position_resets", T.ArrayType(T.IntegerType())),
        T.StructField("doc_ids", T.ArrayType(doc_id)), T.StructField("starts", T.ArrayType(T.LongType()))])


class RoomTree:
    """How many open sequences have each amount of room, with a search for the least amount that
    is at least x.  A complete binary tree over 0..size; a node holds its leaves' total."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.total = [0] * (2 * self.leaves)

    def add(self, room: int, change: int) -> None:
        node = self.leaves + room
        while node:
            self.total[node] += change
            node >>= 1

    def least(self, x: int) -> int:
        """The least room >= x that some sequence has, or -1."""
        node = self.leaves + x
        if self.total[node]:
            return x
        while node > 1:
            if not node & 1 and self.total[node + 1]:  # a left child with something to its right
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.total[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Indexes of ``lengths`` (each 1..size) by sequence.  Equal lengths keep their order."""
    tree, at_room, out = RoomTree(size), {}, []
    for i in sorted(range(len(lengths)), key=lambda j: (-lengths[j], j)):
        room = tree.least(lengths[i])
        if room < 0:
            seq, left = len(out), size - lengths[i]
            out.append([i])
        else:
            seq, left = at_room[room].pop(), room - lengths[i]
            tree.add(room, -1)
            out[seq].append(i)
        if left:
            at_room.setdefault(left, []).append(seq)
            tree.add(left, 1)
    return out


def _pack(file: str, size: int, window: int, end_id: int, doc_id: pa.DataType, names: list[str]):
    end = np.array([end_id], dtype="<u4").tobytes()

    def flush(pieces, first):
        rows = []
        for n, seq in enumerate(best_fit_decreasing([len(p[2]) // 4 for p in pieces], size)):
            ids = b"".join(pieces[i][2] for i in seq)
            ends = np.cumsum([len(pieces[i][2]) // 4 for i in seq]).tolist()
            rows.append((first + n, len(ids) // 4, ids, [0, *ends], [0, *ends[:-1]],
                         [pieces[i][0] for i in seq], [pieces[i][1] for i in seq]))
        arrow = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()),
                 pa.list_(doc_id), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow)],
                                          names), len(rows)

    def run(batches):
        enc = encoder(RankEncoder if file.endswith(".tiktoken") else ByteEncoder, file)
        made, held, pieces = TaskContext.get().partitionId() << 32, 0, []
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = enc.ids(text or "") + end
                for at in range(0, len(ids), 4 * size):
                    pieces.append((doc, at // 4, ids[at:at + 4 * size]))
                    held += len(pieces[-1][2]) // 4
                    if held >= window:
                        out, n = flush(pieces, made)
                        yield out
                        made, held, pieces = made + n, 0, []
        if pieces:
            yield flush(pieces, made)[0]
    return run


def pack_token_ids(docs: DataFrame, file: str, size: int = SEQUENCE, window: int = WINDOW_TOKENS,
                   end_id: int = 50256) -> DataFrame:
    """Packed sequences of at most ``size`` ids: (sequence_id, n_tokens, ids, cu_seqlens,
    position_resets, doc_ids, starts).

    ``ids`` holds little-endian unsigned 32-bit ids, a row of the id matrix without padding.
    ``cu_seqlens`` are the cumulative segment lengths from 0; ``position_resets`` the places where
    positions start again at 0; ``doc_ids`` and ``starts`` say for each segment which document it
    is from and how many ids of it stand before, so that pieces join to the document again.
    Every document's ids are followed by ``end_id``.  ``file`` is a byte-level vocabulary, as a
    tokenizers file or as ranks.

    A null or empty text is the end id alone.  A null doc_id is kept as null; repeated rows are
    packed each; an empty table gives no sequences; other columns are ignored.
    """
    if size < 1 or window < size:
        raise ValueError("size must be positive and window at least size")
    kind = docs.schema["doc_id"].dataType
    schema = _schema(kind)
    return docs.select("doc_id", "text").mapInArrow(
        _pack(file, size, window, end_id, to_arrow_type(kind), schema.names), schema)


def id_matrix(packed: DataFrame, size: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """``packed`` with ``ids`` padded to rows of exactly ``size`` ids, ready for a fixed-width
    binary file; ``n_tokens`` says where the padding starts.  No rows give no rows; repeated rows and
    other columns stay as they are."""
    pad = np.array([pad_id], dtype="<u4").tobytes().hex()
    return packed.withColumn("ids", F.concat("ids", F.unhex(F.repeat(F.lit(pad), size - F.col("n_tokens")))))
