"""Chat formatting by cumulative-snapshot collapse.

A chat service logs a conversation again and again while it grows, so the log holds many
conversations that are prefixes of longer ones.  Each turn gets two 64-bit hashes of (turn
number, role, text); the running XOR over a conversation's turns is the hash of the prefix that
ends there.  A conversation whose whole-length hash occurs as a proper prefix hash of another is
dropped by an anti-join; of equal conversations the smallest id stays.  What is left is rendered.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .places import numbered

SLICE_TURNS = 256


def _turns(conv: DataFrame) -> DataFrame:
    return conv.select(
        F.col("conv_id").alias("c"), F.coalesce(F.col("turn"), F.lit(-1)).cast("long").alias("t"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"))


def prefix_hashes(conv: DataFrame, slice_turns: int = SLICE_TURNS) -> DataFrame:
    """(c, t, p1, p2, n, total): the hash of the turns up to t, how many turns that is, and how
    many the conversation has.

    A conversation is cut into slices of ``slice_turns`` turn numbers.  The running XOR is taken
    inside a slice and started from the XOR of the slices before it, so that one conversation
    that holds much of the table is spread over its slices.
    """
    h = (_turns(conv)
         .select("c", "t", F.xxhash64(F.lit(1), "t", "role", "text").alias("h1"),
                 F.xxhash64(F.lit(2), "t", "role", "text").alias("h2"))
         .groupBy("c", "t", "h1", "h2").agg(F.lit(1).alias("one")))  # a repeated row is one row
    per_turn = (h.groupBy("c", "t")
                .agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"),
                     F.count("*").alias("k"))
                .withColumn("s", F.floor(F.col("t") / slice_turns)))
    per_slice = per_turn.groupBy("c", "s").agg(
        F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"), F.sum("k").alias("m"))
    before = W.partitionBy("c").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    carry = per_slice.select(
        "c", "s", F.coalesce(F.bit_xor("y1").over(before), F.lit(0)).alias("b1"),
        F.coalesce(F.bit_xor("y2").over(before), F.lit(0)).alias("b2"),
        F.coalesce(F.sum("m").over(before), F.lit(0)).alias("bn"),
        F.sum("m").over(W.partitionBy("c")).alias("total"))
    run = W.partitionBy("c", "s").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    inside = per_turn.select(
        "c", "s", "t", F.bit_xor("x1").over(run).alias("r1"), F.bit_xor("x2").over(run).alias("r2"),
        F.sum("k").over(run).alias("rn"))
    same = [F.col("a.c").eqNullSafe(F.col("b.c")), F.col("a.s") == F.col("b.s")]
    return (inside.alias("a").join(carry.alias("b"), same)
            .select("a.c", "a.t", F.col("r1").bitwiseXOR(F.col("b1")).alias("p1"),
                    F.col("r2").bitwiseXOR(F.col("b2")).alias("p2"),
                    (F.col("rn") + F.col("bn")).alias("n"), "total"))


def maximal_conversations(conv: DataFrame, slice_turns: int = SLICE_TURNS) -> DataFrame:
    """(c, total): the conversations that no longer logged conversation starts with."""
    p = prefix_hashes(conv, slice_turns)
    # equal conversations first become one, combined before they are shuffled;
    # min() skips nulls, so the null id stands for a class only when the class has no other
    whole = p.filter(F.col("n") == F.col("total")).groupBy("p1", "p2", "n").agg(F.min("c").alias("c"))
    proper = p.filter(F.col("n") < F.col("total")).select("p1", "p2", "n").distinct()
    return (whole.join(proper, ["p1", "p2", "n"], "left_anti")
            .select("c", F.col("n").alias("total")))


def format_chats(conv: DataFrame, slice_turns: int = SLICE_TURNS) -> DataFrame:
    """Render the maximal conversations: (conv_id, part, n_turns, total_turns, rendered).

    ``part`` numbers, from 0, stretches of ``slice_turns`` turns in their order, so that a conversation
    of any length, also one whose turns all have the same number, is written in bounded rows; its parts
    in order are its rendering.

    Nulls: a null conv_id is one conversation like any other; a null turn counts as -1, a null
    role as 'unknown', a null text as ''.  Ties: rows of the same turn are one prefix step, and
    are rendered in order of (role, text).  Repeated rows count once.  An empty table gives no
    rows.  Other columns are ignored.
    """
    keep = maximal_conversations(conv, slice_turns)
    rows = _turns(conv).distinct()
    kept = (rows.alias("a").join(keep.alias("k"), F.col("a.c").eqNullSafe(F.col("k.c")))
            .select("a.c", "total", "t", "role", "text"))
    kept = numbered(kept, "c", [F.col("t"), F.col("role"), F.col("text")], "pos").withColumn(
        "part", F.floor(F.col("pos") / slice_turns))
    turns = F.array_sort(F.collect_list(F.struct("t", "role", "text")))
    one = lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), x["text"],
                             F.lit("<|im_end|>\n"))
    return (kept.groupBy("c", "part", "total").agg(turns.alias("turns"))
            .select(F.col("c").alias("conv_id"), "part",
                    F.size("turns").cast("long").alias("n_turns"),
                    F.col("total").alias("total_turns"),
                    F.concat_ws("", F.transform("turns", one)).alias("rendered")))
