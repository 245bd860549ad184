"""The prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns, known by 128 bits of hash that a running XOR over a
conversation's steps gives for each of its depths.  Peeling starts at the greatest depth.  At each depth the
conversations that end there (equal ones combined) join the nodes that survive from below; what has
the same prefix is one node, whose members, children, leaves and saved tokens are sums over what met
in it.  Then its last turn is stripped, and it meets its siblings one depth higher.  A node is found
and has all its figures in the same step; nothing looks at the whole trie before.

Depths are taken in bands (0, 1], (1, 2], (2, 4], (4, 8] up to 256 wide.  In a band, a row whose
prefix at the band's top no other row has can meet nothing inside it: its turns are stripped in one
step, each giving a node.  Only rows that share that prefix are regrouped depth by depth.  So a
conversation's private turns cost a round for each band, not for each turn.  Groups are partial
aggregates: a prefix that a third of all conversations share is combined before it is shuffled.
"""

from __future__ import annotations

import hashlib
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import store
from .places import LARGE, by_range, numbered, split_by_size

WIDEST = 256  # depths in a band, at most
_LEVELS = WIDEST.bit_length() - 1  # the last band that is twice as wide as the one before
GROUP, HEAD = 20, 4  # a conversation may start with turns of the first of its group; fewer than HEAD


def _top(band: int) -> int:
    """The depth that the band lies below; it reaches to the next band's."""
    if band <= _LEVELS:
        return 1 << band - 1 if band else 0
    return WIDEST * (band - _LEVELS)


def _band(depth: Column) -> Column:
    return (F.when(depth <= 1, 0).when(depth <= WIDEST, F.length(F.bin(depth - 1)))
            .otherwise(_LEVELS + F.ceil((depth - WIDEST) / WIDEST))).cast("int")


def turns_in_order(conv: DataFrame, most: int = LARGE) -> DataFrame:
    """(c, pos, t1, t2, words): each turn's place in its conversation, two hashes, and its words."""
    rows = conv.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return numbered(rows, "c", order, "pos", most).select(
        "c", "pos", F.xxhash64(F.lit(1), "role", "text").alias("t1"), F.xxhash64(F.lit(2), "role", "text").alias("t2"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def as_logged(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, depth, t1, t2, words) of conversations as they are, and their ids (c)."""
    return turns.withColumn("depth", F.col("pos") + 1).drop("pos"), turns.select("c").distinct()


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of conversations that share beginnings: c starts with the first h turns of c - c % 20,
    h = crc32(c) % 4, and goes on with its own from the (h+1)-th."""
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % HEAD).cast("long")
    first = F.col("c") - F.col("c") % GROUP
    ids = turns.select("c").distinct()
    heads = turns.filter((F.col("c") % GROUP == 0) & (F.col("pos") < HEAD - 1)).withColumnRenamed("c", "f")
    begin = (ids.withColumn("f", first).join(heads, "f").filter(F.col("pos") < h)
             .select("c", (F.col("pos") + 1).alias("depth"), "t1", "t2", "words"))
    there = heads.groupBy("f").agg(F.count("*").alias("m"))
    shift = (ids.withColumn("f", first).join(there, "f", "left")
             .select("c", F.least(F.coalesce("m", F.lit(0)), h).alias("k")))
    own = (turns.filter(F.col("pos") >= h).join(shift, "c")
           .select("c", (F.col("k") + F.col("pos") - h + 1).alias("depth"), "t1", "t2", "words"))
    return begin.unionByName(own), ids


def _steps(turns: DataFrame) -> DataFrame:
    """(c, band, b1, b2, steps): for each band of a conversation the hash of the prefix above it, and
    for each depth the hash of the prefix and the band's words so far."""
    rows = turns.select("c", "depth", _band(F.col("depth")).alias("band"),
                        F.xxhash64(F.lit(1), "depth", "t1", "t2").alias("g1"),
                        F.xxhash64(F.lit(2), "depth", "t1", "t2").alias("g2"), "words")
    run = W.partitionBy("c", "band").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("c", "band", "depth", F.bit_xor("g1").over(run).alias("p1"),
                       F.bit_xor("g2").over(run).alias("p2"), F.sum("words").over(run).alias("w"))
    bands = rows.groupBy("c", "band").agg(
        F.sort_array(F.collect_list(F.struct("depth", "p1", "p2", "w"))).alias("steps"))
    last = F.element_at("steps", -1)
    before = W.partitionBy("c").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    bands = bands.withColumn("x1", last["p1"]).withColumn("x2", last["p2"])
    for b, x in (("b1", "x1"), ("b2", "x2")):
        bands = bands.withColumn(b, F.coalesce(F.bit_xor(x).over(before), F.lit(0)))
    return bands.select("c", "band", "b1", "b2", F.transform("steps", lambda s: F.struct(
        s["depth"].alias("depth"), s["p1"].bitwiseXOR(F.col("b1")).alias("p1"),
        s["p2"].bitwiseXOR(F.col("b2")).alias("p2"), s["w"].alias("w"))).alias("steps"))


def _hash_chunks(batches):
    """One hash over a group's chunks, in order."""
    rows = (r for b in batches for r in zip(*(b.column(x).to_pylist() for x in ("p1", "p2", "depth", "ids"))))
    for key, chunks in groupby(rows, itemgetter(0, 1, 2)):
        sha, some = hashlib.sha256(), False
        for *_, ids in chunks:
            sha.update(("," * some + ids).encode())
            some = True
        yield pa.RecordBatch.from_pydict({
            **{n: pa.array([x], pa.int64()) for n, x in zip(("p1", "p2", "depth"), key)},
            "ends_sha256": pa.array([sha.hexdigest()])})


def _classes(ended: DataFrame, most: int) -> DataFrame:
    """(p1, p2, depth, r, n, ends_sha256): equal conversations; ``ended`` is (c, p1, p2, depth)."""
    key = ["p1", "p2", "depth"]
    ended = ended.select("c", *key, F.struct(*key).alias("k"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",")
    sizes = [F.min("c").alias("r"), F.count("*").alias("n")]
    small, large = split_by_size(ended, "k", most)
    out = small.groupBy(*key).agg(*sizes, F.sha2(joined, 256).alias("ends_sha256"))
    if large is None:
        return out
    placed = by_range(large, "k", [F.col("c")], "pos").withColumn("chunk", F.floor(F.col("pos") / most))
    chunks = placed.groupBy(*key, "chunk").agg(joined.alias("ids"))
    hashed = (chunks.repartition(*key).sortWithinPartitions(*key, "chunk")
              .mapInArrow(_hash_chunks, "p1 long, p2 long, depth long, ends_sha256 string"))
    sums = large.groupBy(*key).agg(*sizes)
    return out.unionByName(sums.join(hashed, key).select(*out.columns))


_STATE = ["r", "n", "kids", "leaves", "saved"]  # of a row on its way up: kids are nodes right below
_NODE = ["p1", "p2", "q1", "q2", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "up"]


def _all_leaves() -> Column:
    return F.when(F.col("kids") == 0, 1).otherwise(F.col("leaves")).cast("long")


def _private(rows: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of rows that meet nothing in the band, and what goes on at its top."""
    at = lambda d: F.get("steps", d - top - 1)
    words = lambda d: F.coalesce(at(d)["w"], F.lit(0))  # noqa: E731  (none above the band)
    saved = lambda d: F.col("saved") + (F.col("n") - 1) * (words(F.col("start")) - words(d - 1))
    d = F.col("d")
    nodes = rows.withColumn("d", F.explode(F.sequence(F.lit(top + 1).cast("long"), F.col("start")))).select(
        at(d)["p1"].alias("p1"), at(d)["p2"].alias("p2"),
        F.coalesce(at(d - 1)["p1"], "b1").alias("q1"), F.coalesce(at(d - 1)["p2"], "b2").alias("q2"),
        d.alias("depth"), F.col("r").alias("conv_id"), F.col("n").alias("n_convs"),
        F.when(d == F.col("start"), F.col("kids")).otherwise(1).cast("long").alias("n_children"),
        _all_leaves().alias("n_leaves"), saved(d).alias("saved_tokens"),
        F.when(d > top + 1, F.col("r")).alias("up"))
    on = rows.select("r", "n", F.lit(1).cast("long").alias("kids"), _all_leaves().alias("leaves"),
                     saved(F.lit(top + 1)).alias("saved"))
    return nodes, on


def _peel_depth(rows: DataFrame, depth: int, top: int) -> DataFrame:
    """The rows that are at this depth, regrouped by their prefix."""
    step = F.get("steps", F.lit(depth - top - 1))
    met = rows.groupBy(step["p1"].alias("p1"), step["p2"].alias("p2")).agg(
        F.min("r").alias("r"), F.sum("n").alias("n"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"), F.min("b1").alias("b1"), F.min("b2").alias("b2"),
        F.min_by("steps", "r").alias("steps"))
    above = F.get("steps", F.lit(depth - top - 2))
    words = step["w"] - F.coalesce(above["w"], F.lit(0))
    return met.select(
        "p1", "p2", "r", "n", "kids", _all_leaves().alias("leaves"),
        (F.col("saved") + (F.col("n") - 1) * words).alias("saved"), "b1", "b2", "steps",
        F.coalesce(above["p1"], "b1").alias("q1") if depth > top + 1 else F.col("b1").alias("q1"),
        F.coalesce(above["p2"], "b2").alias("q2") if depth > top + 1 else F.col("b2").alias("q2"))


def _as_nodes(met: DataFrame, depth: int) -> DataFrame:
    return met.select("p1", "p2", "q1", "q2", F.lit(depth).cast("long").alias("depth"), F.col("r").alias("conv_id"),
                      F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
                      F.col("saved").alias("saved_tokens"), F.lit(None).cast("long").alias("up"))


def _peel_band(rows: DataFrame, top: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes of the band below ``top``, and what goes on at its top.  ``rows``: (start, b1, b2, steps)
    and a state each."""
    nodes, on = [], None
    lowest = rows.agg(F.max("start")).first()[0]
    head = F.get("steps", F.lit(0))
    keyed = rows.select("*", head["p1"].alias("h1"), head["p2"].alias("h2"))
    shared = store(keyed.groupBy("h1", "h2").agg(F.count("*").alias("m")).filter(F.col("m") > 1).drop("m"))
    single = keyed
    if shared.limit(1).count():
        together = store(keyed.join(shared, ["h1", "h2"], "left_semi").drop("h1", "h2"))
        single = keyed.join(shared, ["h1", "h2"], "left_anti")
        met = None
        for depth in range(together.agg(F.max("start")).first()[0], top, -1):
            here = together.filter(F.col("start") == depth).drop("start")
            if met is not None:
                here = here.unionByName(met.select(
                    "r", "n", F.lit(1).cast("long").alias("kids"), "leaves", "saved", "b1", "b2", "steps"))
            met = store(_peel_depth(here, depth, top))
            nodes.append(_as_nodes(met, depth))
        on = met.select("r", "n", F.lit(1).cast("long").alias("kids"), "leaves", "saved")
    if lowest is not None:
        private, alone = _private(single, top)
        nodes.append(private)
        on = alone if on is None else on.unionByName(alone)
    return nodes, on


def prefix_trie(turns: DataFrame, ids: DataFrame, most: int = LARGE) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for
    each node of the trie of ``turns`` (as of ``as_logged`` or ``rebuilt``) of the conversations ``ids``.

    conv_id is the node's smallest member, n_leaves counts the childless nodes of its subtree, saved_tokens
    adds up over the subtree the words of a node's last turn for each member but one, ends_sha256 is the hash
    of the ids that end at the node.  A conversation without turns ends at the root.  Groups of equal
    conversations of more than ``most`` are hashed in chunks.

    Nulls: a null role or text is the empty text, a null turn stands first; rows without a conv_id
    belong to no conversation and are left out.  Ties: rows of the same turn stand in the order of role and
    text.  Repeated rows are turns of their own.  Very long texts only pass through hashes and a count.
    No conversations give no rows, not even a root.  Other columns are ignored.
    """
    steps = store(_steps(turns).sortWithinPartitions("band"))
    last = F.max_by(F.element_at("steps", -1), "band")
    ended = steps.groupBy("c").agg(last.alias("s")).select("c", "s.p1", "s.p2", "s.depth")
    zero = F.lit(0).cast("long")
    ended = ids.join(ended, "c", "left").select("c", *(F.coalesce(x, zero).alias(x) for x in ("p1", "p2", "depth")))
    classes = store(_classes(ended, most).withColumn("band", F.when(F.col("depth") > 0, _band(F.col("depth")))))

    nodes, on = [], None
    deepest = classes.agg(F.max("band")).first()[0]
    for band in range(-1 if deepest is None else deepest, -1, -1):
        top, bottom = _top(band), _top(band + 1)
        rows = classes.filter(F.col("band") == band).select(
            "r", "n", zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"), F.col("depth").alias("start"))
        if on is not None:
            rows = rows.unionByName(on.withColumn("start", F.lit(bottom).cast("long")))
        here = steps.filter(F.col("band") == band).select(F.col("c").alias("r"), "b1", "b2", "steps")
        found, on = _peel_band(store(rows.join(here, "r")), top)
        nodes += found
        on = store(on)
    at_root = classes.filter(F.col("depth") == 0).select("r", "n", zero.alias("kids"), zero.alias("leaves"),
                                                         zero.alias("saved"))
    on = at_root if on is None else on.unionByName(at_root)
    root = store(on.agg(F.min("r").alias("r"), F.sum("n").alias("n"), F.sum("kids").alias("kids"),
                        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
                 .filter(F.col("n") > 0).select(
                     zero.alias("p1"), zero.alias("p2"), zero.alias("q1"), zero.alias("q2"),
                     F.col("r"), "n", "kids", _all_leaves().alias("leaves"), "saved"))
    found = _as_nodes(root, 0)
    for part in nodes:
        found = found.unionByName(part)
    found = store(found)
    # the parents of nodes that are not their smallest member's own; those right below the root are known
    smallest = root.agg(F.min("r")).first()[0]
    known = F.when(F.col("depth") == 1, F.lit(smallest).cast("long")).otherwise(F.col("up"))
    done = found.withColumn("up", known)
    open_ = done.filter((F.col("depth") > 1) & F.col("up").isNull()).drop("up")
    parents = found.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), (F.col("depth") + 1).alias("depth"),
                           F.col("conv_id").alias("up"))
    named = done.filter((F.col("depth") <= 1) | F.col("up").isNotNull()).select(*_NODE).unionByName(
        open_.join(parents, ["q1", "q2", "depth"]).select(*_NODE))
    ends = classes.select("p1", "p2", "depth", "ends_sha256")
    return named.join(ends, ["p1", "p2", "depth"], "left").select(
        "conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
