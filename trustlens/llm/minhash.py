"""MinHash near-duplicates by a multi-index Hamming join.

A text's set of word shingles gets a signature of ``k`` min-wise hashes of ``bits`` bits.
Two sets with a Jaccard similarity of 0.8 differ in a fifth of the places on average; ``distance``
is so far above that a pair exceeds it with a probability below 1e-5 (96 places, 37).  The places
are split into ``distance // 2 + 1`` chunks: of a pair within the distance, some chunk then has at
most one place that differs (pigeonhole).  The one allowed error is enumerated by leaving each
place of a chunk out in turn, so a pair within the distance has an index key in common for
certain.  Links are confirmed on the full sets.

Documents with equal sets are one class, and classes are the nodes.  A key's nodes are not paired
with each other.  First each is compared with the least node of its key, which joins groups of
copies in one step.  Then only keys whose nodes are still in different components are looked at:
inside tasks, in blocks of bounded size, every pair across components is compared by signature,
only in the first key that it shares; nodes with a partner within the distance meet there again
with their full sets.  What leaves a task are links, at most one for each node of a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import compare_groups, in_blocks, local_roots, pair_mask
from .common import LONG_ROWS, free_name, store
from .components import connected_components
from .shingles import Signer, jaccard_at_least, shingle_set

PLACES, BITS, DISTANCE, PERCENT, BLOCK = 96, 16, 37, 80, 1024
WORDS = 2


# What is known of a node in a key whose nodes are in different components.
_OPEN = {"key": pa.int64(), "node": pa.int64(), "component": pa.int64(), "n": pa.int64(), "m": pa.int64(),
         "sig": pa.binary()}


def _chunks(k: int, distance: int) -> list[np.ndarray]:
    return np.array_split(np.arange(k), distance // 2 + 1)


def _signed(k: int, bits: int, words: int):
    def run(batches):
        signer = Signer(k, bits)
        for b in batches:
            n, cls, sig = [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, words)
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signer.sign(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("h"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()),
                 pa.array(sig, pa.binary())], ["doc_id", "h", "n_shingles", "cls", "sig"])
    return run


def _sets(words: int):
    """The sets of the documents, where they are what the class says."""
    def run(batches):
        for b in batches:
            node, sets = [], []
            for v, cls, text in zip(b.column("node").to_pylist(), b.column("cls").to_pylist(),
                                    b.column("text").to_pylist()):
                s = shingle_set(text, words)
                if xxhash.xxh3_128_digest(s.tobytes()) == cls:
                    node.append(v)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.binary())],
                                             ["node", "set"])
    return run


def _index_keys(k: int, distance: int):
    chunks = _chunks(k, distance)

    def run(batches):
        for b in batches:
            s = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype="<u2").reshape(-1, k).astype(np.uint64)
            keys = np.empty((len(s), k), dtype=np.uint64)
            for chunk in chunks:
                for out in chunk:
                    h = np.full(len(s), out, dtype=np.uint64)
                    for p in chunk[chunk != out]:
                        h = (h ^ s[:, p]) * np.uint64(0x9E3779B97F4A7C15)
                        h ^= h >> np.uint64(31)
                    # the place left out is told by the low bits, so that a task can read it
                    keys[:, out] = (h << np.uint64(16)) | np.uint64(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(b.column("node").to_numpy(), k))],
                ["key", "node"])
    return run


def _star_pairs(k: int, distance: int, percent: int):
    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype="<u2").reshape(-1, k)
                    for c in ("sig_a", "sig_b"))
            n, m = b.column("n_a").to_numpy(), b.column("n_b").to_numpy()
            ok = ((x != y).sum(axis=1) <= distance) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            yield b.select(["a", "b"]).filter(pa.array(ok))
    return run


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            ok = [jaccard_at_least(np.frombuffer(x.as_buffer(), dtype=np.uint64),
                                   np.frombuffer(y.as_buffer(), dtype=np.uint64), percent)
                  for x, y in zip(b.column("set_a"), b.column("set_b"))]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _across(t: pa.Table, first, k: int, distance: int, percent: int, chunks: list[np.ndarray]):
    """Pairs of the group in different components, within the distance, that share no earlier
    key: (i, j)."""
    comp, n, key = (t.column(c).to_numpy() for c in ("component", "n", "key"))
    mask = pair_mask(len(comp), first)
    mask &= comp[:, None] != comp[None, :]
    mask &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    i, j = np.nonzero(mask)
    if not len(i):
        return i, j
    s = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype="<u2").reshape(-1, k)
    out = int(key[0] & 0xFFFF)
    keep_i, keep_j = [], []
    bounds = np.array([c[0] for c in chunks])
    for at in range(0, len(i), 100_000):  # bounds the memory for what differs
        p, q = i[at:at + 100_000], j[at:at + 100_000]
        differs = s[p] != s[q]
        near = differs.sum(axis=1) <= distance
        p, q, differs = p[near], q[near], differs[near]
        errors = np.add.reduceat(differs, bounds, axis=1, dtype=np.int64)
        chunk = (errors <= 1).argmax(axis=1)  # the first with at most one place that differs
        in_it = np.zeros_like(differs)
        for c, places in enumerate(chunks):
            in_it[np.ix_(chunk == c, places)] = differs[np.ix_(chunk == c, places)]
        place = np.where(in_it.any(axis=1), in_it.argmax(axis=1), bounds[chunk])
        keep_i.append(p[place == out])
        keep_j.append(q[place == out])
    return np.concatenate(keep_i), np.concatenate(keep_j)


def _with_partner(k, distance, percent):
    chunks = _chunks(k, distance)

    def found(t, first):
        i, j = _across(t, first, k, distance, percent, chunks)
        at = pa.array(np.unique(np.concatenate([i, j])).astype(np.int64))
        return [t.column(c).take(at).combine_chunks() for c in _OPEN]
    return found


def _links(k, distance, percent):
    chunks = _chunks(k, distance)

    def found(t, first):
        i, j = _across(t, first, k, distance, percent, chunks)
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t.column("set")]
        ok = np.array([jaccard_at_least(sets[p], sets[q], percent) for p, q in zip(i, j)], dtype=bool)
        i, j = i[ok], j[ok]
        node, root = t.column("node").to_numpy(), local_roots(t.num_rows, i, j)
        at = np.flatnonzero(root != np.arange(len(root)))
        return [node[at], node[root[at]]]
    return found


def near_duplicate_components(docs: DataFrame, percent: int = PERCENT, places: int = PLACES,
                              bits: int = BITS, distance: int = DISTANCE, block: int = BLOCK,
                              words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``; shingles are of ``words`` words.

    A null or empty text, or one of white space only, has no shingles and links with nothing.  A
    text of fewer than ``words`` words is one shingle.  Repeated rows and equal texts are one class.  A null doc_id
    links like any other; it is a component's id only where the component has no other id.  Where
    several rows of a component carry its least id, all of them are ``kept``.  An empty table
    gives no rows; other columns are ignored.
    """
    base = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    kind = dict(base.dtypes)["doc_id"]
    signed = store(base.mapInArrow(_signed(places, bits, words),
                                   f"doc_id {kind}, h long, n_shingles long, cls binary, sig binary"), LONG_ROWS)
    # a class is known again by the id and the text's hash of one of its rows, one with an id if it has some
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    classes = store(signed.filter(F.col("cls").isNotNull()).groupBy("cls")
                    .agg(row.alias("row"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
                    .select("cls", F.col("row.doc_id").alias("least_id"), F.col("row.h").alias("least_h"), "n", "sig")
                    .withColumn("node", F.monotonically_increasing_id()))

    keys = classes.select("node", "sig").mapInArrow(_index_keys(places, distance), "key long, node long")
    shared = (keys.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("m"))
              .filter(F.col("m") > 1))
    members = store(keys.join(shared, "key"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        at = classes.join(nodes, "node", "left_semi").select("node", "cls", "least_id", "least_h")
        text = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
        same = text["doc_id"].eqNullSafe(at["least_id"]) & (text["h"] == at["least_h"])
        return store(text.join(at, same).select("node", "cls", "text")
                     .mapInArrow(_sets(words), "node long, set binary").dropDuplicates(["node"]), LONG_ROWS)

    sig = classes.select("node", "n", "sig")
    star = (members.filter(F.col("node") != F.col("centre"))
            .select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct())
    for end in ("a", "b"):
        star = star.join(sig.withColumnsRenamed({"node": end, "n": f"n_{end}", "sig": f"sig_{end}"}), end)
    star = store(star.mapInArrow(_star_pairs(places, distance, percent), "a long, b long"))
    sets = sets_of(star.select(F.col("a").alias("node")).unionByName(star.select(F.col("b").alias("node")))
                   .distinct())
    pairs = star
    for end in ("a", "b"):
        pairs = pairs.join(sets.withColumnsRenamed({"node": end, "set": f"set_{end}"}), end)
    links = store(pairs.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long"),
                  LONG_ROWS)
    parts = connected_components(links)

    placed = members.join(parts.withColumnRenamed("id", "node"), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    split = (placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                       F.count("*").alias("m"))
             .filter(F.col("lo") != F.col("hi")).select("key", "m"))
    open_ = placed.select("key", "node", "component").join(split, "key").join(sig, "node").select(*_OPEN)
    partner = store(compare_groups(
        in_blocks(open_, "key", "node", "m", block), "key", _with_partner(places, distance, percent),
        list(_OPEN), list(_OPEN.values()), open_.schema).dropDuplicates(["key", "node"]))
    again = partner.join(sets_of(partner.select("node").distinct()), "node")
    more = store(compare_groups(
        in_blocks(again, "key", "node", "m", block), "key", _links(places, distance, percent),
        ["a", "b"], [pa.int64()] * 2, "a long, b long"), LONG_ROWS)
    if more.limit(1).count():
        parts = connected_components(more.unionByName(
            parts.select(F.col("id").alias("a"), F.col("component").alias("b"))))

    of = classes.join(parts.withColumnRenamed("id", "node"), "node", "left").select(
        "cls", "least_id", F.coalesce("component", "node").alias("component"))
    least = of.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of = of.join(least, "component").select("cls", "component_id")
    return (signed.select("doc_id", "n_shingles", "cls").join(of, "cls", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
                    .alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, with all their columns: of each component one
    row with its least id.

    Rows without words (a null or empty text, or white space) all stay.  A null id stands before all
    others.  Of rows of one id the text's hash decides; of repeated rows one stays.  An empty table gives
    an empty table.
    """
    name = free_name(docs, "_h")
    d = docs.withColumn(name, F.xxhash64("text"))
    wordless = F.coalesce("text", F.lit("")).rlike(r"^[ \t\n\x0B\f\r]*$")
    worded = d.filter(~wordless)
    # the id of the pair (id, text) tells rows of one id with different texts apart
    at = worded.select(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", F.col(name).alias("h"))
                       .alias("doc_id"), "text")
    kept = (near_duplicate_components(at, percent, words=words).filter("kept")
            .select("doc_id.doc_id", "doc_id.h").distinct().alias("k"))
    w = worded.alias("w")
    on = F.col("w.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col(f"w.{name}") == F.col("k.h"))
    one = w.join(kept, on, "left_semi").dropDuplicates(["doc_id", name])
    return one.unionByName(d.filter(wordless)).drop(name)
