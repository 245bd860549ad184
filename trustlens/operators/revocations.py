"""Revocation set as a last-writer-wins table.

Whole-entry winner per credential: the largest (timestamp, issuer_did, reason)
struct.  ``max`` of a struct is commutative, associative and idempotent, so logs
from any number of replicas merge in any order and grouping (partial aggregation
map-side, one shuffle on credential_id).
"""

from __future__ import annotations

import logging

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = ("timestamp", "issuer_did", "reason")
KEY = "credential_id"


def _entry():
    return F.struct(*[F.col(c) for c in ENTRY])


def current_revocations(log: DataFrame) -> DataFrame:
    """Current state from a log of entries (LWW per credential)."""
    return (log.groupBy(KEY).agg(F.max(_entry()).alias("_w"))
               .select(KEY, *[F.col(f"_w.{c}").alias(c) for c in ENTRY]))


def merge_replicas(*logs: DataFrame) -> DataFrame:
    """Merge any number of replica logs or states."""
    cols = [KEY, *ENTRY]
    u = reduce(lambda a, b: a.unionByName(b), [lg.select(*cols) for lg in logs])
    return current_revocations(u)


apply_deltas = merge_replicas


def apply_revocations(state: DataFrame, changes: DataFrame):
    """Upsert changes into the state.  Returns (new_state, flags) where flags has one
    row per changed credential with ``is_new`` (absent before) and ``overwritten``
    (present and the change wins)."""
    new_state = merge_replicas(state, changes)
    ch = current_revocations(changes)
    old = state.select(KEY, _entry().alias("_old"))
    flags = (ch.join(old, KEY, "left")
               .select(KEY, F.col("_old").isNull().alias("is_new"),
                       (F.col("_old").isNotNull() & (_entry() > F.col("_old"))).alias("overwritten")))
    return new_state, flags


def check_revoked(creds: DataFrame, revs: DataFrame, how: str = "flag") -> DataFrame:
    """Flag (adds ``revoked``), keep revoked (left_semi) or keep valid (left_anti).

    The revocation side is deduplicated first; the physical join is left to AQE, which
    broadcasts it only when its measured size is under the broadcast threshold."""
    keys = revs.select(KEY).distinct()
    if how == "revoked":
        return creds.join(keys, KEY, "left_semi")
    if how == "valid":
        return creds.join(keys, KEY, "left_anti")
    if how != "flag":
        raise ValueError(how)
    return creds.join(keys.withColumn("revoked", F.lit(True)), KEY, "left").withColumn(
        "revoked", F.coalesce(F.col("revoked"), F.lit(False)))


def count_revoked(state: DataFrame) -> DataFrame:
    """R4."""
    return state.agg(F.count_distinct(KEY).alias("revoked"))


def changes_since(log: DataFrame, mark: int, seq: str = "seq") -> DataFrame:
    """Incremental change feed after a sequence mark."""
    return log.filter(F.col(seq) > F.lit(mark))


def state_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """R6 (state form): entries of ``new`` not identical in ``old``."""
    cols = [KEY, *ENTRY]
    return new.select(*cols).exceptAll(old.select(*cols))


def save_snapshot(state: DataFrame, path: str) -> None:
    state.write.mode("overwrite").parquet(path)


def load_snapshot(spark: SparkSession, path: str, log: DataFrame | None = None) -> DataFrame:
    """Bootstrap from a full snapshot, merged with any log entries seen since."""
    snap = spark.read.parquet(path)
    return merge_replicas(snap, log) if log is not None else current_revocations(snap)


_LOG = logging.getLogger(__name__)
# Error conditions of a snapshot that is not there or cannot be read.
_UNREADABLE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE",
               "UNRESOLVED_COLUMN", "is not a Parquet file")


def load_or_rebuild(spark: SparkSession, path: str, log: DataFrame) -> DataFrame:
    """A snapshot that is missing or unreadable means start empty and rebuild from the log; the
    reason is logged.  What is no fault of the snapshot (no permission, a lost cluster) is raised."""
    try:
        snap = spark.read.parquet(path)
        snap.select(KEY, *ENTRY).limit(1).collect()  # force the footer read
    except (PySparkException, Py4JJavaError) as e:
        why = next((x for x in _UNREADABLE if x in str(e)), None)
        if why is None:
            raise
        _LOG.warning("snapshot %s is rebuilt from the log: %s", path, why)
        return current_revocations(log)
    return merge_replicas(snap, log)


def convergence(log: DataFrame, replica: str = "replica") -> DataFrame:
    """Per pair of replicas: entries only in a, only in b, present in both but
    different, and a converged flag.  Counts per replica, and counts per pair over the
    credentials that both hold; what only one holds is the difference."""
    st = log.groupBy(F.col(replica).alias("r"), KEY).agg(F.max(_entry()).alias("e"))
    n = st.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    # a credential's replicas in one row: as many as there are replicas
    per = st.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("r", "e"))).alias("x"))
    pair = F.explode(F.flatten(F.transform("x", lambda a: F.transform(
        F.filter("x", lambda b: b["r"] > a["r"]), lambda b: F.struct(
            a["r"].alias("a"), b["r"].alias("b"), (a["e"] != b["e"]).cast("long").alias("d"))))))
    both = (per.select(pair.alias("p")).groupBy("p.a", "p.b")
            .agg(F.count(F.lit(1)).alias("both"), F.sum("p.d").alias("differing")))
    whole = n.agg(F.array_sort(F.collect_list(F.struct("r", "n"))).alias("x"))  # a row of replicas
    of = whole.select(F.explode(F.flatten(F.transform("x", lambda a: F.transform(
        F.filter("x", lambda b: b["r"] > a["r"]), lambda b: F.struct(
            a["r"].alias("a"), b["r"].alias("b"), a["n"].alias("na"), b["n"].alias("nb")))))).alias("p")).select("p.*")
    out = of.join(both, ["a", "b"], "left").na.fill(0, ["both", "differing"])
    only_a, only_b = F.col("na") - F.col("both"), F.col("nb") - F.col("both")
    return out.select(F.col("a").alias("replica_a"), F.col("b").alias("replica_b"), only_a.alias("only_a"),
                      only_b.alias("only_b"), "differing",
                      (only_a + only_b + F.col("differing") == 0).alias("converged"))


# ---- R12 set operations -------------------------------------------------------------
def set_of(arr):
    """Canonical set value: sorted distinct array."""
    return F.sort_array(F.array_distinct(arr))


def set_union(a, b):
    return set_of(F.array_union(a, b))


def set_intersection(a, b):
    return set_of(F.array_intersect(a, b))


def set_difference(a, b):
    return set_of(F.array_except(a, b))


def union_of_sets(sets):
    """Union of an array of sets (fold)."""
    return set_of(F.flatten(sets))


def intersection_of_sets(sets):
    """Intersection of an array of sets; empty input -> empty set."""
    first = F.coalesce(F.get(sets, F.lit(0)), F.array().cast("array<string>"))
    return set_of(F.aggregate(sets, first, lambda acc, s: F.array_intersect(acc, s)))
