"""Queries over the revocation binding (orders as a replicated revocation log)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..operators import revocations as RV
from .bindings import REVOCATIONS_CTE, credential_probe, revocation_log
from .registry import query

LWW = f"""{REVOCATIONS_CTE},
cur AS (SELECT credential_id, timestamp, issuer_did, reason FROM (
  SELECT *, row_number() OVER (PARTITION BY credential_id ORDER BY timestamp DESC, issuer_did DESC, reason DESC) AS rn
  FROM revlog) WHERE rn = 1)"""


def _lww_sql(src: str, name: str) -> str:
    return f"""{name} AS (SELECT credential_id, timestamp, issuer_did, reason FROM (
  SELECT *, row_number() OVER (PARTITION BY credential_id ORDER BY timestamp DESC, issuer_did DESC, reason DESC) AS rn
  FROM {src}) WHERE rn = 1)"""


@query("current_revocations", "R3 R5", f"WITH {LWW} SELECT * FROM cur")
def current_revocations(spark, sf_dir):
    return RV.current_revocations(revocation_log(spark, sf_dir)).select(
        "credential_id", "timestamp", "issuer_did", "reason")


@query("merge_replicas", "R5 R7 R8", f"WITH {LWW} SELECT * FROM cur")
def merge_replicas(spark, sf_dir):
    log = revocation_log(spark, sf_dir)
    # one replica's state as a stored snapshot, merged with what all the others logged
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/revocations-{uuid.uuid4().hex}"
    RV.save_snapshot(RV.current_revocations(log.filter("replica = 0")), path)
    return RV.load_snapshot(spark, path, log.filter("replica <> 0")).select(
        "credential_id", "timestamp", "issuer_did", "reason")


@query("count_revoked", "R4", f"WITH {LWW} SELECT count(DISTINCT credential_id) AS revoked FROM cur")
def count_revoked(spark, sf_dir):
    return RV.count_revoked(RV.current_revocations(revocation_log(spark, sf_dir)))


@query("apply_revocations", "R1", f"""WITH {REVOCATIONS_CTE},
{_lww_sql("(SELECT * FROM revlog WHERE replica = 0)", "st")},
{_lww_sql("(SELECT * FROM revlog WHERE replica <> 0)", "ch")}
SELECT ch.credential_id, st.credential_id IS NULL AS is_new,
       st.credential_id IS NOT NULL AND (ch.timestamp, ch.issuer_did, ch.reason) > (st.timestamp, st.issuer_did, st.reason) AS overwritten
FROM ch LEFT JOIN st ON ch.credential_id = st.credential_id""")
def apply_revocations(spark, sf_dir):
    log = revocation_log(spark, sf_dir)
    st = RV.current_revocations(log.filter("replica = 0"))
    _, flags = RV.apply_revocations(st, log.filter("replica <> 0"))
    return flags


@query("apply_revocations_state", "R1", f"""WITH {REVOCATIONS_CTE},
{_lww_sql("revlog", "st")}
SELECT * FROM st""")
def apply_revocations_state(spark, sf_dir):
    log = revocation_log(spark, sf_dir)
    st = RV.current_revocations(log.filter("replica = 0"))
    new, _ = RV.apply_revocations(st, log.filter("replica <> 0"))
    return new.select("credential_id", "timestamp", "issuer_did", "reason")


@query("changes_since", "R6", f"""WITH {REVOCATIONS_CTE}
SELECT credential_id, timestamp, issuer_did, reason, seq FROM revlog WHERE seq > 10000""")
def changes_since(spark, sf_dir):
    return RV.changes_since(revocation_log(spark, sf_dir), 10000).select(
        "credential_id", "timestamp", "issuer_did", "reason", "seq")


@query("state_diff", "R6", f"""WITH {REVOCATIONS_CTE},
{_lww_sql("revlog", "new")},
{_lww_sql("(SELECT * FROM revlog WHERE seq <= 10000)", "old")}
SELECT * FROM new EXCEPT ALL SELECT * FROM old""")
def state_diff(spark, sf_dir):
    log = revocation_log(spark, sf_dir)
    return RV.state_diff(RV.current_revocations(log), RV.current_revocations(log.filter("seq <= 10000")))


def _probe_sql(kind: str) -> str:
    base = f"""WITH {REVOCATIONS_CTE},
p AS (SELECT 'cred-' || CAST(c_custkey AS VARCHAR) AS credential_id, c_name FROM customer),
k AS (SELECT DISTINCT credential_id FROM revlog)"""
    if kind == "flag":
        return base + """
SELECT p.credential_id, p.c_name, k.credential_id IS NOT NULL AS revoked FROM p LEFT JOIN k USING (credential_id)"""
    op = "" if kind == "revoked" else "NOT "
    return base + f"""
SELECT credential_id, c_name FROM p WHERE {op}EXISTS (SELECT 1 FROM k WHERE k.credential_id = p.credential_id)"""


def _probe(kind):
    def build(spark, sf_dir):
        revs = RV.current_revocations(revocation_log(spark, sf_dir))  # of all replicas
        return RV.check_revoked(credential_probe(spark, sf_dir), revs, kind)
    return build


for _k in ("flag", "revoked", "valid"):
    query(f"check_revoked_{_k}", "J1 R2", _probe_sql(_k))(_probe(_k))


@query("convergence", "R9", f"""WITH {REVOCATIONS_CTE},
st AS (SELECT credential_id, replica, max((timestamp, issuer_did, reason)) AS e FROM revlog GROUP BY ALL),
r AS (SELECT DISTINCT replica FROM revlog),
pairs AS (SELECT x.replica AS a, y.replica AS b FROM r x JOIN r y ON x.replica < y.replica),
j AS (SELECT p.a, p.b, x.e AS ea, y.e AS eb
      FROM pairs p, (SELECT DISTINCT credential_id FROM st) c
      LEFT JOIN st x ON x.credential_id = c.credential_id AND x.replica = p.a
      LEFT JOIN st y ON y.credential_id = c.credential_id AND y.replica = p.b)
SELECT CAST(a AS INTEGER) AS replica_a, CAST(b AS INTEGER) AS replica_b,
       count(*) FILTER (WHERE ea IS NOT NULL AND eb IS NULL) AS only_a,
       count(*) FILTER (WHERE ea IS NULL AND eb IS NOT NULL) AS only_b,
       count(*) FILTER (WHERE ea IS NOT NULL AND eb IS NOT NULL AND ea <> eb) AS differing,
       count(*) FILTER (WHERE (ea IS NULL) <> (eb IS NULL) OR ea <> eb) = 0 AS converged
FROM j GROUP BY ALL""")
def convergence(spark, sf_dir):
    return RV.convergence(revocation_log(spark, sf_dir))


@query("reason_sets", "R12", f"""WITH {REVOCATIONS_CTE},
s AS (SELECT credential_id,
             list_sort(list_distinct(list(reason) FILTER (WHERE replica = 0))) AS a,
             list_sort(list_distinct(list(reason) FILTER (WHERE replica <> 0))) AS b
      FROM revlog GROUP BY credential_id)
SELECT credential_id, list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) AS set_union,
       list_sort(list_intersect(coalesce(a, []), coalesce(b, []))) AS set_intersection,
       list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS set_difference
FROM s""")
def reason_sets(spark, sf_dir):
    log = revocation_log(spark, sf_dir)
    e = F.array().cast("array<string>")
    s = log.groupBy("credential_id").agg(
        F.coalesce(F.collect_set(F.when(F.col("replica") == 0, F.col("reason"))), e).alias("a"),
        F.coalesce(F.collect_set(F.when(F.col("replica") != 0, F.col("reason"))), e).alias("b"))
    return s.select("credential_id", RV.set_union("a", "b").alias("set_union"),
                    RV.set_intersection("a", "b").alias("set_intersection"),
                    RV.set_difference("a", "b").alias("set_difference"))


@query("replica_set_ops", "R12", f"""WITH {REVOCATIONS_CTE},
a AS (SELECT DISTINCT credential_id FROM revlog WHERE replica = 0),
b AS (SELECT DISTINCT credential_id FROM revlog WHERE replica <> 0)
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def replica_set_ops(spark, sf_dir):
    log = revocation_log(spark, sf_dir)
    a = log.filter("replica = 0").select("credential_id")
    b = log.filter("replica <> 0").select("credential_id")
    u = a.union(b).distinct().agg(F.count(F.lit(1)).alias("n")).withColumn("op", F.lit("union"))
    i = a.intersect(b).agg(F.count(F.lit(1)).alias("n")).withColumn("op", F.lit("intersect"))
    x = a.subtract(b).agg(F.count(F.lit(1)).alias("n")).withColumn("op", F.lit("except"))
    return u.unionByName(i).unionByName(x).select("op", "n")
