import random

from trustlens.model import REVOCATION_SCHEMA
from trustlens.operators import revocations as RV

ROWS = [("cred-alpha", "did:x:issuer123", 1719300000, "compromised"),
        ("cred-beta", "did:x:issuer9", 1719300050, "lost"),
        ("cred-alpha", "did:x:issuer123", 1719300100, "rotated")]


def _state(df):
    return sorted(tuple(r) for r in df.select("credential_id", *RV.ENTRY).collect())


def test_order_idempotence_grouping(spark):
    base = _state(RV.current_revocations(spark.createDataFrame(ROWS, REVOCATION_SCHEMA)))
    for seed in range(3):
        rows = ROWS * 2
        random.Random(seed).shuffle(rows)
        parts = [spark.createDataFrame(rows[i::3], REVOCATION_SCHEMA) for i in range(3)]
        assert _state(RV.merge_replicas(*parts)) == base
    assert dict((r[0], r[3]) for r in base)["cred-alpha"] == "rotated"


def test_same_time_conflict_is_deterministic(spark):
    a = spark.createDataFrame([("c", "did:x:i", 1, "compromised by malware")], REVOCATION_SCHEMA)
    b = spark.createDataFrame([("c", "did:x:i", 1, "employee terminated")], REVOCATION_SCHEMA)
    assert _state(RV.merge_replicas(a, b)) == _state(RV.merge_replicas(b, a))
    assert _state(RV.merge_replicas(a, b))[0][3] == "employee terminated"


def test_apply_and_check(spark):
    st = RV.current_revocations(spark.createDataFrame(ROWS[:1], REVOCATION_SCHEMA))
    new, flags = RV.apply_revocations(st, spark.createDataFrame(ROWS[1:], REVOCATION_SCHEMA))
    f = {r.credential_id: (r.is_new, r.overwritten) for r in flags.collect()}
    assert f == {"cred-beta": (True, False), "cred-alpha": (False, True)}
    creds = spark.createDataFrame([("cred-alpha",), ("cred-zed",)], "credential_id string")
    flagged = {r.credential_id: r.revoked for r in RV.check_revoked(creds, new).collect()}
    assert flagged == {"cred-alpha": True, "cred-zed": False}
    assert RV.count_revoked(new).first()[0] == 2


def test_convergence(spark):
    log = spark.createDataFrame([("a", "i", 1, "r", 0), ("a", "i", 1, "r", 1), ("b", "i", 2, "r", 0)],
                                "credential_id string, issuer_did string, timestamp long, reason string, replica int")
    row = RV.convergence(log).first()
    assert (row.only_a, row.only_b, row.differing, row.converged) == (1, 0, 0, False)


def test_load_or_rebuild(spark, tmpdir_run):
    log = spark.createDataFrame(ROWS, REVOCATION_SCHEMA)
    got = RV.load_or_rebuild(spark, f"{tmpdir_run}/missing", log)
    assert len(_state(got)) == 2
