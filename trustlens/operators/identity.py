"""Identity-document jobs (I1-I5, J7) over a document table.

Document rows: id string, context array<string>, verification_method
array<struct<id, type, controller, publicKeyMultibase>>, plus any text column to scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Column
from pyspark.sql import functions as F

# The W3C DID v1 base context, and the seven substrings that mark
# private-key material in a serialized document.
DID_CONTEXT_V1 = "https://www.w3.org/ns/did/v1"
KEY_PATTERNS = ('"d":', "privateKey", "private_key", "secretKey", "secret_key", "signingKey", "signing_key")


def validity_error(prefix: str) -> Column:
    """I1 error per row, checked in this order: id prefix, base context, at least one
    verification method; NULL when valid."""
    return (F.when(~F.coalesce(F.startswith(F.col("id"), F.lit(prefix)), F.lit(False)), F.lit("invalid_id"))
             .when(~F.coalesce(F.array_contains(F.col("context"), DID_CONTEXT_V1), F.lit(False)), F.lit("missing_context"))
             .when(F.coalesce(F.size(F.col("verification_method")), F.lit(0)) <= 0, F.lit("no_verification_method")))


def audit_documents(df: DataFrame, prefix: str) -> DataFrame:
    """I1."""
    return df.withColumn("error", validity_error(prefix))


def key_leak_col(text: Column) -> Column:
    """First private-key pattern found in the text (NULL if none)."""
    e = None
    for p in KEY_PATTERNS:
        cond = F.contains(text, F.lit(p))
        e = F.when(cond, F.lit(p)) if e is None else e.when(cond, F.lit(p))
    return e


def key_leak_scan(df: DataFrame, text_col: str, patterns=KEY_PATTERNS) -> DataFrame:
    """Rows containing each pattern (one conditional count per pattern in a single
    aggregate over whole texts, then a small explode to long form)."""
    t = F.col(text_col)
    g = df.agg(*[F.count(F.when(F.contains(t, F.lit(p)), 1)).alias(f"_p{i}") for i, p in enumerate(patterns)])
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"_p{i}").alias("rows"))
                               for i, p in enumerate(patterns)]))
    return g.select(rows.alias("r")).select("r.*")


def admit_documents(df: DataFrame, prefix: str, text_col: str) -> DataFrame:
    """Key scan first, then validity; ``admitted`` and ``reason``."""
    leak = key_leak_col(F.col(text_col))
    reason = F.when(leak.isNotNull(), F.concat(F.lit("private_key_material:"), leak)).otherwise(validity_error(prefix))
    return df.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull())


def list_ids(df: DataFrame) -> DataFrame:
    """I4."""
    return df.select("id").distinct()


def delete_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """I4: registry without the given ids."""
    return df.join(ids.select("id").distinct(), "id", "left_anti")


def fingerprint(col) -> Column:
    """SHA-256 hex of the key material."""
    return F.sha2(F.col(col) if isinstance(col, str) else col, 256)


def resolve_ids(ids: DataFrame, docs: DataFrame, prefix: str) -> DataFrame:
    """Status per requested id: bad_id (wrong prefix), not_found, invalid (fails I1), ok."""
    status = (F.when(~F.coalesce(F.startswith(F.col("id"), F.lit(prefix)), F.lit(False)), F.lit("bad_id"))
               .when(F.col("_present").isNull(), F.lit("not_found"))
               .when(F.col("_err").isNotNull(), F.lit("invalid")).otherwise(F.lit("ok")))
    j = ids.select("id").join(docs.select("id", validity_error(prefix).alias("_err"),
                                          F.lit(True).alias("_present")), "id", "left")
    return j.select("id", status.alias("status"))
