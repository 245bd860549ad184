"""Action-pattern matching and bulk access review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Column
from pyspark.sql import functions as F

from ..functions.conditions import action_matches


def _head(col: Column) -> Column:
    return F.element_at(F.split(col, "/"), 1)


def match_actions(requests: DataFrame, patterns: DataFrame, action: str = "action",
                  pattern: str = "pattern", extra_keys: list[str] | None = None) -> DataFrame:
    """Request x pattern pairs where the action matches the pattern.

    Equi key = (segment count, first segment); a pattern whose first segment is ``*``
    is keyed ``*`` and every request is keyed twice (its head and ``*``), so each
    matching pair meets exactly once and no nested-loop join is needed.  The residual
    segment test runs on the candidates only.  ``extra_keys`` (e.g. principal) are
    added to the equi key."""
    extra_keys = extra_keys or []
    p = patterns.withColumn("_n", F.size(F.split(F.col(pattern), "/"))) \
                .withColumn("_h", _head(F.col(pattern)))
    r = (requests.withColumn("_n", F.size(F.split(F.col(action), "/")))
                 .withColumn("_h", F.explode(F.array(_head(F.col(action)), F.lit("*")))))
    j = r.join(p, ["_n", "_h", *extra_keys], "inner")
    return j.filter(action_matches(F.col(action), F.col(pattern))).drop("_n", "_h")


def access_review(requests: DataFrame, assignments: DataFrame, conditions: dict[str, Column] | None = None,
                  request_id: str = "request_id", principal: str = "principal_id") -> DataFrame:
    """Requests x role assignments (principal, action pattern, scope, condition) ->
    granted flag, granting role (smallest role name among grants) and error flag.

    assignments(principal_id, role, pattern, scope, condition_id); ``conditions`` maps a
    condition id to a boolean Column over the joined row (NULL = type error).  Scope
    grants when the request scope equals it or lies under it."""
    conditions = conditions or {}
    # join strategy left to AQE: assignments are broadcast only when measured small
    cand = match_actions(requests, assignments, extra_keys=[principal])
    sc = F.col("scope")
    in_scope = (F.col("request_scope") == sc) | F.startswith(F.col("request_scope"), F.concat(F.rtrim(sc), F.lit("/"))) \
        | (sc == "/")
    cond = F.lit(True)
    if conditions:
        expr = None
        for cid, c in conditions.items():
            expr = F.when(F.col("condition_id") == cid, c) if expr is None else expr.when(F.col("condition_id") == cid, c)
        cond = F.when(F.col("condition_id").isNull(), F.lit(True)).otherwise(expr)
    x = cand.withColumn("_ok", in_scope & cond).withColumn("_err", in_scope & cond.isNull())
    g = x.groupBy(request_id).agg(
        F.bool_or(F.coalesce(F.col("_ok"), F.lit(False))).alias("granted"),
        F.min(F.when(F.coalesce(F.col("_ok"), F.lit(False)), F.col("role"))).alias("granting_role"),
        F.bool_or(F.col("_err")).alias("error"))
    # requests with no candidate assignment are reviewed too (not granted)
    return (requests.select(request_id).join(g, request_id, "left")
            .select(request_id, F.coalesce("granted", F.lit(False)).alias("granted"), "granting_role",
                    F.coalesce("error", F.lit(False)).alias("error")))
