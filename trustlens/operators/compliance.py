"""Resource-compliance evaluation over a resource table.

A policy is a Python object whose ``condition`` is a Column (built with
``functions.policy``).  ``evaluate`` runs every policy over the table in one scan:
one row-local explode of (policy, matched, effect) structs - no join per policy.
"""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field

from pyspark.sql import DataFrame, Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EFFECTS = ("deny", "audit", "denyaction", "manual", "disabled", "modify", "append",
           "auditifnotexists", "deployifnotexists")


@dataclass
class Param:
    """Reference to a policy parameter (C20)."""
    name: str


@dataclass
class Policy:
    name: str
    condition: Column
    effect: str | Param = "deny"
    resource_type: str | None = None           # J9: applies only to this type
    details: list = dc_field(default_factory=list)  # C22/C23 operations (op, field, value)
    defaults: dict = dc_field(default_factory=dict)  # parameter defaults


def resolve_effect(p: Policy, params: dict | None) -> str:
    """C20: effect from a parameter (assignment value, else the definition default)."""
    e = p.effect
    if isinstance(e, Param):
        e = (params or {}).get(e.name, p.defaults.get(e.name))
    if e is None:
        raise ValueError(f"policy {p.name}: effect parameter has no value")
    e = str(e).lower()
    if e not in EFFECTS:
        raise ValueError(f"policy {p.name}: unknown effect {e}")
    return e


def evaluate(resources: DataFrame, policies: list[Policy], params: dict | None = None,
             id_col: str = "id", type_col: str = "type") -> DataFrame:
    """One row per (resource, applicable policy): effect when matched (non-compliant),
    NULL when compliant.  Disabled policies produce no rows (folded away at plan time)."""
    entries = []
    for p in policies:
        eff = resolve_effect(p, params)
        if eff == "disabled":
            continue
        applies = F.lit(True) if p.resource_type is None else (F.lower(F.col(type_col)) == p.resource_type.lower())
        entries.append(F.struct(F.lit(p.name).alias("policy"), applies.alias("_applies"),
                                F.coalesce(p.condition, F.lit(False)).alias("_matched"),
                                F.lit(eff).alias("_effect")))
    if not entries:
        return resources.select(F.col(id_col), F.col(type_col), F.lit(None).cast("string").alias("policy"),
                                F.lit(None).cast("string").alias("effect"),
                                F.lit(None).cast("boolean").alias("compliant")).limit(0)
    x = resources.select(F.col(id_col), F.col(type_col), F.explode(F.array(*entries)).alias("_p"))
    x = x.filter(F.col("_p._applies"))
    return x.select(id_col, type_col, F.col("_p.policy").alias("policy"),
                    F.when(F.col("_p._matched"), F.col("_p._effect")).alias("effect"),
                    (~F.col("_p._matched")).alias("compliant"))


def if_not_exists(matched: DataFrame, related: DataFrame, on: list[str], cond: Column | None = None) -> DataFrame:
    """Rows of ``matched`` without a related row (meeting ``cond``).  The
    condition is applied to the related side before the anti join; related rows with a
    NULL key never satisfy (a null related resource is never compliant)."""
    r = related
    if cond is not None:
        r = r.filter(F.coalesce(cond, F.lit(False)))
    for k in on:
        r = r.filter(F.col(k).isNotNull())
    return matched.join(r.select(*on).distinct(), on, "left_anti")


def patch_rows(noncompliant: DataFrame, policy: Policy, id_col: str = "id") -> DataFrame:
    """The operation list of a modify/append policy for each non-compliant row
    (details as array<struct<operation, field, value>>; ``value`` required except remove)."""
    ops = []
    for op, fld, val in policy.details:
        op_l = op.lower()
        if op_l not in ("add", "addorreplace", "remove", "append"):
            raise ValueError(f"unknown operation {op}")
        if op_l != "remove" and val is None:
            raise ValueError(f"operation {op} on {fld} needs a value")
        ops.append(F.struct(F.lit(op_l).alias("operation"), F.lit(fld).alias("field"),
                            F.lit(None if val is None else str(val)).cast("string").alias("value")))
    return noncompliant.select(F.col(id_col), F.lit(policy.name).alias("policy"), F.array(*ops).alias("operations"))


def _typed(val, kind: T.DataType) -> Column:
    """The patch value in a field's type; a value that the type cannot hold is refused here, on
    the driver, instead of failing rows or turning into NULL."""
    if val is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.NumericType):
        try:
            float(val)
        except (TypeError, ValueError):
            raise ValueError(f"{val!r} does not fit a field of type {kind.simpleString()}") from None
    elif isinstance(kind, T.BooleanType) and str(val).lower() not in ("true", "false"):
        raise ValueError(f"{val!r} does not fit a boolean field")
    return F.lit(str(val)).cast(kind)


def _patched(c: Column | None, kind: T.DataType | None, op: str, val) -> Column:
    """A field after one operation; ``c`` is None for a field that is not there yet."""
    if isinstance(kind, T.ArrayType):
        if op == "append":
            return F.concat(F.coalesce(c, F.array().cast(kind)), F.array(_typed(val, kind.elementType)))
        return F.lit(None).cast(kind) if op == "remove" else F.array(_typed(val, kind.elementType))
    kind = kind or (T.ArrayType(T.StringType()) if op == "append" else T.StringType())
    if c is None:
        return F.array(F.lit(str(val))) if op == "append" else _typed(None if op == "remove" else val, kind)
    if op == "remove":
        return F.lit(None).cast(kind)
    return F.coalesce(c, _typed(val, kind)) if op == "add" else _typed(val, kind)


def apply_patches(resources: DataFrame, policy: Policy, where: Column | None = None) -> DataFrame:
    """C22/C23 applied to the table: tag operations via map functions (``tags['k']``; a missing
    tag map becomes one, tag names are case-insensitive), other fields by path (``a.b`` inside a
    struct), created where they are not there; rows outside ``where`` stay as they are."""
    # the condition is evaluated once, on the rows as they were before any operation
    out = resources.withColumn("_patch", F.coalesce(where, F.lit(False)) if where is not None else F.lit(True))
    cond = F.col("_patch")
    for op, fld, val in policy.details:
        op_l = op.lower()
        tag = fld[6:-2] if fld.lower().startswith("tags['") else None
        if tag is not None:
            t = F.col("tags")
            have = F.coalesce(t, F.create_map().cast("map<string,string>"))
            others = F.map_filter(have, lambda k, v: F.lower(k) != F.lit(tag.lower()))
            put = F.map_concat(others, F.create_map(F.lit(tag), F.lit(str(val))))
            if op_l == "remove":
                new = F.when(t.isNotNull(), others)
            elif op_l == "add":
                new = F.when(F.size(others) < F.size(have), t).otherwise(put)
            else:  # addOrReplace / append on a tag
                new = put
            out = out.withColumn("tags", F.when(cond, new).otherwise(t))
            continue
        head, *rest = fld.split(".")
        kinds = {f.name.lower(): f.dataType for f in out.schema.fields}
        kind = kinds.get(head.lower())
        if not rest:
            c = F.col(head) if kind is not None else None
            new = _patched(c, kind, op_l, val)
            out = out.withColumn(head, F.when(cond, new).otherwise(c) if c is not None else F.when(cond, new))
            continue
        inner, c = kind, F.col(head)
        for name in rest:  # the type at the end of the path, None where it is not there
            inner = ({f.name.lower(): f.dataType for f in inner.fields}.get(name.lower())
                     if isinstance(inner, T.StructType) else None)
        if not isinstance(kind, T.StructType):
            raise ValueError(f"{head} of {fld} is not a struct column")
        old = F.col(fld) if inner is not None else None
        new = _patched(old, inner, op_l, val)
        mine = F.when(cond, new).otherwise(old) if old is not None else F.when(cond, new)
        out = out.withColumn(head, F.coalesce(c, F.lit(None).cast(kind)).withField(".".join(rest), mine))
    return out.drop("_patch")


def effective_params(assignments: DataFrame, definitions: DataFrame) -> DataFrame:
    """Per assignment and parameter of its policy: the assignment's value, else the
    definition default.  definitions(policy, param, default_value); assignments(assignment,
    policy, param, value)."""
    scopes = assignments.select("assignment", "policy").distinct()
    grid = scopes.join(definitions, "policy", "inner")
    vals = assignments.select("assignment", "param", "value")
    return (grid.join(vals, ["assignment", "param"], "left")
                .select("assignment", "policy", "param",
                        F.coalesce(F.col("value"), F.col("default_value")).alias("value")))


def applicable(policies: DataFrame, resources: DataFrame, type_col: str = "type",
               any_type: str = "*") -> DataFrame:
    """(policy, resource) pairs where the policy's resource type matches; a policy typed
    ``*`` applies to every type.  Each resource is keyed twice (its type and ``*``) so this
    stays an equi join."""
    r = resources.withColumn("_k", F.explode(F.array(F.lower(F.col(type_col)), F.lit(any_type))))
    p = policies.withColumn("_k", F.lower(F.col("resource_type")))
    return r.join(p, "_k", "inner").drop("_k")


def compliance_report(results: DataFrame, type_col: str = "type") -> DataFrame:
    """Per policy and resource type: compliant / non-compliant counts and rate."""
    return (results.groupBy("policy", type_col).agg(
        F.count(F.when(F.col("compliant"), 1)).alias("compliant"),
        F.count(F.when(~F.col("compliant"), 1)).alias("non_compliant"))
        .withColumn("compliance_rate",
                    F.round(F.col("compliant") / (F.col("compliant") + F.col("non_compliant")), 6)))
