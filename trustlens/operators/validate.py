"""Schema validation of typed document columns (G4, G4a-G4h); ``json_schema`` has JSON text.

A JSON-schema subset (Python dict) is turned into Column expressions at plan time;
each row gets the first failing rule (code, path) in schema order, and
``error_counts`` gives rows per rule.  No per-row Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Column
from pyspark.sql import functions as F

_NUM = ("number", "integer")
# Schema type -> the Spark types whose values it takes (as the start of their names); the type of
# a column is known, so the test is a constant of the plan.
_TYPES = {"number": "tinyint|smallint|int|bigint|float|double|decimal", "boolean": "boolean", "string": "string|char|varchar",
          "array": "array", "object": "struct|map", "null": "void"}
_TYPES["integer"] = _TYPES["number"]


def _wrong_type(v: Column, t: str) -> Column:
    return v.isNotNull() & ~F.typeof(v).rlike(f"^({_TYPES[t]})")


def _fail_list(v: Column, s: dict, path: str) -> list[tuple[str, str, Column]]:
    """[(code, path, failing condition)] for value ``v`` against schema ``s``."""
    out: list[tuple[str, str, Column]] = []
    if "anyOf" in s:  # G4f: fails when every branch fails
        branches = [_any_fail(v, b, path) for b in s["anyOf"]]
        allf = branches[0]
        for b in branches[1:]:
            allf = allf & b
        out.append(("anyOf", path, allf))
    if "discriminator" in s:  # G4h: schema chosen by a discriminator field
        disc, variants = s["discriminator"], s["variants"]
        for key, sub in variants.items():
            for code, p, c in _fail_list(v, sub, path):
                out.append((code, p, (v[disc] == F.lit(key)) & c))
        out.append(("discriminator", f"{path}.{disc}", ~v[disc].isin(*variants.keys()) | v[disc].isNull()))
    t = s.get("type")
    present = v.isNotNull()
    if t == "null":
        out.append(("type", path, present))
    if t in _NUM:  # G4a
        num = v.cast("string").try_cast("double")
        out.append(("type", path, _wrong_type(v, t) | (present & num.isNull())))
        if t == "integer":
            out.append(("integer", path, present & (num != F.floor(num))))
        if "minimum" in s:
            out.append(("minimum", path, present & (num < F.lit(float(s["minimum"])))))
        if "maximum" in s:
            out.append(("maximum", path, present & (num > F.lit(float(s["maximum"])))))
    if t == "boolean":  # G4b
        out.append(("type", path, _wrong_type(v, t)))
    if t == "string":  # G4c
        sv = v.cast("string")
        out.append(("type", path, _wrong_type(v, t)))
        if "minLength" in s:
            out.append(("minLength", path, present & (F.length(sv) < s["minLength"])))
        if "maxLength" in s:
            out.append(("maxLength", path, present & (F.length(sv) > s["maxLength"])))
        if "pattern" in s:
            out.append(("pattern", path, present & ~sv.rlike(s["pattern"])))
    if t in ("array", "object"):
        out.append(("type", path, _wrong_type(v, t)))
    if t == "array":  # G4d
        if "minItems" in s:
            out.append(("minItems", path, present & (F.size(v) < s["minItems"])))
        if "maxItems" in s:
            out.append(("maxItems", path, present & (F.size(v) > s["maxItems"])))
        if "items" in s:
            for idx, (code, p, _) in enumerate(_fail_list(F.col("__probe__"), s["items"], f"{path}[*]")):
                out.append((code, p, F.coalesce(F.exists(v, _item_check(s["items"], f"{path}[*]", idx)),
                                                F.lit(False))))
    if t == "object":  # G4e
        props = s.get("properties", {})
        for r in s.get("required", []):
            out.append(("required", f"{path}.{r}", v[r].isNull()))
        if s.get("additionalProperties") is False and s.get("map"):
            allowed = F.array(*[F.lit(k) for k in props])
            out.append(("additionalProperties", path,
                        F.coalesce(F.size(F.array_except(F.map_keys(v), allowed)) > 0, F.lit(False))))
        for name, sub in props.items():
            child = F.try_element_at(v, F.lit(name)) if s.get("map") else v[name]
            out.extend(_fail_list(child, sub, f"{path}.{name}"))
    if "const" in s:  # G4g
        out.append(("const", path, present & (v != F.lit(s["const"]))))
    if "enum" in s:
        out.append(("enum", path, present & ~v.isin(*s["enum"])))
    return [(c, p, F.coalesce(x, F.lit(False))) for c, p, x in out]


def _item_check(items: dict, path: str, idx: int):
    def cond(e):
        return _fail_list(e, items, path)[idx][2]
    return cond


def _any_fail(v, s, path) -> Column:
    fl = _fail_list(v, s, path)
    if not fl:
        return F.lit(False)
    e = fl[0][2]
    for _, _, c in fl[1:]:
        e = e | c
    return e


def validate_rows(df: DataFrame, schema: dict, root: str | None = None) -> DataFrame:
    """Adds ``error_code`` and ``error_path`` (NULL when the row is valid).  ``root``
    names a struct/map column holding the document; without it the row itself is the
    document (properties are columns)."""
    if root is None:
        doc = F.struct(*[F.col(c) for c in df.columns])
    else:
        doc = F.col(root)
    fails = _fail_list(doc, schema, "$")
    code, path = None, None
    for c, p, cond in fails:
        code = F.when(cond, F.lit(c)) if code is None else code.when(cond, F.lit(c))
        path = F.when(cond, F.lit(p)) if path is None else path.when(cond, F.lit(p))
    return df.withColumn("error_code", code if code is not None else F.lit(None).cast("string")) \
             .withColumn("error_path", path if path is not None else F.lit(None).cast("string"))


def error_counts(validated: DataFrame) -> DataFrame:
    """Rows per first-failing rule."""
    return (validated.filter(F.col("error_code").isNotNull())
            .groupBy("error_code", "error_path").agg(F.count(F.lit(1)).alias("rows")))
