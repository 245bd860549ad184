"""Nested-document jobs (G3-G10): walk, type profile, validation, projection, merge,
subset, URL parameters.  Documents are VARIANT (parsed once) or map columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Column
from pyspark.sql import functions as F

from .documents import as_array, as_object, depth, document, drop_paths, keep_paths


_CONTAINER = r"^(OBJECT|ARRAY)\b"


def _kind(t: Column) -> Column:
    """Variant node kind: object / array / string / number / boolean / null, of the schema of a node."""
    return (F.when(t.isNull() | (t == "VOID"), "null")
             .when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array")
             .when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").otherwise("number"))


def _expanded(rows: DataFrame, folded: bool = False) -> DataFrame:
    """Rows (.., path, v, open) with the children of open nodes beside them: a node is open until its
    children stand next to it.  Nodes without children are closed at once."""
    place = "'[*]'" if folded else "'[' || e.pos || ']'"
    keep = [c for c in rows.columns if c not in ("path", "v", "open")]
    turns = rows.select(*keep, "path", "v", F.explode(
        F.when(F.col("open"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("down"))
    return turns.sparkSession.sql(
        f"""SELECT {''.join(f'c.{k}, ' for k in keep)}
                   CASE WHEN NOT c.down THEN c.path WHEN e.key IS NULL THEN c.path || {place}
                        ELSE c.path || '.' || e.key END AS path,
                   CASE WHEN c.down THEN e.value ELSE c.v END AS v, c.down AS open
            FROM {{turns}} c, LATERAL variant_explode_outer(CASE WHEN c.down THEN c.v END) AS e
            WHERE NOT c.down OR e.pos IS NOT NULL""", turns=turns)


_NODES = "array<struct<path:string,v:variant>>"


def _below(path: Column, v: Column, folded: bool) -> Column:
    """All nodes of a container, itself included, as an array of (path, v): a level a round, as many
    rounds as this one has levels."""
    def node(at: Column, value: Column) -> Column:
        return F.struct(at.alias("path"), value.alias("v"))

    def children(n: Column) -> Column:
        members = F.transform(F.map_entries(as_object(n["v"])), lambda e: node(
            F.concat(n["path"], F.lit("."), e["key"]), e["value"]))
        items = F.transform(as_array(n["v"]), lambda e, i: node(
            F.concat(n["path"], F.lit("[*]") if folded else F.concat(F.lit("["), i.cast("string"), F.lit("]"))), e))
        return F.coalesce(members, items, F.array().cast(_NODES))

    start = F.struct(F.array().cast(_NODES).alias("done"), F.array(node(path, v)).cast(_NODES).alias("level"))
    return F.aggregate(F.sequence(F.lit(1), depth(F.to_json(v))), start, lambda x, _: F.struct(
        F.concat(x["done"], x["level"]).alias("done"), F.flatten(F.transform(x["level"], children)).alias("level")),
        lambda x: F.concat(x["done"], x["level"]))


# Levels that are steps of the plan; what is nested deeper is taken apart where it is found.
_LEVELS = 4


def _nodes(df: DataFrame, json_col: str, *keep, folded: bool = False) -> DataFrame:
    """Every node of the documents, in one pass over them, however deep they are: the upper levels step by
    step, and what is still open below them by itself."""
    rows = df.select(*keep, F.lit("$").alias("path"), F.parse_json(F.col(json_col)).alias("v"), F.lit(True).alias("open"))
    for _ in range(_LEVELS):
        rows = _expanded(rows, folded)
    kept = [c for c in rows.columns if c not in ("path", "v", "open")]
    rest = F.when(F.col("open") & F.schema_of_variant("v").rlike(_CONTAINER), _below(F.col("path"), F.col("v"), folded))
    rows = rows.select(*kept, "path", "v", rest.alias("rest"))  # apart from the step below, which is compiled
    rows = rows.select(*kept, "path", "v", F.inline_outer("rest").alias("below", "w"))
    rows = rows.select(*kept, F.coalesce("below", "path").alias("path"),
                       F.when(F.col("below").isNull(), F.col("v")).otherwise(F.col("w")).alias("v"))
    # the schema of a node is worked out once, not for every kind it is held against
    return rows.withColumn("t", F.schema_of_variant("v")).withColumn("kind", _kind(F.col("t"))).drop("t")


def walk(df: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """One row per (document, path, node) for every node, the root included.
    Paths use the ``$.key[0]`` form.  All levels are taken apart in one pass over the documents, without
    a shuffle or a stored level."""
    nodes = _nodes(df, json_col, F.col(id_col).alias("id"))
    return nodes.select("id", "path", "kind", F.to_json(F.col("v")).alias("value"))


def type_profile(df: DataFrame, json_col: str) -> DataFrame:
    """Rows per (path, kind), with array indexes folded to ``[*]``.  Nodes are counted as they are
    reached."""
    return _nodes(df, json_col, folded=True).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("rows"))


# ---- G7 projection / redaction on map columns ----------------------------------------
def keys_keep(m, keys) -> Column:
    ks = F.array(*[F.lit(k) for k in keys])
    return F.map_filter(m, lambda k, v: F.array_contains(ks, k))


def keys_drop(m, keys) -> Column:
    ks = F.array(*[F.lit(k) for k in keys])
    return F.map_filter(m, lambda k, v: ~F.array_contains(ks, k))


def json_keep(json_col, paths) -> Column:
    """What of a JSON text stands at some paths, as JSON text; numbers stay numbers."""
    return F.to_json(keep_paths(document(json_col), paths))


def json_drop(json_col, paths) -> Column:
    """A JSON text without what stands at some paths."""
    return F.to_json(drop_paths(document(json_col), paths))


# ---- G8 deep merge, G9 subset ----------------------------------------------------------
def merge_maps(a, b) -> Column:
    """Right wins on shared keys (no duplicate-key error)."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def deep_merge(a, b) -> Column:
    """G8 for map<string, map<string, T>>: inner maps of shared keys are merged (right
    wins), other keys as in ``merge_maps``."""
    left_only = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    merged_b = F.transform_values(b, lambda k, v: F.when(F.map_contains_key(a, k),
                                                          merge_maps(F.element_at(a, k), v)).otherwise(v))
    return F.map_concat(left_only, merged_b)


def is_subset(sup, sub) -> Column:
    """Every entry of ``sub`` is in ``sup`` with an equal value."""
    return F.coalesce(F.forall(F.map_entries(sub), lambda e: F.coalesce(
        F.try_element_at(sup, e["key"]) == e["value"], F.lit(False))), F.lit(False))


# ---- G10 URL parameters ----------------------------------------------------------------
def url_params(df: DataFrame, url_col: str, id_col: str) -> DataFrame:
    """One row per (url, key, value) of the query string, URL-decoded; a key without
    '=' has an empty value."""
    q = F.regexp_extract(F.col(url_col), r"\?([^#]*)", 1)
    pairs = df.select(id_col, url_col, F.explode(F.split(q, "&")).alias("_kv")).filter(F.col("_kv") != "")
    k = F.split(F.col("_kv"), "=", 2)
    return pairs.select(id_col, url_col,
                        F.try_url_decode(F.element_at(k, 1)).alias("key"),
                        F.coalesce(F.try_url_decode(F.try_element_at(k, F.lit(2))), F.lit("")).alias("value"))


def url_key_counts(params: DataFrame) -> DataFrame:
    return params.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))


# ---- G5 type routing --------------------------------------------------------------------
def route_by_type(df: DataFrame, disc: str, lookup: dict, default: str) -> DataFrame:
    """Schema name per row chosen by a discriminator, default for the rest (the
    lookup is a small driver-side dict, so it becomes a CASE expression, no join)."""
    e = None
    for k, v in lookup.items():
        cond = F.lower(F.col(disc)) == F.lit(str(k).lower())
        e = F.when(cond, F.lit(v)) if e is None else e.when(cond, F.lit(v))
    return df.withColumn("schema", e.otherwise(F.lit(default)) if e is not None else F.lit(default))
