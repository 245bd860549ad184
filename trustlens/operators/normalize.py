"""Resource normalisation and denormalisation (C24, C25) as bulk jobs.

A resource is JSON text.  Its fields become a map from lower-case names to VARIANT values, so
numbers, booleans and nested objects keep their types.  ``properties`` is lifted to the root
without overwriting root fields.  Aliases are gathered to one row per resource type, joined once
and resolved inside the row.  Denormalising puts fields back under ``properties`` and names back
into their original casing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_M = "map<string,variant>"
# The fields of a resource that are not properties.
ROOT_FIELDS = ("id", "name", "type", "location", "tags", "kind", "sku", "identity", "plan", "zones",
               "managedby", "extendedlocation", "apiversion", "fullname")


def _first_of_each(entries: Column) -> Column:
    """(key, value) entries with lower-case keys; of equal keys the first stays."""
    low = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    keys = F.transform(low, lambda e: e["key"])
    return F.filter(low, lambda e, i: F.array_position(keys, e["key"]) == i + 1)


def _entries(m: Column) -> Column:
    return F.coalesce(F.map_entries(m), F.map_entries(F.create_map().cast(_M)))


def normalize_resources(df: DataFrame, json_col: str, id_col: str, aliases: DataFrame | None = None,
                        api_version: Column | None = None) -> DataFrame:
    """Adds ``normalized`` (map of lower-case names to VARIANT, properties lifted) and, with an
    alias table (type, alias, path[, api_version]), ``aliases``: a map of alias values as text.  An
    alias has a path for an API version, or one for all others (api_version null); ``api_version``
    is the row's.  Text that is no JSON object gives an empty map."""
    raw = F.from_json(F.col(json_col), _M)
    x = df.withColumn("_e", _first_of_each(_entries(raw)))
    props = F.filter("_e", lambda e: e["key"] == "properties")
    inner = F.call_function("try_variant_get", F.try_element_at(props, F.lit(1))["value"], F.lit("$"), F.lit(_M))
    x = x.withColumn("_p", _entries(inner))
    lifted = _first_of_each(F.concat(F.filter("_e", lambda e: e["key"] != "properties"), F.col("_p")))
    out = x.withColumn("normalized", F.map_from_entries(lifted)).drop("_e", "_p")
    if aliases is None:
        return out
    if "api_version" not in aliases.columns:
        aliases = aliases.withColumn("api_version", F.lit(None).cast("string"))
    per_type = (aliases.groupBy(F.lower("type").alias("_type"))
                .agg(F.collect_list(F.struct("alias", F.col("api_version").alias("api"), "path")).alias("_a")))
    kind = F.lower(F.call_function("try_variant_get", F.try_element_at("normalized", F.lit("type")), F.lit("$"),
                                   F.lit("string")))
    doc = F.to_json("normalized")
    version = api_version if api_version is not None else F.lit(None).cast("string")
    out = out.withColumns({"_type": kind, "_doc": doc, "_v": version}).join(per_type, "_type", "left")
    # the path for the row's version comes first, the one for all others after it
    mine = F.concat(F.filter("_a", lambda a: a["api"] == F.col("_v")), F.filter("_a", lambda a: a["api"].isNull()))
    names = F.transform(mine, lambda a: a["alias"])
    chosen = F.filter(mine, lambda a, i: F.array_position(names, a["alias"]) == i + 1)
    values = F.transform(chosen, lambda a: F.struct(
        a["alias"].alias("key"), F.call_function("get_json_object", F.col("_doc"), a["path"]).alias("value")))
    return out.withColumn("aliases", F.map_from_entries(values)).drop("_type", "_doc", "_v", "_a")


def denormalize(df: DataFrame, map_col: str, casing: dict[str, str], root_fields=ROOT_FIELDS) -> DataFrame:
    """Adds ``denormalized``, the JSON of the raw shape: fields that are not root fields under
    ``properties``, names in the casing of the table (a small driver-side one), values as typed."""
    cmap = F.create_map(*[F.lit(x) for k, v in casing.items() for x in (k.lower(), v)])
    root = F.array(*[F.lit(f) for f in root_fields])

    def named(e):
        return F.struct(F.coalesce(F.try_element_at(cmap, e["key"]), e["key"]).alias("key"), e["value"].alias("value"))
    entries = F.map_entries(F.col(map_col))
    x = df.withColumns({"_r": F.transform(F.filter(entries, lambda e: F.array_contains(root, e["key"])), named),
                        "_p": F.transform(F.filter(entries, lambda e: ~F.array_contains(root, e["key"])), named)})
    props = F.struct(F.lit("properties").alias("key"),
                     F.parse_json(F.to_json(F.map_from_entries("_p"))).alias("value"))
    whole = F.when(F.size("_p") > 0, F.concat(F.col("_r"), F.array(props))).otherwise(F.col("_r"))
    return x.withColumn("denormalized", F.to_json(F.map_from_entries(whole))).drop("_r", "_p")
