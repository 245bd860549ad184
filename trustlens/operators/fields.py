"""Fields of resource documents by paths that are data (C13, C24): aliases, wildcards, dynamic names.

A path is text such as ``properties.rules[*].properties.access``, ``tags['Cost.Center']`` or
``identity.type``; it can come from a table or differ by row.  It is cut into steps, and one fold over
the steps leads from the document to a list of values: a name goes to a member (whatever its case),
``[*]`` to all items.  Missing members lead nowhere, so a wildcard path gives the values that are
there, in order, and an empty list where there are none.  VARIANT keeps the values' types.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import bind
from .documents import _col, as_array, as_object

_VALUES = "array<variant>"
# Alias tables of no more rows are broadcast.
BROADCAST_ALIASES = 50_000
_STEP = r"""\['([^']*)'\]|\["([^"]*)"\]|\[\*\]|\[([^\[\]'"*]+)\]|([^.\[\]]+)"""


def path_steps(path) -> Column:
    """The steps of a path: names in lower case, and ``[*]``."""
    found = F.regexp_extract_all(_col(path), F.lit(_STEP), F.lit(0))
    return F.transform(found, lambda s: F.when(s == "[*]", s).when(
        s.startswith("["), F.lower(F.regexp_replace(s, r"""^\[['"]?|['"]?\]$""", ""))).otherwise(F.lower(s)))


def member(v: Column, name: Column) -> Column:
    """An object's member of a lower-case name, whatever its own case; of several the first in order."""
    return bind(as_object(v), lambda m: F.coalesce(
        F.try_element_at(m, name),
        F.get(F.filter(F.map_entries(m), lambda e: F.lower(e["key"]) == name), F.lit(0))["value"]))


def _items(at: Column) -> Column:
    return F.flatten(F.transform(at, lambda v: F.coalesce(as_array(v), F.array().cast(_VALUES))))


def _named(at: Column, step: Column) -> Column:
    return F.filter(F.transform(at, lambda v: member(v, step)), lambda v: v.isNotNull())


def values_at(doc: Column, steps: Column) -> Column:
    """All values that the steps lead to, in order."""
    go = lambda at, step: F.when(step == "[*]", _items(at)).otherwise(_named(at, step))
    return F.aggregate(steps, F.filter(F.array(doc), lambda v: v.isNotNull()), go)


def _fixed_steps(path: str) -> list[str]:
    """``path_steps`` of a path that is a constant; the names in their own case."""
    found = [m.group(0) for m in re.finditer(_STEP, path)]
    return [re.sub(r"""^\[['"]?|['"]?\]$""", "", s) if s[0] == "[" and s != "[*]" else s for s in found]


def _fixed_values(doc: Column, steps: list[str]) -> Column:
    """``values_at`` of constant steps."""
    at = F.filter(F.array(doc), lambda v: v.isNotNull())
    for step in steps:
        at = _items(at) if step == "[*]" else _named(at, F.lower(F.lit(step)))
    return at


def _fixed_value(doc: Column, steps: list[str]) -> Column:
    for step in steps:
        doc = member(doc, F.lower(F.lit(step)))
    return doc


def _fixed_field(name: str, v: Column) -> Column:
    """``field_value`` of a constant name: the path is cut once, not for each row."""
    tag = re.match(r"^tags(?:\.(.+)|\[['\"]?(.+?)['\"]?\])$", name, re.ASCII | re.IGNORECASE)
    steps = ["tags", tag.group(1) or tag.group(2)] if tag else _fixed_steps(name)
    if name.lower() == "fullname":
        return F.coalesce(member(v, F.lit("fullname")), member(v, F.lit("name")))
    if "[*]" in steps:
        return F.to_variant_object(bind(_fixed_values(v, steps), lambda here: F.when(F.size(here) > 0, here).otherwise(
            _fixed_values(v, ["properties", *steps]))))
    return F.coalesce(_fixed_value(v, steps), _fixed_value(v, ["properties", *steps]))


def value_at(doc: Column, steps: Column) -> Column:
    """The value that the steps lead to; with a wildcard the list of all, as a VARIANT array."""
    return bind(F.struct(values_at(doc, steps).alias("v"), F.array_contains(steps, "[*]").alias("many")), lambda x: F.when(
        x["many"], F.to_variant_object(x["v"])).otherwise(F.get(x["v"], F.lit(0))))


def _same_version(api: Column, mine: Column) -> Column:
    return F.lower(api) == F.lower(mine)


def _of_type(aliases: DataFrame, *more: str) -> DataFrame:
    """One row per resource type: its aliases, with the steps of their paths (worked out once)."""
    if "api_version" not in aliases.columns:
        aliases = aliases.withColumn("api_version", F.lit(None).cast("string"))
    return aliases.groupBy(F.lower("type").alias("_type")).agg(F.sort_array(F.collect_list(F.struct(
        F.lower("alias").alias("alias"), F.col("api_version").alias("api"), path_steps("path").alias("steps"), *more))).alias("_a"))


def _with_type(df: DataFrame, aliases: DataFrame, gathered: DataFrame) -> DataFrame:
    """The rows with what their type has; broadcast where the aliases are counted to be few, as rows of
    few types would else meet in few tasks."""
    few = aliases.limit(BROADCAST_ALIASES + 1).count() <= BROADCAST_ALIASES
    return df.join(F.broadcast(gathered) if few else gathered, "_type", "left")


def _chosen(version: Column) -> Column:
    """Of each alias the path of the row's API version, else the one for all versions."""
    mine = F.concat(F.filter("_a", lambda a: _same_version(a["api"], version)), F.filter("_a", lambda a: a["api"].isNull()))
    return bind(mine, lambda xs: bind(F.transform(xs, lambda a: a["alias"]), lambda names: F.filter(
        xs, lambda a, i: F.array_position(names, a["alias"]) == i + 1)))


def alias_values(df: DataFrame, doc: str, aliases: DataFrame, type_col: Column, api_version: Column | None = None,
                 out: str = "aliases") -> DataFrame:
    """Adds ``out``, a map of lower-case alias names to VARIANT, of the aliases of the row's type.

    ``aliases``: (type, alias, path[, api_version]).  An alias may have a path for an API version and
    one for all others (api_version null).  A wildcard path gives an array.  What a path does not lead
    to is left out; rows of a type without aliases have an empty map, and a NULL document too.
    The alias table is gathered by type and joined once; it is broadcast where it is counted small.
    """
    version = api_version if api_version is not None else F.lit(None).cast("string")
    x = _with_type(df.withColumns({"_type": F.lower(type_col), "_v": version.cast("string")}), aliases, _of_type(aliases))
    found = F.transform(_chosen(F.col("_v")), lambda a: F.struct(
        a["alias"].alias("key"), value_at(F.col(doc), a["steps"]).alias("value")))
    there = F.filter(found, lambda e: e["value"].isNotNull())
    empty = F.create_map().cast("map<string,variant>")
    return x.withColumn(out, F.coalesce(F.map_from_entries(there), empty)).drop("_type", "_v", "_a")


def remap_elements(df: DataFrame, doc: str, aliases: DataFrame, type_col: Column, api_version: Column | None = None,
                   out: str = "elements") -> DataFrame:
    """Adds ``out``, a map from the array part of wildcard aliases (``rules`` of ``rules[*].access``) to
    the array of its elements as objects whose members have the aliases' names.

    An element keeps its own members, in lower case; what the aliases' paths lead to inside it is added
    under the aliases' names, and the member that a path of one step renames goes.  Aliases of one array
    with the same path before the wildcard share the elements; only the last wildcard of an alias is
    remapped, earlier ones are flattened.
    """
    wild = aliases.filter(F.col("alias").contains("[*].") & F.col("path").contains("[*]."))
    cut = lambda c, i: F.regexp_extract(c, r"^(.*\[\*\])\.(.*)$", i)
    parts = wild.select("type", F.col("api_version") if "api_version" in wild.columns else F.lit(None).cast("string").alias(
        "api_version"), F.regexp_replace(cut("alias", 1), r"\[\*\]$", "").alias("alias"), cut("alias", 2).alias("leaf"),
        cut("path", 1).alias("path"), cut("path", 2).alias("inner"))
    leaves = F.collect_list(F.struct(F.lower("leaf").alias("leaf"), path_steps("inner").alias("inner")))
    arrays = parts.groupBy("type", "api_version", "alias", "path").agg(F.sort_array(leaves).alias("leaves"))
    version = api_version if api_version is not None else F.lit(None).cast("string")
    x = _with_type(df.withColumns({"_type": F.lower(type_col), "_v": version.cast("string")}), wild, _of_type(arrays, "leaves"))

    def element(e: Column, leaves: Column) -> Column:
        own = F.transform(F.map_entries(as_object(e)), lambda m: F.struct(F.lower(m["key"]).alias("key"), m["value"].alias("value")))
        new = F.filter(F.transform(leaves, lambda f: F.struct(
            f["leaf"].alias("key"), F.get(values_at(e, f["inner"]), F.lit(0)).alias("value"))), lambda m: m["value"].isNotNull())
        gone = F.transform(F.filter(leaves, lambda f: F.size(f["inner"]) == 1), lambda f: F.get(f["inner"], F.lit(0)))
        return bind(new, lambda n: bind(F.transform(n, lambda m: m["key"]), lambda names: F.to_variant_object(
            F.map_from_entries(F.concat(F.filter(own, lambda m: ~F.array_contains(names, m["key"])
                                                 & ~F.array_contains(gone, m["key"])), n)))))
    found = F.transform(_chosen(F.col("_v")), lambda a: F.struct(a["alias"].alias("key"), F.to_variant_object(
        F.transform(F.filter(values_at(F.col(doc), a["steps"]), lambda e: as_object(e).isNotNull()),
                    lambda e: element(e, a["leaves"]))).alias("value")))
    empty = F.create_map().cast("map<string,variant>")
    return x.withColumn(out, F.coalesce(F.map_from_entries(found), empty)).drop("_type", "_v", "_a")


def field_value(name, doc, aliases=None) -> Column:
    """A policy's field as VARIANT; ``name`` is a text or a column of names (a dynamic field).

    Names have no case.  An alias comes first, where the map of ``alias_values`` is given.  ``type``, ``id``,
    ``kind``, ``name``, ``location``, ``apiVersion`` and ``identity[.x]`` are members of the document;
    ``fullName`` is that member, or the name; ``tags`` is the object of tags, ``tags.x``, ``tags[x]`` and
    ``tags['x']`` are one tag, whose name may hold dots.  Any other path is looked up in the document and
    then in its ``properties``.  A field that is not there is NULL.
    """
    v = _col(doc)
    if isinstance(name, str):
        found = _fixed_field(name, v)
        return found if aliases is None else F.coalesce(F.try_element_at(_col(aliases), F.lower(F.lit(name))), found)

    def of(n: Column) -> Column:
        tag = F.regexp_extract(n, r"^tags(?:\.(.+)|\[['\"]?(.+?)['\"]?\])$", 1)
        tag = F.when(tag != "", tag).otherwise(F.regexp_extract(n, r"^tags\[['\"]?(.+?)['\"]?\]$", 1))
        steps = F.when(tag != "", F.array(F.lit("tags"), tag)).otherwise(path_steps(n))
        plain = bind(steps, lambda s: bind(values_at(v, s), lambda here: F.when(
            F.array_contains(s, "[*]"), F.to_variant_object(F.when(F.size(here) > 0, here).otherwise(
                values_at(v, F.concat(F.array(F.lit("properties")), s))))).otherwise(F.coalesce(
                    F.get(here, F.lit(0)), F.get(values_at(v, F.concat(F.array(F.lit("properties")), s)), F.lit(0))))))
        full = F.when(n == "fullname", F.coalesce(member(v, F.lit("fullname")), member(v, F.lit("name")))).otherwise(plain)
        return full if aliases is None else F.coalesce(F.try_element_at(_col(aliases), n), full)
    return bind(F.lower(name), of)
