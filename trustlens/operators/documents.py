"""Whole documents as VARIANT: deep merge, projection and redaction by path, subset.

All of it is Column expressions over VARIANT, so documents are neither shuffled nor printed and
parsed again, and numbers, booleans and nulls stay what they are.  An object is taken apart as
``map<string, variant>``, rebuilt from the inside out, and put together by ``to_variant_object``.

Where the recursion follows the data (merge, subset) the expression is unrolled as deep as the
documents are.  That is measured (``depth``, one aggregate over the text), not assumed: no document
is cut short.  The plan grows by one level of expression for each level of nesting.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from ..functions.bind import bind

_MAP, _LIST = "map<string,variant>", "array<variant>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def document(json_text) -> Column:
    """JSON text as VARIANT; NULL for a NULL or for text that is no JSON."""
    return F.try_parse_json(_col(json_text))


def parsed(df: DataFrame, name: str) -> Column:
    """A column of JSON text as VARIANT; a VARIANT column as it is."""
    return F.col(name) if df.schema[name].dataType == VariantType() else document(name)


def as_object(v: Column) -> Column:
    """The members of an object; NULL for anything else."""
    return F.try_variant_get(v, "$", _MAP)


def as_array(v: Column) -> Column:
    """The items of an array; NULL for anything else."""
    return F.try_variant_get(v, "$", _LIST)


def depth(json_text) -> Column:
    """How deep the brackets of a JSON text are nested; 0 for a scalar."""
    bare = F.regexp_replace(_col(json_text), r'"(?:[^"\\]|\\.)*+"', "")
    brackets = F.regexp_replace(bare, r"[^\[\]{}]+", "")
    step = F.filter(F.split(brackets, ""), lambda c: c != "")
    return F.aggregate(
        step, F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")),
        lambda acc, c: bind(acc["at"] + F.when(c.isin("{", "["), 1).otherwise(-1), lambda at: F.struct(
            at.alias("at"), F.greatest(acc["most"], at).alias("most"))),
        lambda acc: acc["most"])


# Rounds of `depths` in one pass; deeper documents are measured by `depth`.
_ROUNDS = 12


def _brackets(json_text) -> Column:
    """The brackets of a JSON text outside of its texts, as ( and )."""
    bare = F.regexp_replace(F.regexp_replace(_col(json_text), r"(?s)\\.", ""), r'"[^"]*+"|[^\[\]{}"]+|"', "")
    return F.translate(bare, "[]{}", "()()")


def depths(df: DataFrame, *json_cols) -> list[int]:
    """The greatest depth of each of some text columns of a table, in one pass: each round takes the
    innermost pairs of brackets away."""
    n = range(len(json_cols))
    x = df.select(*[_brackets(c).alias(f"b{i}") for i, c in enumerate(json_cols)], *[F.lit(0).alias(f"d{i}") for i in n])
    pair = lambda i: F.contains(F.col(f"b{i}"), F.lit("()"))
    for _ in range(_ROUNDS):
        x = x.select(*[F.replace(f"b{i}", F.lit("()"), F.lit("")).alias(f"b{i}") for i in n],
                     *[(F.col(f"d{i}") + pair(i).cast("int")).alias(f"d{i}") for i in n])
    got = x.agg(*[F.max(f"d{i}") for i in n], *[F.max(pair(i)) for i in n]).first()
    if any(got[len(n):]):
        got = df.agg(*[F.max(depth(c)).alias(f"d{i}") for i, c in enumerate(json_cols)]).first()
    return [x or 0 for x in got[:len(n)]]


def deepest(df: DataFrame, *json_cols) -> int:
    """The greatest depth of some text columns of a table."""
    return max(depths(df, *json_cols) or [0])


# ---- G8 deep merge ----------------------------------------------------------------------
def merge_documents(a, b, levels: int) -> Column:
    """``b`` over ``a``.  Members of objects that both have are merged in turn, anything else
    of ``b`` takes the place of what ``a`` has (arrays as a whole, and a null too).  ``levels`` is how
    deep the shallower document is nested; a missing (SQL NULL) side leaves the other one."""
    a, b = _col(a), _col(b)
    if levels <= 0:
        return F.coalesce(b, a)

    def merged(x: Column) -> Column:
        both = F.map_zip_with(x["a"], x["b"], lambda k, l, r: merge_documents(l, r, levels - 1))
        return F.when(x["a"].isNotNull() & x["b"].isNotNull(), F.to_variant_object(both)).otherwise(F.coalesce(b, a))
    return bind(F.struct(as_object(a).alias("a"), as_object(b).alias("b")), merged)


def merge_json(df: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """G8 on two JSON text columns: ``out`` is the merged document as VARIANT."""
    levels = deepest(df, left, right)
    return df.withColumn(out, merge_documents(document(left), document(right), levels))


# ---- G7 projection and redaction by path --------------------------------------------------
def path_tree(paths: Iterable) -> dict:
    """A tree of path steps; a path is 'a/b/0' or a list of its steps.  The key None marks the end of
    a path."""
    root: dict = {}
    for p in paths:
        at = root
        for step in p.split("/") if isinstance(p, str) else p:
            if not isinstance(step, str):
                raise TypeError("the steps of a path are texts, those into arrays too")
            at = at.setdefault(step, {})
        at[None] = None
    return root


def _index(step: str) -> int | None:
    return int(step) if step.isascii() and step.isdigit() and (step == "0" or step[0] != "0") else None


def _object_of(entries: Column) -> Column:
    """An object of (key, value) structs, without those whose value is missing."""
    there = F.filter(entries, lambda e: e["value"].isNotNull())
    return F.to_variant_object(F.map_from_entries(there))


def _kept(v: Column, tree: dict) -> Column:
    steps = sorted(k for k in tree if k is not None)
    if not steps:
        return v
    at = [(_index(k), k) for k in steps]

    def keep(x: Column) -> Column:
        members = F.array(*[F.struct(F.lit(k).alias("key"), _kept(F.try_element_at(x["o"], F.lit(k)), tree[k])
                                     .alias("value")) for k in steps])
        items = [_kept(F.get(x["l"], F.lit(i)), tree[k]) for i, k in at if i is not None]
        some = F.filter(F.array(*items), lambda e: e.isNotNull()) if items else F.array().cast(_LIST)
        return (F.when(x["o"].isNotNull(), _object_of(members))
                .when(x["l"].isNotNull(), F.to_variant_object(some)))
    return bind(F.struct(as_object(v).alias("o"), as_array(v).alias("l")), keep)


def keep_paths(v, paths: Iterable) -> Column:
    """What of a document stands at some paths.

    A step into an array is its index; the items kept are in ascending order of the steps as texts.  What
    a path does not lead to is left out, as is a scalar where a path goes on.  A path that goes on beyond
    the end of another narrows it.  Without paths an object is empty.
    """
    tree = path_tree(paths)
    v = _col(v)
    return _kept(v, tree) if tree else F.when(v.isNotNull(), F.parse_json(F.lit("{}")))


def _dropped(v: Column, tree: dict) -> Column:
    if None in tree:
        return F.lit(None).cast("variant")
    steps = sorted(tree)
    if not steps:
        return v

    def changed(key: Column, value: Column) -> Column:
        out = None
        for k in steps:
            new = _dropped(value, tree[k])
            out = F.when(key == k, new) if out is None else out.when(key == k, new)
        return out.otherwise(value)

    def drop(x: Column) -> Column:
        members = F.transform(F.map_entries(x["o"]), lambda e: F.struct(
            e["key"].alias("key"), changed(e["key"], e["value"]).alias("value")))
        items = F.filter(F.transform(x["l"], lambda e, i: changed(i.cast("string"), e)), lambda e: e.isNotNull())
        return F.when(x["o"].isNotNull(), _object_of(members)).when(x["l"].isNotNull(), F.to_variant_object(items))
    return bind(F.struct(as_object(v).alias("o"), as_array(v).alias("l")), drop)


def drop_paths(v, paths: Iterable) -> Column:
    """A document without what stands at some paths; items behind a dropped one move up.  A scalar
    where a path goes on is dropped with it."""
    tree = path_tree(paths)
    return _dropped(_col(v), tree) if tree else _col(v)


# ---- G9 subset ------------------------------------------------------------------------------
def _number_equal(a: Column, b: Column) -> Column:
    """Equality of numbers by value, whatever they are written like; false for anything else."""
    exact = lambda v: F.try_variant_get(v, "$", "decimal(38,18)")
    wide = lambda v: F.try_variant_get(v, "$", "double")
    number = lambda v: ~F.schema_of_variant(v).isin("STRING", "BOOLEAN", "VOID")
    return number(b) & number(a) & F.coalesce(exact(a) == exact(b), wide(a) == wide(b), F.lit(False))


def _related(a: Column, b: Column, exact: Column, levels: int) -> Column:
    """Whether ``b`` is within ``a``, or, where ``exact`` holds, equal to it.  Items are compared for
    equality, so objects and arrays are one recursion: runs of pairs, all of one of which have to be
    related.  What prints alike is equal, its members being in order; only what does not is taken apart,
    ``a`` as what ``b`` is."""
    alike = F.to_json(a) == F.to_json(b)
    if levels <= 0:
        return F.coalesce(alike | _number_equal(a, b), F.lit(False))

    def members(x: Column) -> Column:
        return bind(as_object(x["a"]), lambda ao: F.when(
            F.when(x["exact"], F.size(ao) == F.size(x["bo"])).otherwise(ao.isNotNull()),
            F.array(F.transform(F.map_entries(x["bo"]), lambda e: F.struct(
                F.try_element_at(ao, e["key"]).alias("a"), e["value"].alias("b"))))))

    def items(x: Column) -> Column:
        m = F.size(x["bl"])

        def runs(al: Column) -> Column:
            last = F.size(al) - m
            starts = F.when(m == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last))
            return F.when(F.when(x["exact"], last == 0).otherwise(last >= 0), F.transform(
                starts, lambda s: F.arrays_zip(F.slice(al, s + 1, m).alias("a"), x["bl"].alias("b"))))
        return bind(as_array(x["a"]), runs)

    def related(x: Column) -> Column:
        arrays = x["bl"].isNotNull()
        runs = F.when(x["bo"].isNotNull(), members(x)).otherwise(items(x))
        found = F.exists(runs, lambda run: F.forall(run, lambda p: p["a"].isNotNull() & _related(
            p["a"], p["b"], x["exact"] | arrays, levels - 1)))
        return F.when(x["bo"].isNotNull() | arrays, found).otherwise(_number_equal(x["a"], x["b"]))
    parts = F.struct(a.alias("a"), b.alias("b"), as_object(b).alias("bo"), as_array(b).alias("bl"), exact.alias("exact"))
    return F.coalesce(F.when(alike, F.lit(True)).otherwise(bind(parts, related)), F.lit(False))


def same_document(a, b, levels: int) -> Column:
    """Whether two documents are equal: members in any order, items in theirs, numbers by value."""
    return _related(_col(a), _col(b), F.lit(True), levels)


def contains_document(sup, sub, levels: int) -> Column:
    """Whether ``sub`` is within ``sup``: of objects every member, in turn; an array as a run of
    equal items somewhere in the other; scalars when they are equal.  ``levels`` is how deep ``sub`` is
    nested.  A missing side is within nothing and holds nothing; an empty array is in any array."""
    return _related(_col(sup), _col(sub), F.lit(False), levels)


def subset_json(df: DataFrame, sup: str, sub: str, out: str, levels: int | None = None) -> DataFrame:
    """G9 on two columns of JSON text; or of documents, parsed once for many calls, with the ``levels``
    (``deepest``) of ``sub``."""
    levels = deepest(df, sub) if levels is None else levels
    return df.withColumn(out, contains_document(parsed(df, sup), parsed(df, sub), levels))
