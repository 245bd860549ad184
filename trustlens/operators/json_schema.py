"""Schema validation of JSON text (G4, G4a-G4h): a schema becomes type-aware checks over VARIANT.

A schema is a dict: ``type`` any, integer, number, boolean, null, string, array, set or object, with
``minimum``/``maximum``, ``minLength``/``maxLength`` (in UTF-8 bytes)/``pattern``, ``items``/``minItems``/
``maxItems``, ``properties``/``required``/``additionalProperties`` (allowed unless False; or a schema);
or ``anyOf``, ``const``, ``enum``.  An object may have ``discriminator`` (a member's name) and
``variants`` (its value -> ``properties``, ``required``, ``additionalProperties``).

Each row gets its first error: the type before its bounds, required members before members, members
in the order of their names, items in theirs.  The expression is as large as the schema, whatever the
documents are; nothing runs in Python.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from ..functions.bind import bind
from .documents import document, same_document

_ERROR = "struct<code:string,path:string>"
# an object's members, its names alone, and an array's items; NULL for anything else
_MAP, _KEYS, _LIST = "map<string,variant>", "map<string,struct<>>", "array<variant>"


def _none() -> Column:
    return F.lit(None).cast(_ERROR)


def _error(code: str, path: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), path.alias("path"))


def _when(condition: Column, code: str, path: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), _error(code, path))


def _first(errors: list[Column]) -> Column:
    return F.coalesce(*errors) if len(errors) > 1 else errors[0] if errors else _none()


@dataclass(frozen=True)
class _At:
    """A place in a document: known members are read by their path, without taking the objects on the
    way apart.  ``columns`` are worked out per row ahead of the checks; None inside of a lambda."""

    root: Column
    columns: dict[str, Column] | None = None
    steps: str = "$"

    def get(self, kind: str = "variant") -> Column:
        return F.try_variant_get(self.root, self.steps, kind)

    def member(self, name: str) -> _At:
        if re.fullmatch(r"[A-Za-z0-9_-]+", name):
            return replace(self, steps=f"{self.steps}.{name}")
        # a name that could be read as steps
        return replace(self, root=F.try_element_at(self.get(_MAP), F.lit(name)), steps="$")

    def kind(self) -> Column:
        return F.schema_of_variant(self.get())

    def is_object(self) -> Column:
        return self.get("struct<>").isNotNull()  # its members are not read

    def there(self) -> Column:
        return self.is_object() | self.get().isNotNull()  # an object need not be copied for this

    def once(self, value: Column, use) -> Column:
        """``use(value)`` with the value worked out once."""
        if self.columns is None:
            return bind(value, use)
        name = f"_once_{len(self.columns)}"
        self.columns[name] = value
        return use(F.col(name))


def _plain(value):
    """A value as JSON has it."""
    return json.loads(json.dumps(value))


def _equals(at: _At, value) -> Column:
    """Members in any order, items in theirs, numbers by value."""
    if isinstance(value, dict):
        same = F.size(at.get(_KEYS)) == len(value)
        for name, x in value.items():
            same = same & _equals(at.member(name), x)
    elif isinstance(value, list):
        same = F.size(at.get(_LIST)) == len(value)
        for i, x in enumerate(value):
            same = same & _equals(replace(at, steps=f"{at.steps}[{i}]"), x)
    elif isinstance(value, str):
        same = (at.kind() == "STRING") & (at.get("string") == value)
    else:
        same = same_document(at.get(), F.parse_json(F.lit(json.dumps(value))), 0)
    return F.coalesce(same, F.lit(False))


def _number(at: _At, s: dict, path: Column) -> Column:
    """A number within bounds; an integer has no fraction, however it is written."""
    kind = at.kind()
    whole, exact, wide = at.get("bigint"), at.get("decimal(38,12)"), at.get("double")
    wrong = ~F.substring_index(kind, "(", 1).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    if s["type"] == "integer":
        wrong = (kind != "BIGINT") & (wrong | F.when(kind.isin("DOUBLE", "FLOAT"), wide != F.floor(wide)).otherwise(
            ~kind.rlike(",0[)]$")))

    def beyond(x, compare) -> Column:
        other = F.coalesce(compare(exact, F.lit(str(x)).cast("decimal(38,12)")), compare(wide, F.lit(float(x))))
        if isinstance(x, int) and abs(x) < 2**63:  # most numbers are compared as they are
            return F.when(kind == "BIGINT", compare(whole, F.lit(x).cast("bigint"))).otherwise(other)
        return other
    return _first([_when(wrong, "type", path)]
                  + ([_when(beyond(s["minimum"], lambda a, b: a < b), "minimum", path)] if "minimum" in s else [])
                  + ([_when(beyond(s["maximum"], lambda a, b: a > b), "maximum", path)] if "maximum" in s else []))


def _string(at: _At, s: dict, path: Column) -> Column:
    """G4c."""
    text = at.get("string")
    errors = [_when(at.kind() != "STRING", "type", path)]
    if "minLength" in s:
        errors.append(_when(F.octet_length(text) < s["minLength"], "minLength", path))
    if "maxLength" in s:
        errors.append(_when(F.octet_length(text) > s["maxLength"], "maxLength", path))
    if "pattern" in s:
        errors.append(_when(~text.rlike(s["pattern"]), "pattern", path))
    return _first(errors)


def _first_of(errors: Column) -> Column:
    return F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0))


def _array(at: _At, s: dict, path: Column) -> Column:
    """G4d; a set (G4g) is an array of which only the items count."""
    def check(items: Column) -> Column:
        errors = [_when(items.isNull(), "type", path)]
        if s["type"] == "array" and "minItems" in s:
            errors.append(_when(F.size(items) < s["minItems"], "minItems", path))
        if s["type"] == "array" and "maxItems" in s:
            errors.append(_when(F.size(items) > s["maxItems"], "maxItems", path))
        if "items" in s:
            errors.append(_first_of(F.transform(items, lambda e, i: _checked(
                _At(e), s["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
        return _first(errors)
    return at.once(at.get(_LIST), check)


def _in_order(name) -> Column | bytes:
    """What the members of an object are in the order of."""
    return F.encode(name, "UTF-16BE") if isinstance(name, Column) else name.encode("utf-16-be")


def _members(at: _At, of: dict, other, path: Column, skip=()) -> Column:
    """The first error of an object's members: by name, or by ``other`` (a schema, True or False)."""
    names = sorted((n for n in of if n not in skip), key=_in_order)
    errors = [(n, F.when(at.member(n).there(), _checked(at.member(n), of[n], F.concat(path, F.lit(f".{n}"))))) for n in names]
    if other is True:
        return _first([e for _, e in errors])

    def failed(e: Column) -> Column:
        error = (_error("additionalProperties", path) if other is False
                 else _checked(_At(e["value"]), other, F.concat(path, F.lit("."), e["key"])))
        return F.when(~e["key"].isin(*of, *skip) & error.isNotNull(), F.struct(e["key"].alias("key"), error.alias("error")))

    def merged(x: Column) -> Column:
        steps = []
        for n, e in errors:
            steps += [F.when(_in_order(x["key"]) < F.lit(_in_order(n)), x["error"]), e]
        return _first([*steps, x["error"]])
    entries = F.map_entries(at.get(_KEYS if other is False else _MAP))
    return at.once(_first_of(F.transform(entries, failed)), merged)


def _required(at: _At, names, path: Column) -> list[Column]:
    return [_when(~at.member(n).there(), "required", F.concat(path, F.lit(f".{n}"))) for n in names]


def _object(at: _At, s: dict, path: Column) -> Column:
    """G4e, and G4h where the members depend on one of them."""
    own, other = s.get("properties", {}), s.get("additionalProperties", True)
    errors = [_when(~at.is_object(), "type", path), *_required(at, s.get("required", ()), path)]
    if "discriminator" not in s:
        return _first([*errors, _members(at, own, other, path)] if own or other is not True else errors)
    name = s["discriminator"]
    where, chosen = F.concat(path, F.lit(f".{name}")), at.member(name)
    text = chosen.get("string")
    errors += [_when(~chosen.there(), "missingDiscriminator", where), _when(chosen.kind() != "STRING", "type", where),
               _when(~text.isin(*s["variants"]), "discriminator", where)]
    for key, sub in s["variants"].items():
        mine, more = sub.get("properties", {}), sub.get("additionalProperties", True)
        steps = [_members(at, own, True if more is not False else other, path, tuple(mine)),
                 *_required(at, sub.get("required", ()), path),
                 *(F.when(at.member(n).there(), _checked(at.member(n), mine[n], F.concat(path, F.lit(f".{n}"))))
                   for n in sorted(mine))]
        if isinstance(more, dict):
            steps.append(_members(at, {n: {} for n in mine}, more, path))
        errors.append(F.when(text == key, _first(steps)))
    return _first(errors)


def _checked(at: _At, schema: dict, path: Column) -> Column:
    """struct(code, path) of the first error of a place that is there, NULL where there is none."""
    if "anyOf" in schema:  # G4f
        wrong = None
        for branch in schema["anyOf"]:
            fails = _checked(at, branch, path).isNotNull()
            wrong = fails if wrong is None else wrong & fails
        return _when(wrong, "anyOf", path)
    if "const" in schema:  # G4g
        return _when(~_equals(at, _plain(schema["const"])), "const", path)
    if "enum" in schema:
        some = None
        for x in schema["enum"]:
            same = _equals(at, _plain(x))
            some = same if some is None else some | same
        return _when(~some, "enum", path)
    kind = schema.get("type", "any")
    if kind == "any":
        return _none()
    if kind in ("integer", "number"):
        return _number(at, schema, path)
    if kind == "string":
        return _string(at, schema, path)
    if kind in ("array", "set"):
        return _array(at, schema, path)
    if kind == "object":
        return _object(at, schema, path)
    if kind in ("boolean", "null"):  # G4b
        return _when(at.kind() != ("BOOLEAN" if kind == "boolean" else "VOID"), "type", path)
    raise ValueError(f"unknown type {kind!r}")


def first_error(v: Column, schema: dict, path: Column) -> Column:
    """struct(code, path) of the first error of a VARIANT, NULL where there is none."""
    return _checked(_At(v), schema, path)


def validate_json(df: DataFrame, json_col: str, schema: dict) -> DataFrame:
    """Adds ``error_code`` and ``error_path`` (NULL for a valid document).  Text that is no JSON, or
    is missing, has the error ``json`` at the root ``$``; paths are ``$.member[0]``.  Documents may be
    VARIANT, parsed once for many schemas."""
    parsed = df.schema[json_col].dataType == VariantType()
    doc = F.col(json_col if parsed else "_document")
    columns: dict[str, Column] = {}
    error = _checked(_At(doc, columns), schema, F.lit("$"))
    out = (df if parsed else df.withColumn("_document", document(json_col))).withColumns(columns)
    out = out.withColumn("error_code", F.when(doc.isNull(), _error("json", F.lit("$"))).otherwise(error))
    out = out.withColumn("error_path", F.col("error_code.path")).withColumn("error_code", F.col("error_code.code"))
    return out.drop("_document", *columns)


def error_counts(validated: DataFrame) -> DataFrame:
    """Rows per first error, whatever the place in arrays."""
    folded = F.regexp_replace("error_path", r"\[\d+\]", "[*]")
    # valid documents are left out by their count: a filter ahead of it would run the checks twice
    return (validated.groupBy("error_code", folded.alias("error_path")).agg(F.count("error_code").alias("rows"))
            .filter(F.col("rows") > 0))
