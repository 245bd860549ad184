"""Resource-compliance condition operators as Column builders.

``lhs`` is a Column (a resource field or a value expression); ``rhs`` a Python
literal, a list, or a Column.  Undefined (NULL) results never leak: every operator
returns a non-null boolean.  A field that is *missing* is passed as NULL; where null
and missing differ (``value`` / nested ``current`` operands) pass ``present``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _b(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _s(c: Column) -> Column:
    return F.lower(c.cast("string"))


def _num(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def _is_text(c: Column) -> Column:
    """Folded to a constant by the optimizer: the column's type is known to it."""
    return F.typeof(c) == "string"


def _eq(lhs: Column, rhs) -> Column:
    """C1 core on a present lhs, by the types of both sides: two strings are compared as
    case-folded text, a string and a number (or boolean) as numbers (booleans), two numbers as
    numbers; NULL lhs equals '' and NULL."""
    if rhs is None:
        return lhs.isNull()
    if isinstance(rhs, bool):
        return _b(_s(lhs) == F.lit(str(rhs).lower()))
    if isinstance(rhs, (int, float)):
        return _b(_num(lhs) == F.lit(float(rhs)))
    if isinstance(rhs, str):
        return _eq(lhs, F.lit(rhs))
    r = rhs if isinstance(rhs, Column) else F.lit(rhs)
    as_text = F.coalesce(_s(lhs), F.lit("")) == F.coalesce(_s(r), F.lit(""))
    as_number = ~(_is_text(lhs) & _is_text(r)) & (_num(lhs) == _num(r))
    return _b(as_text | _b(as_number))


def equals(lhs: Column, rhs, present: Column | None = None) -> Column:
    """C1.  Missing lhs equals only a null rhs."""
    e = _eq(lhs, rhs)
    if present is None:
        return e
    return F.when(_b(present), e).otherwise(F.lit(rhs is None))


def not_equals(lhs: Column, rhs, present: Column | None = None) -> Column:
    """Negation of C1 (missing: true unless rhs is null)."""
    return ~equals(lhs, rhs, present)


def _cmp(lhs: Column, rhs, op) -> Column:
    if isinstance(rhs, bool):
        return _b(op(lhs.cast("string").try_cast("boolean").cast("int"), F.lit(int(rhs))))
    if isinstance(rhs, (int, float)):
        return _b(op(_num(lhs), F.lit(float(rhs))))
    if isinstance(rhs, str):
        return _cmp(lhs, F.lit(rhs), op)
    r = rhs if isinstance(rhs, Column) else F.lit(rhs)
    # two strings: case-folded text order; else numbers, and undefined if a side is none
    return _b(F.when(_is_text(lhs) & _is_text(r), op(_s(lhs), _s(r))).otherwise(op(_num(lhs), _num(r))))


def greater(lhs, rhs):
    """C3."""
    return _cmp(lhs, rhs, lambda a, b: a > b)


def greater_or_equals(lhs, rhs):
    return _cmp(lhs, rhs, lambda a, b: a >= b)


def less(lhs, rhs):
    return _cmp(lhs, rhs, lambda a, b: a < b)


def less_or_equals(lhs, rhs):
    return _cmp(lhs, rhs, lambda a, b: a <= b)


def in_(lhs: Column, values, present: Column | None = None) -> Column:
    """C4: any non-null list element equal by C1; NULL lhs -> false; missing -> list has null."""
    vals = list(values)
    hit = reduce(lambda a, b: a | b, [_eq(lhs, v) for v in vals if v is not None], F.lit(False))
    e = F.when(lhs.isNull(), F.lit(False)).otherwise(hit)
    if present is None:
        return e
    return F.when(_b(present), e).otherwise(F.lit(any(v is None for v in vals)))


def not_in(lhs: Column, values, present: Column | None = None) -> Column:
    """NULL lhs -> true; else negation of C4."""
    e = F.when(lhs.isNull(), F.lit(True)).otherwise(~in_(lhs, values))
    if present is None:
        return e
    return F.when(_b(present), e).otherwise(~F.lit(any(v is None for v in values)))


def contains(lhs: Column, rhs, kind: str = "string") -> Column:
    """Substring (kind='string'), array membership ('array') or map key ('map'),
    all case-insensitive.  Missing lhs or undefined rhs -> false."""
    if rhs is None:
        return F.lit(False)
    r = rhs.lower() if isinstance(rhs, str) else rhs
    if kind == "string":
        return _b(F.contains(_s(lhs), F.lit(str(r))))
    if kind == "array":
        return _b(F.exists(lhs, lambda e: _eq(e, rhs)))
    if kind == "map":
        return _b(F.exists(F.map_keys(lhs), lambda k: F.lower(k) == F.lit(str(r))))
    raise ValueError(kind)


def not_contains(lhs: Column, rhs, kind: str = "string") -> Column:
    """C6 negated: missing lhs -> true; undefined rhs -> false."""
    if rhs is None:
        return F.lit(False)
    return F.when(lhs.isNull(), F.lit(True)).otherwise(~contains(lhs, rhs, kind))


def contains_key(lhs: Column, key: str) -> Column:
    """Object keys only, case-insensitive."""
    return contains(lhs, key, "map")


def not_contains_key(lhs: Column, key: str) -> Column:
    return F.when(lhs.isNull(), F.lit(True)).otherwise(~contains_key(lhs, key))


def like_regex(pattern: str) -> str:
    """``*`` any run, ``?`` one character, whole string, case-insensitive."""
    out = "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in pattern)
    return f"(?is)^{out}$"


def like(lhs: Column, pattern: str) -> Column:
    """C8."""
    return _b(lhs.cast("string").rlike(like_regex(pattern)))


def not_like(lhs: Column, pattern: str) -> Column:
    return ~like(lhs, pattern)


def match_regex(pattern: str, insensitive: bool = False) -> str:
    """``#`` digit, ``?`` ASCII letter, ``.`` any character, everything else literal; same length."""
    out = "".join("[0-9]" if ch == "#" else "[A-Za-z]" if ch == "?" else "." if ch == "." else re.escape(ch)
                  for ch in pattern)
    return ("(?is)" if insensitive else "(?s)") + f"^{out}$"


def match(lhs: Column, pattern: str) -> Column:
    """C9."""
    return _b(lhs.cast("string").rlike(match_regex(pattern)))


def not_match(lhs: Column, pattern: str) -> Column:
    return ~match(lhs, pattern)


def match_insensitively(lhs: Column, pattern: str) -> Column:
    return _b(lhs.cast("string").rlike(match_regex(pattern, True)))


def not_match_insensitively(lhs: Column, pattern: str) -> Column:
    return ~match_insensitively(lhs, pattern)


def exists(lhs: Column, expected=True, present: Column | None = None) -> Column:
    """Present and not null equals expected ("true"/"false" strings accepted)."""
    if isinstance(expected, str):
        expected = expected.strip().lower() == "true"
    there = lhs.isNotNull() if present is None else (_b(present) & lhs.isNotNull())
    return there if expected else ~there


def value_condition(lhs: Column, cond) -> Column:
    """C11: ``cond(lhs)`` where an undefined lhs -> false."""
    return F.when(lhs.isNull(), F.lit(False)).otherwise(_b(cond(lhs)))


def all_of(*conds) -> Column:
    """Undefined child = false."""
    return reduce(lambda a, b: a & b, [_b(c) for c in conds], F.lit(True))


def any_of(*conds) -> Column:
    return reduce(lambda a, b: a | b, [_b(c) for c in conds], F.lit(False))


def not_(cond) -> Column:
    return ~_b(cond)


def every_element(arr: Column, pred) -> Column:
    """C14: ``a[*].b`` outside count - every element must satisfy; empty -> true;
    missing array -> false (undefined)."""
    return _b(F.forall(arr, lambda e: _b(pred(e))))


def count_where(arr: Column, pred=None) -> Column:
    """Number of elements (optionally meeting ``pred``); a missing array counts 0."""
    kept = arr if pred is None else F.filter(arr, lambda e: _b(pred(e)))
    return F.coalesce(F.size(kept), F.lit(0)) if pred is not None else F.coalesce(F.size(arr), F.lit(0))


def any_element(arr: Column, pred) -> Column:
    """Count > 0 written as an existence test (short-circuits)."""
    return _b(F.exists(arr, lambda e: _b(pred(e))))


def count_values(values, pred) -> Column:
    """Count over a literal list with a named element."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.size(F.filter(arr, lambda e: _b(pred(e))))


def nested_count(arr: Column, inner: str, pred=None) -> Column:
    """C17: ``A[*].B[*]`` count with access to the outer element; pred(outer, inner).
    With ``pred`` a missing inner array counts 0 elements; without, the count is undefined
    (NULL) when one is missing."""
    if pred is None:
        return F.when(arr.isNull(), F.lit(0)).otherwise(F.aggregate(
            arr, F.lit(0), lambda acc, o: acc + F.when(o[inner].isNotNull(), F.size(o[inner]))))
    return F.coalesce(F.aggregate(arr, F.lit(0), lambda acc, o: acc + F.coalesce(
        F.size(F.filter(o[inner], lambda i: _b(pred(o, i)))), F.lit(0))), F.lit(0))


def collect_field(arr: Column, field: str) -> Column:
    """``field('a[*].b')`` as an array."""
    return F.transform(arr, lambda e: e[field])


def field(path: str) -> Column:
    """A policy field path -> Column.  Names are case-insensitive (Spark resolves
    column names case-insensitively by default); ``tags['x']`` / ``tags.x`` read the tag
    map; ``a[*].b`` returns the collected array."""
    p = path.strip()
    m = re.fullmatch(r"tags\[['\"](.+)['\"]\]", p, re.I) or re.fullmatch(r"tags\.(.+)", p, re.I)
    if m:
        mine = F.map_filter(F.col("tags"), lambda k, v: F.lower(k) == F.lit(m.group(1).lower()))
        return F.try_element_at(F.map_values(mine), F.lit(1))
    if "[*]." in p:
        head, tail = p.split("[*].", 1)
        return collect_field(F.col(head), tail)
    return F.col(p)
