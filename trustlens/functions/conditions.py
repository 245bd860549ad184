"""Attribute-based role-condition operators as Column helpers.

Each returns a boolean Column; NULL means a type error (the bulk evaluator turns it
into ``error`` and does not grant).  A missing attribute reads as NULL.  Conditions fail
closed: only the case-sensitive ``string_equals``, the list and the quantifier helpers read
a missing side as false; every other helper, and every negation, gives NULL for it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import net


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, (list, tuple)):
        return F.array(*[F.lit(v) for v in x])
    return F.lit(x)


def _text(x) -> Column:
    """A text operand; a value of another type is a type error (NULL)."""
    c = _c(x)
    return F.when(F.typeof(c) == "string", c.cast("string"))


def _f(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# B1/B2 ------------------------------------------------------------------------------
def string_equals(left, right, ignore_case: bool = False) -> Column:
    """B1/B2: if exactly one side is a (Python) list -> containment."""
    same = _string_equals(left, right, ignore_case)
    return same if ignore_case else _f(same)


def _string_equals(left, right, ignore_case: bool) -> Column:
    norm = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    if isinstance(right, (list, tuple)) and not isinstance(left, (list, tuple)):
        return F.exists(_c(right), lambda e: norm(e) == norm(_c(left)))
    if isinstance(left, (list, tuple)) and not isinstance(right, (list, tuple)):
        return F.exists(_c(left), lambda e: norm(e) == norm(_c(right)))
    return norm(_c(left)) == norm(_c(right))


def string_not_equals(left, right, ignore_case: bool = False) -> Column:
    """NULL when a side is missing."""
    return ~_string_equals(left, right, ignore_case)


def like_regex(pattern: str) -> str:
    """Only ``*`` is a wildcard; case-sensitive; whole string."""
    return "(?s)^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def string_like(left, pattern: str) -> Column:
    return _c(left).rlike(like_regex(pattern))


def string_not_like(left, pattern: str) -> Column:
    return ~string_like(left, pattern)


def string_starts_with(left, right) -> Column:
    """B4."""
    return F.startswith(_text(left), _text(right))


def string_not_starts_with(left, right) -> Column:
    return ~string_starts_with(left, right)


def string_ends_with(left, right) -> Column:
    return F.endswith(_text(left), _text(right))


def string_not_ends_with(left, right) -> Column:
    return ~string_ends_with(left, right)


def string_contains(left, right) -> Column:
    return F.contains(_text(left), _text(right))


def string_not_contains(left, right) -> Column:
    return ~string_contains(left, right)


def string_matches(left, regex: str) -> Column:
    """Unanchored regex."""
    return _text(left).rlike(regex)


def string_not_matches(left, regex: str) -> Column:
    return ~string_matches(left, regex)


# B6/B7 numbers: 64-bit integers; integer strings accepted; fractions are an error -----
def to_int64(x) -> Column:
    c = _c(x).cast("string")
    as_long = F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("long"))
    as_dbl = F.when(F.typeof(_c(x)) != "string", c.try_cast("double"))
    # NULL (type error) when the value is fractional, not a number, or text like "12.0"
    return F.when(as_long.isNotNull(), as_long).when(as_dbl.isNotNull() & (as_dbl == F.floor(as_dbl)),
                                                       as_dbl.try_cast("long"))


def _num(op, left, right) -> Column:
    return op(to_int64(left), to_int64(right))


def numeric_equals(left, right):
    return _num(lambda a, b: a == b, left, right)


def numeric_not_equals(left, right):
    return _num(lambda a, b: a != b, left, right)


def numeric_less_than(left, right):
    return _num(lambda a, b: a < b, left, right)


def numeric_less_than_equals(left, right):
    return _num(lambda a, b: a <= b, left, right)


def numeric_greater_than(left, right):
    return _num(lambda a, b: a > b, left, right)


def numeric_greater_than_equals(left, right):
    return _num(lambda a, b: a >= b, left, right)


def numeric_in_range(x, lo, hi) -> Column:
    """Inclusive."""
    v = to_int64(x)
    return (v >= to_int64(lo)) & (v <= to_int64(hi))


# B8 ------------------------------------------------------------------------------------
def _bool(x) -> Column:
    """A boolean operand; anything else, text like "true" included, is a type error."""
    c = _c(x)
    return F.when(F.typeof(c) == "boolean", c.cast("string").try_cast("boolean"))


def bool_equals(left, right) -> Column:
    return _bool(left) == _bool(right)


def bool_not_equals(left, right) -> Column:
    return ~bool_equals(left, right)


# B9 datetimes: instants, offsets honoured ------------------------------------------------
def to_instant(x) -> Column:
    c = _c(x)
    return F.coalesce(F.try_to_timestamp(c.cast("string"), F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX")),
                      F.try_to_timestamp(c.cast("string")))


def datetime_cmp(op, left, right) -> Column:
    return op(to_instant(left), to_instant(right))


def datetime_equals(left, right):
    return datetime_cmp(lambda a, b: a == b, left, right)


def datetime_not_equals(left, right):
    return datetime_cmp(lambda a, b: a != b, left, right)


def datetime_greater_than(left, right):
    return datetime_cmp(lambda a, b: a > b, left, right)


def datetime_greater_than_or_equals(left, right):
    return datetime_cmp(lambda a, b: a >= b, left, right)


def datetime_less_than(left, right):
    return datetime_cmp(lambda a, b: a < b, left, right)


def datetime_less_than_or_equals(left, right):
    return datetime_cmp(lambda a, b: a <= b, left, right)


# B10/B11 time of day --------------------------------------------------------------------
def time_of_day_seconds(x) -> Column:
    """'HH:MM' or 'HH:MM:SS' -> seconds since midnight; malformed -> NULL (error)."""
    c = _c(x).cast("string")
    pat = r"^([01]\d|2[0-3]):([0-5]\d)(?::([0-5]\d))?$"
    h = F.regexp_extract(c, pat, 1).try_cast("int")
    m = F.regexp_extract(c, pat, 2).try_cast("int")
    s = F.coalesce(F.regexp_extract(c, pat, 3).try_cast("int"), F.lit(0))
    return F.when(c.rlike(pat), h * 3600 + m * 60 + s)


def time_of_day_cmp(op, left, right):
    return op(time_of_day_seconds(left), time_of_day_seconds(right))


def time_of_day_in_range(x, a, b) -> Column:
    """Inclusive, bounds in any order, no wrap at midnight."""
    v, lo, hi = time_of_day_seconds(x), time_of_day_seconds(a), time_of_day_seconds(b)
    return (v >= F.least(lo, hi)) & (v <= F.greatest(lo, hi))


# B12 ------------------------------------------------------------------------------------
def guid_equals(left, right) -> Column:
    return F.lower(_text(left)) == F.lower(_text(right))


def guid_not_equals(left, right) -> Column:
    return ~guid_equals(left, right)


# B13 ------------------------------------------------------------------------------------
def ip_match(ip, cidr: str) -> Column:
    return net.ip_in_cidr(ip, cidr)


def ip_not_match(ip, cidr: str) -> Column:
    return ~net.ip_in_cidr(ip, cidr)


def ip_in_range(ip, lo: str, hi: str) -> Column:
    return net.ip_in_range(ip, lo, hi)


# B14-B19 lists and quantifiers -----------------------------------------------------------
def list_contains(lst, needle) -> Column:
    """A list needle means all of its elements are contained."""
    if isinstance(needle, (list, tuple)):
        return _f(F.size(F.array_except(_c(needle), _c(lst))) == 0)
    return _f(F.array_contains(_c(lst), _c(needle)))


def list_not_contains(lst, needle) -> Column:
    return ~list_contains(lst, needle)


def for_any_of_any_values(left, right) -> Column:
    """B15."""
    return _f(F.arrays_overlap(_c(left), _c(right)))


def for_all_of_any_values(left, right) -> Column:
    """Every left value is in right."""
    return _f(F.size(F.array_except(_c(left), _c(right))) == 0)


def for_any_of_all_values(left, right) -> Column:
    """Some left value equals every right value."""
    r = _c(right)
    return _f(F.exists(_c(left), lambda x: F.forall(r, lambda y: x == y)))


def for_all_of_all_values(left, right) -> Column:
    """B18."""
    r = _c(right)
    return _f(F.forall(_c(left), lambda x: F.forall(r, lambda y: x == y)))


def any_element(lst, pred) -> Column:
    """B19 ANY: missing list -> false."""
    return _f(F.exists(_c(lst), pred))


def all_elements(lst, pred) -> Column:
    """B19 ALL: missing list -> false; empty -> true."""
    return _f(F.forall(_c(lst), pred))


# B20/B21 ----------------------------------------------------------------------------------
def action_matches(action, pattern) -> Column:
    """Same number of '/' segments; '*' matches one segment; others exact."""
    a = F.split(_c(action), "/")
    p = F.split(_c(pattern), "/")
    seg_ok = F.zip_with(a, p, lambda x, y: (y == F.lit("*")) | (x == y))
    return _f((F.size(a) == F.size(p)) & F.forall(seg_ok, lambda b: b))


def sub_operation_matches(sub, expected) -> Column:
    """Exact."""
    return _f(_c(sub) == _c(expected))


# B22 ----------------------------------------------------------------------------------------
def to_lower(x):
    return F.lower(_c(x))


def to_upper(x):
    return F.upper(_c(x))


def trim(x):
    return F.trim(_c(x))


def normalize_set(x):
    return F.array_distinct(_c(x))


def normalize_list(x):
    return _c(x) if isinstance(x, (list, tuple)) else F.array(_c(x))


def add_days(ts, n: int):
    return to_instant(ts) + F.make_interval(days=F.lit(n))


def to_time(x):
    return time_of_day_seconds(x)
