"""Named rule sets over any DataFrame (D6a-D6l, U1, U2).

Rules are written as Column expressions in Python, not policy text; Catalyst is the
compiler.  Undefined (NULL) conditions count as false, definitions of one rule are
OR-ed, an else-chain takes the first matching branch, conflicting values of a
complete rule are flagged, and rules that use other rules are added in dependency
order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.expr(x)
    return F.lit(x)


def _v(x) -> Column:
    """A rule value: a Column, or a Python literal (strings are values, not expressions)."""
    return x if isinstance(x, Column) else F.lit(x)


def truthy(c) -> Column:
    """Undefined counts as false."""
    return F.coalesce(_c(c), F.lit(False))


def not_(c) -> Column:
    """D6f: not of undefined or false is true."""
    return ~truthy(c)


def all_of(*conds) -> Column:
    return reduce(lambda a, b: a & b, [truthy(c) for c in conds]) if conds else F.lit(True)


def any_of(*conds) -> Column:
    return reduce(lambda a, b: a | b, [truthy(c) for c in conds]) if conds else F.lit(False)


def some(coll, pred: Callable[[Column], Column]) -> Column:
    """D6g: exists over an array, or over a map's values."""
    return truthy(F.exists(coll, lambda x: truthy(pred(x))))


def some_map(m, pred: Callable[[Column, Column], Column]) -> Column:
    return truthy(F.exists(F.map_entries(m), lambda e: truthy(pred(e["key"], e["value"]))))


def every(coll, pred: Callable[[Column], Column]) -> Column:
    """D6h: for-all; empty -> true; an undefined collection -> false."""
    return truthy(F.forall(coll, lambda x: truthy(pred(x))))


def in_(x, coll, kind: str = "array") -> Column:
    """D6i: membership in an array, in a map's values, or as a map key."""
    x = _c(x)
    if kind == "array":
        return truthy(F.array_contains(coll, x))
    if kind == "values":
        return truthy(F.array_contains(F.map_values(coll), x))
    if kind == "key":
        return truthy(F.map_contains_key(coll, x))
    raise ValueError(kind)


def collect(coll, pred, expr=None, kind: str = "array") -> Column:
    """D6j: array / set / object comprehension over an array column.
    For ``kind='object'`` ``expr`` must return a struct(key, value)."""
    kept = F.filter(coll, lambda x: truthy(pred(x)))
    vals = F.transform(kept, expr) if expr is not None else kept
    if kind == "array":
        return vals
    if kind == "set":
        return F.sort_array(F.array_distinct(vals))
    if kind == "object":
        return F.map_from_entries(vals)
    raise ValueError(kind)


def collect_table(df: DataFrame, definitions, by: tuple[str, ...] = (), name: str = "value") -> DataFrame:
    """D6k over the table, set form: (*by, name), each value that some row gives, once.

    ``definitions`` are (condition, value) pairs: a row whose condition holds (undefined is false) adds its
    value; an undefined value adds nothing.  The table is read once for all definitions.  A set is rows,
    not an array: equal values are combined where they are read, so neither a hot value nor a set of
    any size lands in one task.
    """
    found = F.filter(F.array(*[F.when(truthy(c), F.struct(_v(v).alias(name))) for c, v in definitions]),
                     lambda x: x.isNotNull() & x[name].isNotNull())
    return df.select(*by, F.inline(found)).distinct()


def collect_pairs(df: DataFrame, definitions, by: tuple[str, ...] = ()) -> DataFrame:
    """D6k over the table, object form: (*by, key, value, conflict), a row for each key.

    ``definitions`` are (condition, key, value) triples.  A key that gets more than one value is in
    ``conflict`` and has no value.  Equal pairs are combined first, where they are read, and the values of
    a key are only counted, so a hot key is not one task's work.
    """
    found = F.filter(F.array(*[F.when(truthy(c), F.struct(_v(k).alias("key"), _v(v).alias("value")))
                               for c, k, v in definitions]),
                     lambda x: x.isNotNull() & x["key"].isNotNull() & x["value"].isNotNull())
    pairs = df.select(*by, F.inline(found)).distinct()
    one = pairs.groupBy(*by, "key").agg(F.min("value").alias("value"), (F.count(F.lit(1)) > 1).alias("conflict"))
    return one.withColumn("value", F.when(~F.col("conflict"), F.col("value")))


class RuleSet:
    """Builder of named rules; ``apply(df)`` adds one column per rule."""

    def __init__(self):
        self._order: list[str] = []
        self._defaults: dict[str, Column] = {}
        self._defs: dict[str, list[tuple[Column, Column]]] = {}
        self._chains: dict[str, list[tuple[Column, Column]]] = {}
        self._collect: dict[str, tuple] = {}
        self._valued: set[str] = set()
        self._funcs: dict[str, Callable] = {}
        self._needs: dict[str, set[str]] = {}

    def _touch(self, name):
        if name not in self._order:
            self._order.append(name)

    def default(self, name: str, value) -> "RuleSet":
        """D6a."""
        self._touch(name)
        self._defaults[name] = _v(value)
        return self

    def rule(self, name: str, *conds, value=True) -> "RuleSet":
        """One definition; body = AND of conditions.  Repeat to OR definitions."""
        self._touch(name)
        self._defs.setdefault(name, []).append((all_of(*conds), _v(value)))
        if not (isinstance(value, bool) and value is True):
            self._valued.add(name)
        return self

    def chain(self, name: str, *branches) -> "RuleSet":
        """D6d: else-chain; branches are (conds, value) tried in order, first match wins."""
        self._touch(name)
        self._chains[name] = [(all_of(*(c if isinstance(c, (list, tuple)) else [c])), _v(v))
                              for c, v in branches]
        return self

    def collect_rule(self, name: str, coll, pred, key=None) -> "RuleSet":
        """D6k: partial set rule - the set of matching elements (or keys) per row."""
        self._touch(name)
        self._collect[name] = (coll, pred, key)
        return self

    def function(self, name: str, fn: Callable[..., Column]) -> "RuleSet":
        """Register a user function (Column -> Column) callable from rules."""
        self._funcs[name] = fn
        return self

    def define(self, name: str, *definitions, default=None) -> "RuleSet":
        """A function rule of several definitions: (condition, value) pairs of functions of the
        arguments.  The first whose condition holds (undefined is false) gives the value, else ``default``."""
        def fn(*args: Column) -> Column:
            e = None
            for condition, value in definitions:
                c, v = truthy(condition(*args)), _v(value(*args))
                e = F.when(c, v) if e is None else e.when(c, v)
            return _v(default) if e is None else e.otherwise(_v(default))
        return self.function(name, fn)

    def call(self, name: str, *args) -> Column:
        return self._funcs[name](*[_c(a) for a in args])

    def _expr(self, name: str) -> tuple[Column, Column | None]:
        dflt = self._defaults.get(name)
        if name in self._collect:
            coll, pred, key = self._collect[name]
            return collect(coll, pred, key, kind="set"), None
        if name in self._chains:
            e = None
            for cond, val in self._chains[name]:
                e = F.when(cond, val) if e is None else e.when(cond, val)
            return (e.otherwise(dflt) if dflt is not None else e), None
        defs = self._defs.get(name, [])
        if name not in self._valued:
            body = any_of(*[c for c, _ in defs]) if defs else None
            if body is None:
                return (dflt if dflt is not None else F.lit(None)), None
            return (F.when(body, F.lit(True)).otherwise(dflt if dflt is not None else F.lit(None))), None
        # complete rule with values: all matching definitions must agree (D6e)
        vals = F.array_distinct(F.filter(F.array(*[F.when(c, v) for c, v in defs]), lambda x: x.isNotNull()))
        value = F.when(F.size(vals) == 1, vals[0]).when(F.size(vals) == 0, dflt if dflt is not None else F.lit(None))
        return value, F.size(vals) > 1

    def needs(self, name: str, *others: str) -> "RuleSet":
        """Declare that ``name`` reads the rules ``others``: needed only where an input column
        has the name of a rule that is read; other references are found by analysis."""
        self._touch(name)
        self._needs.setdefault(name, set()).update(others)
        return self

    def _ready(self, df: DataFrame, name: str, done: set[str]) -> bool:
        """Whether the rules that ``name`` declares are done and its columns resolve."""
        if not self._needs.get(name, set()) <= done:
            return False
        value, conflict = self._expr(name)
        try:
            df.select(*[c for c in (value, conflict) if c is not None]).schema
        except AnalysisException as e:
            if (e.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
                return False
            raise
        return True

    def apply(self, df: DataFrame, overrides: dict | None = None) -> DataFrame:
        """Adds the rule columns.  D6l: ``overrides`` replaces input columns first (what-if)."""
        if overrides:
            df = df.withColumns({k: _c(v) for k, v in overrides.items()})
        done: list[str] = []
        pending = list(self._order)
        while pending:  # in the order in which the columns they read are there
            ready = [n for n in pending if self._ready(df, n, set(done))]
            if not ready:
                raise ValueError(f"cyclic rules: {pending}")
            cols = {}
            for n in ready:
                v, conflict = self._expr(n)
                cols[n] = v
                if conflict is not None:
                    cols[f"{n}__conflict"] = conflict
            df = df.withColumns(cols)
            done += ready
            pending = [n for n in pending if n not in ready]
        return df
