"""Conversation structure repair by an auction shortest-path algorithm.

A conversation is well formed when the initials of its roles are ``(s?(ua)+)?``.  Rows can be kept,
given another role, deleted, and empty turns inserted, each at an integer cost.  What remains to be
done is a node: the next row and the state of the pattern (0 nothing yet, 1 after s, 2 after u, 3
after a); the edits are arcs of this lattice.

Every node has a price, at first the least that the rows behind it must cost whatever their roles.
A path grows from the start: where the price of its last node is what some arc and the price at the
arc's end cost together, the path is extended by such an arc; otherwise the price is raised to the
least such sum and the path contracted by a node.  Prices stay at most the arc's cost above the next
node's, so once the path reaches the end the price of the start is the least cost, and every arc of
every cheapest repair is tight (its cost is the difference of its prices).  The repair is read off by
following from the start the tight arc of the ASCII-least edit.  An arc that is tight but leads
nowhere is not met: the path would have tried it, and raised the price at its end.

A conversation of more than ``block`` rows is cut into blocks, which are tasks of their own: the
auction is run for each state that a block can be entered and left by, a pass from the last block
backwards adds up the costs, a pass forwards picks the blocks' repairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG_ROWS, store
from .places import by_range, split_by_size

BLOCK = 256
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5  # costs; to keep is free
END = (0, None, None, 0)  # what is still to pay in each state behind the last row
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\x0c\r"
_NEXT_TURN = (2, 2, 3, 2)  # the state behind an inserted or re-roled row
_KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_FORCED = "D"  # the kind of a row that must go; else the role's initial, "!" behind it if truncated


def _arcs(kind: str) -> list[list[tuple[str, int, int]]]:
    """For each state: (edit, cost, how far the target is from the node) in ASCII order of edits.
    The node of row i and state q is 4 * i + q."""
    out = []
    for q in range(4):
        to = _NEXT_TURN[q]
        insert = ("I", INSERT, to - q)
        if kind == _FORCED:
            out.append([("D", DELETE, 4), insert])
            continue
        extra = TRUNCATED if kind.endswith("!") else 0
        arcs = [("D", DELETE, 4), insert]
        kept = _KEPT.get(kind[:1], (None,) * 4)[q]
        if kept is not None:
            arcs.append(("K", extra, 4 + kept - q))
        arcs.append(("R", REROLE + extra, 4 + to - q))
        out.append(arcs)
    return out


_ARCS = {k: _arcs(k) for k in ("D", "s", "u", "a", "", "s!", "u!", "a!", "!")}
_AT_END = [[("I", INSERT, to - q)] for q, to in enumerate(_NEXT_TURN)]
_LEAST = {k: min(c for arcs in a for e, c, _ in arcs if e != "I") for k, a in _ARCS.items()}


def kind_of(role: str, forced: bool, truncated: bool) -> str:
    return _FORCED if forced else (role[:1] if role[:1] in ("s", "u", "a") else "") + ("!" if truncated else "")


def auction(kinds: list[str], copies: list[int], start: int = 0, after=END, at_end: bool = True) -> tuple[int, str]:
    """(cost, edits) of the cheapest repair from state ``start``, of equal ones the ASCII-least.

    ``copies`` says how many times a row that must go stands there (1 for all others); ``after`` is
    what each state costs behind the last row (None: not allowed), which must be within reach;
    ``at_end`` whether turns can be inserted there.
    """
    n = len(kinds)
    # states from which an allowed end is within reach: the pattern never goes back to 0 or 1
    ends = [q for q in range(4) if after[q] is not None]
    open_ = [any(e >= q or e >= 2 for e in ends) for q in range(4)]
    sink = 4 * n + 4
    rest = [0] * (n + 1)
    rest[n] = min(after[q] for q in ends)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE * copies[i] if kinds[i] == _FORCED else _LEAST[kinds[i]])
    price = [rest[x >> 2] for x in range(sink)] + [0]

    def best(x: int) -> tuple[int, str, int]:
        """The least of cost and price at the end over the node's arcs, and the first arc that has it."""
        i, q = x >> 2, x & 3
        least, edit, target = None, "", 0
        if i < n:
            forced = kinds[i] == _FORCED
            for e, c, step in _ARCS[kinds[i]][q]:
                if open_[x + step & 3]:
                    if forced and e == "D":
                        c *= copies[i]
                    c += price[x + step]
                    if least is None or c < least:
                        least, edit, target = c, e, x + step
            if forced and edit == "D":
                edit *= copies[i]
        else:
            if after[q] is not None:
                least, target = after[q], sink
            if at_end:
                for e, c, step in _AT_END[q]:
                    if open_[x + step & 3] and (least is None or c + price[x + step] < least):
                        least, edit, target = c + price[x + step], e, x + step
        return least, edit, target

    path = [start]
    while path[-1] != sink:
        x = path[-1]
        least, _, target = best(x)
        if least is not None and price[x] >= least:
            path.append(target)  # extend
        else:
            price[x] = 1 << 60 if least is None else least  # raise, and contract
            if len(path) > 1:
                path.pop()
    edits, x = [], start
    while x != sink:  # price[x] is what the arc and its end cost: the arc is tight
        _, edit, x = best(x)
        edits.append(edit)
    return price[start], "".join(edits)


def repaired(edits: str, rows: list[tuple[str, str]], state: int = 0) -> list[tuple[str, str]]:
    """The (role, text) that the edits leave of the rows."""
    out, at = [], 0
    for e in edits:
        if e == "D":
            at += 1
            continue
        if e == "K":
            role, text = rows[at]
            state = _KEPT[role[0]][state]
        else:
            state = _NEXT_TURN[state]
            role, text = ("user" if state == 2 else "assistant"), "" if e == "I" else rows[at][1]
        at += e != "I"
        out.append((role, text))
    return out


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


# --- rows -----------------------------------------------------------------------------------------

def damaged(conv: DataFrame) -> DataFrame:
    """(c, turn, role, text, copies): ``conv`` after a damage by the hash of ``conv_id:turn``, modulo
    20: 0 drops a row (copies is 0), 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4
    sets its role to user.  A null is one space, but for a turn in the order of rows."""
    m = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")),
                            F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return conv.select("conv_id", "turn", "role", "text", m.alias("m")).select(
        F.col("conv_id").alias("c"), "turn",
        F.when(F.col("m") == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("m").isin(0, 1), F.lit("")).when(F.col("m") == 2, F.translate(text, ".!?", ""))
        .otherwise(text).alias("text"),
        F.when(F.col("m") == 0, 0).when(F.col("m") == 3, 2).otherwise(1).cast("long").alias("copies"))


def undamaged(conv: DataFrame) -> DataFrame:
    """The same columns of ``conv`` as it is."""
    return conv.select(F.col("conv_id").alias("c"), "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("copies"))


_ORDER = ("turn", "role", "text")  # of rows within a conversation; null turns first


def _facts(rows: DataFrame) -> DataFrame:
    core = F.rtrim("text", F.lit(WHITE))
    return (rows.withColumn("blank", F.length(core) == 0)
            .withColumn("truncated", ~F.substr(core, F.lit(-1)).isin(".", "!", "?")))


_OUT = [("part", pa.int64()), ("parts", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()),
        ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
        ("audit", pa.string())]
_TURNS = "array<struct<role:string,text:string>>"


def _batch(ids: list, id_type: pa.DataType, rows: list[tuple], turns: list[list[tuple[str, str]]]) -> pa.RecordBatch:
    flat = [t for ts in turns for t in ts]
    ends = [0]
    for ts in turns:
        ends.append(ends[-1] + len(ts))
    pairs = pa.StructArray.from_arrays([pa.array([r for r, _ in flat], pa.string()),
                                        pa.array([t for _, t in flat], pa.string())], ["role", "text"])
    cols = list(zip(*rows)) if rows else [[]] * len(_OUT)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, id_type), *(pa.array(list(c), t) for c, (_, t) in zip(cols, _OUT)),
         pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)],
        ["conv_id", *(n for n, _ in _OUT), "turns"])


def _rows_of(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns))


def _whole(id_type: pa.DataType):
    """Conversations of a sorted partition, one after the other."""
    names = ["c", "turn", "role", "text", "copies", "blank", "truncated"]

    def run(batches):
        ids, out, turns, held = [], [], [], 0
        for c, group in groupby(_rows_of(batches, names), itemgetter(0)):
            seen, numbers, rows, kinds = set(), set(), [], []
            count = {"blank": 0, "duplicate": 0, "truncated": 0}
            for _, turn, role, text, copies, blank, truncated in group:
                if copies and turn is not None:
                    numbers.add(turn)
                for _ in range(copies):
                    first = (role, text) not in seen
                    fault = "blank" if blank else "duplicate" if not first else "truncated" if truncated else None
                    seen.add((role, text))
                    if fault:
                        count[fault] += 1
                    rows.append((role, text))
                    kinds.append(kind_of(role, blank or not first, truncated))
            cost, audit = auction(kinds, [1] * len(kinds))
            ids.append(c)
            out.append((0, 1, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, count["blank"],
                        count["duplicate"], count["truncated"], illegal_pairs([r[:1] for r, _ in rows]), cost, audit))
            turns.append(repaired(audit, rows))
            held += len(rows)
            if held >= LONG_ROWS:
                yield _batch(ids, id_type, out, turns)
                ids, out, turns, held = [], [], [], 0
        if ids:
            yield _batch(ids, id_type, out, turns)
    return run


def _items(rows: list[dict]) -> tuple[list[str], list[int]]:
    """Kinds and copies: a row that stays may have copies behind it, which must go."""
    kinds, copies = [], []
    for r in rows:
        forced = r["blank"] or not r["first"]
        if forced:
            kinds.append(_FORCED)
            copies.append(r["copies"])
        else:
            kinds.append(kind_of(r["initial"], False, r["truncated"]))
            copies.append(1)
            if r["copies"] > 1:
                kinds.append(_FORCED)
                copies.append(r["copies"] - 1)
    return kinds, copies


_WAY = "enter int, leave int, cost long, edits string"
_WAYS = pa.list_(pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()),
                            ("edits", pa.string())]))
_COUNTS = "blank long, duplicate long, truncated long, illegal long"


def _ways(rows: list[dict], last: bool) -> list[dict]:
    """The cheapest repair of a block for each state that it can be entered and left by (-1: the end)."""
    kinds, copies = _items(rows)
    some_s = any(k[:1] == "s" for k in kinds)
    out = []
    for enter in range(4):
        for leave in [-1] if last else range(4):
            if last or leave >= 2 or leave == enter or (enter, leave) == (0, 1) and some_s:
                after = END if last else tuple(0 if q == leave else None for q in range(4))
                cost, edits = auction(kinds, copies, enter, after, last)
                out.append({"enter": enter, "leave": leave, "cost": cost, "edits": edits})
    return out


def _blocks(batches):
    for b in batches:
        found = []
        for rows, block, parts in zip(*(b.column(x).to_pylist() for x in ("rows", "block", "parts"))):
            rows.sort(key=itemgetter("pos"))
            stays = [not r["blank"] and r["first"] for r in rows]
            heads = [r["initial"] for r in rows]
            found.append((
                sum(r["copies"] for r in rows if r["blank"]),
                sum(r["copies"] - k for r, k in zip(rows, stays) if not r["blank"]),
                sum(r["truncated"] for r, k in zip(rows, stays) if k),
                illegal_pairs(heads) + sum((r["copies"] - 1) * (2 * r["initial"] not in LEGAL) for r in rows),
                heads[0], heads[-1], _ways(rows, block == parts - 1)))
        cols = [list(x) for x in zip(*found)] if found else [[]] * 7
        yield pa.RecordBatch.from_arrays(
            [b.column(x) for x in ("c", "block", "parts")] + [pa.array(x, pa.int64()) for x in cols[:4]]
            + [pa.array(x, pa.string()) for x in cols[4:6]] + [pa.array(cols[6], _WAYS)],
            ["c", "block", "parts", "blank", "duplicate", "truncated", "illegal", "head", "tail", "ways"])


def _backwards(batches):
    """Blocks of a conversation from the last to the first: what is best from each state on."""
    c, cost = object(), None
    for b in batches:
        best = []
        for key, block, parts, ways in zip(*(b.column(x).to_pylist() for x in ("c", "block", "parts", "ways"))):
            if block == parts - 1:
                c, cost = key, {-1: 0}
            totals = [(w["cost"] + cost[w["leave"]], w["edits"], w) for w in ways if w["leave"] in cost]
            picks = [min((t for t in totals if t[2]["enter"] == q), key=itemgetter(0, 1), default=None)
                     for q in range(4)]
            cost = {q: p[0] for q, p in enumerate(picks) if p}
            best.append([p[2] for p in picks if p])
        yield b.drop_columns(["ways"]).append_column("ways", pa.array(best, _WAYS))


def _forwards(batches):
    """Blocks from the first to the last: the repair that is taken."""
    state, tail = 0, ""
    for b in batches:
        rows = []
        for block, parts, illegal, head, end, ways in zip(*(b.column(x).to_pylist() for x in (
                "block", "parts", "illegal", "head", "tail", "ways"))):
            if block == 0:
                state = 0
            else:
                illegal += tail + head not in LEGAL
            way = next(w for w in ways if w["enter"] == state)
            rows.append((illegal, way["cost"], way["edits"], state))
            state, tail = way["leave"], end
        cols = [list(x) for x in zip(*rows)] if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [b.column(x) for x in ("c", "block", "parts", "blank", "duplicate", "truncated")]
            + [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
               pa.array(cols[3], pa.int32())],
            ["c", "block", "parts", "blank", "duplicate", "truncated", "illegal", "cost", "edits", "enter"])


def _applied(id_type: pa.DataType):
    names = ["c", "block", "parts", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "edits", "enter",
             "rows"]

    def run(batches):
        for b in batches:
            ids, out, turns = [], [], []
            for c, *numbers, edits, enter, rows in _rows_of([b], names):
                rows.sort(key=itemgetter("pos"))
                ids.append(c)
                out.append((*numbers, edits))
                turns.append(repaired(edits, [(r["role"], r["text"]) for r in rows for _ in range(r["copies"])], enter))
            yield _batch(ids, id_type, out, turns)
    return run


def _schema(kind: str) -> str:
    cols = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in _OUT)
    return f"conv_id {kind}, {cols}, turns {_TURNS}"


def _joined(a: DataFrame, b: DataFrame, *more: str, how: str = "inner") -> DataFrame:
    """Joined by equality of conversations, null ids included, and of other columns; columns of ``a``
    first, then the other ones of ``b``."""
    right = b.withColumnsRenamed({m: f"_{m}" for m in ("c", *more)})
    on = F.col("c").eqNullSafe(F.col("_c"))
    for m in more:
        on &= F.col(m) == F.col(f"_{m}")
    return a.join(right, on, how).drop(*(f"_{m}" for m in ("c", *more)))


def _in_blocks(rows: DataFrame, block: int, kind: str, id_type: pa.DataType) -> DataFrame:
    """The repair of conversations of any size, in parts of ``block`` distinct rows."""
    there = rows.filter(F.col("copies") > 0).groupBy("c", *_ORDER).agg(F.sum("copies").alias("copies"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = store(_facts(by_range(there, "c", order, "pos")).withColumn("block", F.floor(F.col("pos") / block)))
    first = (placed.groupBy("c", "role", "text").agg(F.min("pos").alias("pos"))
             .select("c", "pos", F.lit(True).alias("first")))
    keys = placed.select("c", "block", "pos", F.left("role", F.lit(1)).alias("initial"), "copies", "blank", "truncated")
    keys = _joined(keys, first, "pos", how="left").withColumn("first", F.coalesce("first", F.lit(False)))
    ends = placed.groupBy("c").agg((F.max("block") + 1).alias("parts"))
    blocks = keys.groupBy("c", "block").agg(
        F.collect_list(F.struct("pos", "initial", "copies", "blank", "truncated", "first")).alias("rows"))
    blocks = _joined(blocks, ends)
    head = f"c {kind}, block long, parts long, {_COUNTS}, head string, tail string, ways array<struct<{_WAY}>>"
    solved = blocks.select("c", "block", "parts", "rows").mapInArrow(_blocks, head)
    solved = solved.repartition("c").sortWithinPartitions("c", F.desc("block")).mapInArrow(_backwards, head)
    solved = solved.repartition("c").sortWithinPartitions("c", "block").mapInArrow(
        _forwards, f"c {kind}, block long, parts long, {_COUNTS}, cost long, edits string, enter int")
    gaps = there.groupBy("c").agg(F.coalesce(
        F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("_gaps"))
    solved = _joined(solved, gaps).withColumn(
        "gaps", F.when(F.col("block") == 0, F.col("_gaps")).otherwise(0).cast("long"))
    texts = placed.groupBy("c", "block").agg(
        F.collect_list(F.struct("pos", "role", "text", "copies")).alias("rows"))
    out = _joined(solved, texts, "block").mapInArrow(_applied(id_type), _schema(kind))
    # a conversation of which nothing is left
    none = _joined(rows.select("c").distinct(), ends, how="left_anti").select(
        F.col("c").alias("conv_id"), F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("parts"),
        *(F.lit(0).cast("long").alias(n) for n, _ in _OUT[2:-1]), F.lit("").alias("audit"),
        F.array().cast(_TURNS).alias("turns"))
    return out.unionByName(none)


def repair_conversations(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Diagnose and repair the conversations of ``rows`` (as of ``undamaged`` or ``damaged``).

    (conv_id, part, parts, gaps, blank, duplicate, truncated, illegal, cost, audit, turns): a
    conversation of up to ``block`` rows is one part; a longer one is a part for each ``block`` distinct
    rows, whose numbers add up, and whose edits (``audit``) and repaired ``turns`` follow each other.

    Nulls: rows without a conv_id are one conversation; a null turn stands before all numbers and counts
    for no gap; a null role or text is one space, so that the row is blank or its role fits nowhere.
    Ties: rows of the same turn stand in the order of role and text.  Repeated rows stand next to each
    other, and all but the first are duplicates.  A conversation without rows (copies 0) has zeros, no
    edits and no turns.  An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    kind, id_type = dict(rows.dtypes)["c"], to_arrow_type(rows.schema["c"].dataType)
    small, large = split_by_size(rows, "c", block)
    out = (_facts(small).repartition("c").sortWithinPartitions("c", F.asc_nulls_first("turn"), "role", "text")
           .mapInArrow(_whole(id_type), _schema(kind)))
    return out if large is None else out.unionByName(_in_blocks(large, block, kind, id_type))


def _digests(id_type: pa.DataType):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "rendered", "n"]

    def run(batches):
        for c, group in groupby(_rows_of(batches, names), itemgetter(0)):
            sums, audit, sha, some = [0] * 6, [], hashlib.sha256(), False
            for _, *numbers, edits, rendered, n in group:
                sums = [a + b for a, b in zip(sums, numbers)]
                audit.append(edits)
                if n:
                    sha.update(("\n" * some + rendered).encode())
                    some = True
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], id_type), *(pa.array([x], pa.int64()) for x in sums),
                 pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], [*names[:8], "repaired_sha256"])
    return run


def repair_digests(parts: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each
    conversation of ``repair_conversations``.  The hash of several parts is taken in one pass over them."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind, id_type = dict(parts.dtypes)["conv_id"], to_arrow_type(parts.schema["conv_id"].dataType)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    rendered = F.concat_ws("\n", F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])))
    r = parts.select("conv_id", "part", "parts", *counts, "audit", rendered.alias("rendered"),
                     F.size("turns").alias("n"))
    one = r.filter(F.col("parts") == 1).select("conv_id", *counts, "audit",
                                               F.sha2("rendered", 256).alias("repaired_sha256"))
    more = (r.filter(F.col("parts") > 1).repartition("conv_id").sortWithinPartitions("conv_id", "part")
            .mapInArrow(_digests(id_type), f"conv_id {kind}, " + ", ".join(f"{x} long" for x in counts)
                        + ", audit string, repaired_sha256 string"))
    return one.unionByName(more)
