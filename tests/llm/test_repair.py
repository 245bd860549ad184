import hashlib
import random
import re
import zlib

import pytest

import __spark_entry__ as entry
from trustlens.llm import repair

from .test_queries import SF, sql

COLS = "conv_id long, turn long, role string, text string, c int, part string, pos int, block int, ways int"


def damage(rows):
    """(conv, turn, role, text) after the damage."""
    out = []
    for c, t, r, x in rows:
        m = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if m == 1 else re.sub("[.!?]", "", x) if m == 2 else x
        out += [(c, t, "user" if m == 4 else r, x)] * (0 if m == 0 else 2 if m == 3 else 1)
    return out


def cheapest(items):
    """items: (initial, forced, truncated) -> (cost, edits) by dynamic programming over whole strings."""
    nxt = {0: 2, 1: 2, 2: 3, 3: 2}
    keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    best = {q: ((0, "") if q in (0, 3) else (10**9, "")) for q in range(4)}
    for i in range(len(items), -1, -1):
        new = dict(best) if i == len(items) else {}
        if i < len(items):
            initial, forced, truncated = items[i]
            for q in range(4):
                ways = [(best[q][0] + 2, "D" + best[q][1])]
                if not forced:
                    extra = 5 * truncated
                    k = keep.get((initial, q))
                    if k is not None:
                        ways.append((best[k][0] + extra, "K" + best[k][1]))
                    ways.append((best[nxt[q]][0] + 1 + extra, "R" + best[nxt[q]][1]))
                new[q] = min(ways)
        for _ in range(4):  # inserted turns
            new = {q: min(new[q], (new[nxt[q]][0] + 5, "I" + new[nxt[q]][1])) for q in range(4)}
        best = new
    return best[0]


def brute(rows):
    """conv -> what op11 returns."""
    out = {}
    after = damage(rows)
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = {r[1] for r in mine if r[1] is not None}
        seen, items, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in mine:
            core = text.strip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not core else "duplicate" if (role, text) in seen
                     else "truncated" if core[-1] not in ".!?" else None)
            seen.add((role, text))
            if fault:
                n[fault] += 1
            items.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(items, items[1:]))
        cost, edits = cheapest(items)
        fixed, at, q = [], 0, 0
        for e in edits:
            if e != "D":
                q = {"s": 1, "u": 2, "a": 3}[mine[at][2][0]] if e == "K" else 3 if q == 2 else 2
                role = mine[at][2] if e == "K" else "user" if q == 2 else "assistant"
                fixed.append(role + ":" + ("" if e == "I" else mine[at][3]))
            at += e != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(f[0] for f in fixed))
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"],
                  n["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(fixed).encode()).hexdigest())
    return out


def odd_rows(seed=5):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "unknown", "admin"]
    texts = ["Yes.", "no", "Why?  \n", " ", "", None, "a.b", "!", "x\x0b", "é。", "Hm !"]
    rows = []
    for c in [*range(60), None]:
        for t in range(rng.randrange(1, 14)):
            for _ in range(rng.choice([1, 1, 1, 2])):
                rows.append((c, rng.choice([t, t, t * 3, None]), rng.choice(roles[:3] * 3 + roles), rng.choice(texts)))
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 90}.") for t in range(300)]
    rows += [(101, 5, "user", "same.")] * 40 + [(102, None, "system", "s.")] * 9
    return rows + [(200 + i, 0, "user", "hi.") for i in range(60)]


def test_auction_is_the_cheapest_and_least():
    rng = random.Random(2)
    for _ in range(1500):
        items = [(rng.choice("suasuaXt"), rng.random() < .15, rng.random() < .25) for _ in range(rng.randrange(12))]
        items = [(i, f, t and not f) for i, f, t in items]
        got = repair.auction([repair.kind_of(i, f, t) for i, f, t in items], [1] * len(items))
        assert got == cheapest(items), items


def test_prices_bound_the_cost():
    """A long alternating conversation costs nothing, whatever its length, and is walked once."""
    kinds = ["s"] + ["u", "a"] * 20_000
    assert repair.auction(kinds, [1] * len(kinds)) == (0, "K" * len(kinds))


@pytest.mark.parametrize("block", [256, 7, 1])
def test_conversations_against_brute_force(spark, block):
    """Whole conversations, and conversations in many blocks."""
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], COLS)
    parts = repair.repair_conversations(repair.damaged(df), block)
    got = repair.repair_digests(parts).collect()
    want = brute(rows)
    assert len(got) == len(want)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want
    if block == 1:
        by = {}
        for r in sorted(parts.collect(), key=lambda r: r["part"]):
            by.setdefault(r["conv_id"], []).extend(t["role"][0] for t in r["turns"])
        assert all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in by.values())


def test_empty_and_undamaged(spark):
    df = spark.createDataFrame([], COLS)
    assert repair.repair_digests(repair.repair_conversations(repair.damaged(df))).count() == 0
    df = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Yes.")],
                               "conv_id string, turn int, role string, text string")
    r = repair.repair_conversations(repair.undamaged(df)).first()
    assert (r["conv_id"], r["audit"], r["cost"]) == ("a", "KK", 0)
    assert [(t["role"], t["text"]) for t in r["turns"]] == [("user", "Hi."), ("assistant", "Yes.")]


def test_the_registered_query(spark):
    rows = sql("SELECT conv_id, turn, role, text FROM conversations")[1]
    got = entry.queries()["op11_conversation_structure_repair"](spark, SF).collect()
    want = brute(rows)
    assert len(got) == len(want) and {r["conv_id"]: tuple(r)[1:] for r in got} == want
