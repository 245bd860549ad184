import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from trustlens.llm import prefix_trie
from trustlens.llm.common import store

from .test_queries import SF, sql

COLS = "conv_id long, turn long, role string, text string, c int, depth int, pos int, steps string, n int"


def as_turns(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [v[2:] for v in sorted(vs)] for c, vs in by.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(first, [])[:h] + turns[h:]
    return out


def brute(convs):
    """Counter of the rows of the trie."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids[node])
    return Counter((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node],
                    saved[node], hashlib.sha256(",".join(
                        str(c) for c in sorted(m) if len(convs[c]) == len(node)).encode()).hexdigest())
                   for node, m in members.items())


def odd_rows(seed=4):
    rng = random.Random(seed)
    rows = []
    texts = ["a b", "", None, "c", " d\te ", "a b"]
    for c in [*range(-30, 150)]:
        for t in range(rng.randrange(1, 8)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += [(None, 0, "user", "a b")] * 3
    rows += [(c, t, "user", "hi there") for c in range(1000, 1040) for t in range(3)]  # copies
    shared = [(t, "user", f"w{t} x") for t in range(80)]
    for c, n in ((2001, 80), (2003, 80), (2007, 75), (2011, 33), (2013, 79)):  # long common beginnings
        rows += [(c, *s) for s in shared[:n]] + [(c, 90, "user", f"end {c}")]
    return rows + [(3001, t, "user", f"only {t}") for t in range(600)]


@pytest.mark.parametrize("most", [4096, 5])
@pytest.mark.parametrize("how", ["rebuilt", "as_logged"])
def test_against_brute_force(spark, how, most):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, 2, 3, "x", 4) for r in rows], COLS)
    turns = store(prefix_trie.turns_in_order(df, most))
    got = prefix_trie.prefix_trie(*getattr(prefix_trie, how)(turns), most)
    want = as_turns(rows)
    assert Counter(map(tuple, got.collect())) == brute(rebuilt(want) if how == "rebuilt" else want)


def test_bands_cover_all_depths(spark):
    d = spark.range(1, 2000).select("id", prefix_trie._band(prefix_trie.F.col("id")).alias("b")).collect()
    assert all(prefix_trie._top(r["b"]) < r["id"] <= prefix_trie._top(r["b"] + 1) for r in d)
    assert all(prefix_trie._top(b + 1) - prefix_trie._top(b) <= prefix_trie.WIDEST for b in range(20))


def test_empty_and_turnless(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    turns = prefix_trie.turns_in_order(df)
    assert prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns)).count() == 0
    one = next(c for c in range(1, 19) if zlib.crc32(str(c).encode()) % 4)  # no first conversation: nothing is left
    df = spark.createDataFrame([(one, 0, "user", "x")], df.schema)
    rows = prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.turns_in_order(df))).collect()
    assert [tuple(r) for r in rows] == [(one, 0, None, 1, 0, 1, 0, hashlib.sha256(str(one).encode()).hexdigest())]


def test_the_registered_query(spark):
    want = brute(rebuilt(as_turns(sql("SELECT conv_id, turn, role, text FROM conversations")[1])))
    got = entry.queries()["op12_conversation_prefix_trie"](spark, SF)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                           "ends_sha256"]
    assert Counter(map(tuple, got.collect())) == want
