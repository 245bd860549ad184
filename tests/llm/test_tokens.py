import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from trustlens.llm import bestfit, sharding, tokencount, tokenpack
from trustlens.llm.queries import tokenizer_file
from trustlens.llm.tokens import ByteEncoder, WordEncoder

from . import brute

BYTES, WORDS = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    letters = "ab'st ,.\n\t\r12é中  \x0b\x1cΣ½²_́"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(n)] + [
        "", " ", "x <|endoftext|> y", "<|startoftext|>", "don't 'S it's", "THANEA. thanea, Thanea!!", "ΑΣ ΑΣ."]


@pytest.mark.parametrize("kind, file", [(ByteEncoder, BYTES), (WordEncoder, WORDS)])
def test_pieces_give_the_tokenizer_s_ids(kind, file, monkeypatch):
    from trustlens.llm import tokens
    monkeypatch.setattr(tokens, "MEMO_PIECES", 500)
    tok, enc = Tokenizer.from_file(file), kind(file)
    for t in odd_texts(4000):
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def count_rows():
    rng = random.Random(2)
    words = " ".join(rng.choice(["alpha", "beta.", "it's", "Ça", "x\ny", "  ", "中文"]) for _ in range(3000))
    return [(1, words), (2, words.replace(" ", "")), (3, "a" * 9000), (4, " " * 5000 + "b" * 200), (5, None), (6, ""),
            (None, "hello world"), (7, "hello world"), (7, "hello world"),
            (8, " ".join(["w" * 700] * 8)), (9, "<|endoftext|> " * 600)] + list(enumerate(odd_texts(200, 5), 100))


def test_token_counts_match_the_library(docs):
    tok = Tokenizer.from_file(BYTES)
    rows = count_rows()
    want = brute.count((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids),
                        len(tok.encode(t or "", add_special_tokens=False).ids) > 1024) for i, t in rows)
    # the second has most texts spliced, and texts without a stable position widened
    for chunk, overlap in ((tokencount.CHUNK, tokencount.OVERLAP), (300, 60)):
        got = tokencount.count_tokens(docs(rows), BYTES, chunk=chunk, overlap=overlap)
        assert brute.count(got.collect()) == want
    assert tokencount.count_tokens(docs([]), BYTES).count() == 0


def test_no_stable_position_means_no_splice():
    text = "word" * 50
    assert tokencount._stable(text, list(range(len(text))), 0, 100) == ([], [])
    assert tokencount._stable("ab cd", [0, 2], 0, 5) == ([2], [1])
    assert tokencount._stable("ab cd", [0, 1], 0, 5) == ([], [])


def pack_rows():
    rng = random.Random(6)
    return [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 3, 20, 60, 90])))) for i in range(300)] + [
        (900, None), (901, ""), (None, "a b"), (902, "a b"), (902, "a b"), (903, "y " * 5000)]


def test_best_fit_packs_every_id_once(docs, monkeypatch):
    monkeypatch.setattr(bestfit, "ROWS_PER_SALT", 40)
    size, tok = 64, Tokenizer.from_file(WORDS)
    want, total = [], 0
    for i, t in pack_rows():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        want += [(i, k // size, k, len(ids[k:k + size]), zlib.crc32(ids[k:k + size].tobytes()))
                 for k in range(0, len(ids), size)]
    got = bestfit.pack_documents(docs(pack_rows()), WORDS, size, with_ids=True).collect()
    assert brute.count(r[:5] for r in got) == brute.count(want)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
    n = brute.lengths_are_packed([(r["sequence_id"], r["offset"], r["length"]) for r in got], size)
    assert n <= 1.03 * -(-total // size)
    assert bestfit.pack_documents(docs([]), WORDS, size).count() == 0


def test_sweep_takes_the_largest_that_fits_and_resolves_by_rank():
    from collections import Counter
    stock, taken = {5: 1, 3: 4}, Counter()
    assert bestfit.sweep({6: 2, 4: 1}, stock, taken) == [(4, 0, 1, 3, 1, 0), (6, 0, 1, 5, 1, 0), (6, 1, 2, 3, 2, 1)]
    assert stock == {5: 0, 3: 1}


def test_ranks_are_dense_within_a_size(spark, monkeypatch):
    monkeypatch.setattr(bestfit, "ROWS_PER_SALT", 10)
    rows = spark.range(200).selectExpr("id AS k", "IF(id % 3 = 0, id % 7, 2) AS s")
    by = {}
    for r in bestfit.ranked(rows, "s", "k", 200).collect():
        by.setdefault(r["s"], []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_segment_tree_finds_the_least_room():
    rng, tree, held = random.Random(4), tokenpack.RoomTree(100), []
    for _ in range(2000):
        if held and rng.random() < 0.5:
            tree.add(held.pop(rng.randrange(len(held))), -1)
        else:
            held.append(rng.randrange(101))
            tree.add(held[-1], 1)
        x = rng.randrange(101)
        assert tree.least(x) == min((h for h in held if h >= x), default=-1)


def test_best_fit_decreasing_places_each_piece():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 65) for _ in range(500)]
    seqs = tokenpack.best_fit_decreasing(lengths, 64)
    assert sorted(i for s in seqs for i in s) == list(range(500))
    assert all(sum(lengths[i] for i in s) <= 64 for s in seqs)
    assert len(seqs) <= 1.05 * -(-sum(lengths) // 64)


@pytest.mark.parametrize("file", [BYTES, tokenizer_file("byte_bpe_50k.tiktoken")])
def test_packed_ids_round_trip(docs, file):
    tok, size = Tokenizer.from_file(BYTES), 64
    packed = tokenpack.pack_token_ids(docs(pack_rows()), file, size, window=500)
    rows = tokenpack.id_matrix(packed, size, pad_id=7).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    pieces = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == size and (ids[r["n_tokens"]:] == 7).all() and r["cu_seqlens"][-1] == r["n_tokens"]
        assert r["position_resets"] == r["cu_seqlens"][:-1]
        for d, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:]):
            pieces.setdefault(d, []).append((s, ids[a:b].tolist()))
    want = {}
    for i, t in pack_rows():
        want.setdefault(i, []).append(tok.encode(t or "", add_special_tokens=False).ids + [50256])
    for d, whole in want.items():
        parts = sorted(pieces[d])
        if len(whole) == 1:
            assert [x for _, p in parts for x in p] == whole[0]
        else:
            assert [p for _, p in parts] == whole
    assert tokenpack.pack_token_ids(docs([]), BYTES, size).count() == 0


def test_shares_are_even_and_few_slots_move():
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 1009)
    n = brute.Counter(table)
    assert max(n.values()) - min(n.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.15 * 1009
    assert all(0 <= x < 7 for x in table)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1008)


def test_assignment_matches_the_table_and_keeps_rows(spark):
    import hashlib
    df = spark.createDataFrame([(i, "old") for i in range(300)] + [(None, "n"), (5, "again")], "doc_id long, slot string")
    names = ["a", "b", "c"]
    table = sharding.lookup_table(names, 101)
    got = sharding.assign_shards(df, "doc_id", names, 101).collect()
    assert len(got) == 302
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, names[table[slot]])
    assert sharding.assign_shards(df.limit(0), "doc_id", names, 101).count() == 0


def test_the_table_is_filled_in_turns():
    """An independent fill: a shard's next free slot is the first free one of its whole preference order."""
    import hashlib

    def number(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:16], 16)
    for names, size in ((["a", "b", "c"], 11), ([f"n{i}" for i in range(5)], 101), ([f"shard-{i:02d}" for i in range(48)], 1009),
                        (["only"], 2)):
        orders = []
        for s in names:
            start, skip = number(f"offset:{s}") % size, number(f"skip:{s}") % (size - 1) + 1
            orders.append([(start + j * skip) % size for j in range(size)])
            assert sorted(orders[-1]) == list(range(size))  # a permutation
        owner, turn = {}, 0
        while len(owner) < size:
            owner[next(x for x in orders[turn % len(names)] if x not in owner)] = turn % len(names)
            turn += 1
        assert sharding.lookup_table(names, size) == [owner[i] for i in range(size)]


def test_the_registered_table_is_the_independent_one():
    """Production parameters, with a pointer into each preference order."""
    import hashlib

    from trustlens.llm import queries
    size, names = sharding.TABLE_SIZE, queries.SHARDS
    digest = lambda t: int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big")
    free, at, owner = set(range(size)), [0] * len(names), [None] * size
    turn = 0
    while free:
        i = turn % len(names)
        while True:
            slot = (digest(f"offset:{names[i]}") % size + at[i] * (digest(f"skip:{names[i]}") % (size - 1) + 1)) % size
            at[i] += 1
            if slot in free:
                break
        free.remove(slot)
        owner[slot] = i
        turn += 1
    assert sharding.lookup_table(names) == owner


def test_written_shards_hold_every_row(spark, tmpdir_run):
    df = spark.range(200).withColumnRenamed("id", "doc_id")
    sharding.write_shards(df, "doc_id", ["a", "b"], tmpdir_run + "/out", 101, files_per_shard=3)
    back = spark.read.parquet(tmpdir_run + "/out")
    assert back.count() == 200 and {r["shard"] for r in back.select("shard").distinct().collect()} == {"a", "b"}
