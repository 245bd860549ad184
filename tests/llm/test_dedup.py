import math
import random

import numpy as np

from trustlens.llm import buckets, components, embed_dedup, minhash
from trustlens.llm.shingles import Signer, shingle_set, word_hashes

from . import brute


def vec_rows():
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for label in (1, 2, None):
        for _ in range(12):
            v = rng.standard_normal(16)
            for noise in (0.0, 0.0, 0.03, 0.05, 0.08):
                w = v + noise * np.linalg.norm(v) / 4 * rng.standard_normal(16)
                rows.append((n, [float(x) for x in w], label))
                n += 1
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [math.nan] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1),
             (904, [], 1), (905, [math.inf] * 16, 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (908, [1.0, 2.0], 2)]
    return rows


def expected(rows):
    def unit(v):
        if not v or None in v:
            return None
        x = np.array(v, dtype=float)
        return x / np.linalg.norm(x) if np.isfinite(x).all() and x.any() else None
    u = {i: unit(v) for i, v, _ in rows}
    label = {i: y for i, _, y in rows}
    links = [(a, b) for a in u for b in u if a < b and label[a] is not None and label[a] == label[b]
             and u[a] is not None and u[b] is not None and len(u[a]) == len(u[b]) and u[a] @ u[b] >= 0.98]
    c = brute.components(u, links)
    n = brute.Counter(x for link in links for x in link)
    return {i: (n[i], c[i], c[i] == i) for i in u}


SCHEMA = "vec_id long, embedding array<double>, label int, node long, codes string"


def test_embeddings_match_brute_force_with_edge_cases(spark):
    rows = vec_rows()
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    for block in (1024, 2):
        got = embed_dedup.embedding_near_duplicates(df, block=block).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == expected(rows)
        assert len(got) == len(rows)


def test_embeddings_null_id_repeated_rows_and_empty(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(None, v, 1, 0, ""), (5, v, 1, 0, ""), (5, v, 1, 0, ""), (7, v, 2, 0, "")], SCHEMA)
    got = brute.count((r["vec_id"], r["n_links"], r["component_id"], r["kept"])
                      for r in embed_dedup.embedding_near_duplicates(df).collect())
    assert got == {(None, 2, 5, False): 1, (5, 2, 5, True): 2, (7, 0, 7, True): 1}
    assert embed_dedup.embedding_near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_chain_a_star_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 200), (None, 3)]
    got = {r["id"]: r["component"] for r in components.connected_components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_local_roots():
    assert buckets.local_roots(6, np.array([4, 1, 5]), np.array([1, 0, 3])).tolist() == [0, 0, 2, 3, 0, 3]


def test_word_hashes_agree_with_words():
    rng = random.Random(1)
    seen = {}
    texts = ["", " ", "a", "A  b\x0bc\x1cd", "é É Éa a"] + ["".join(rng.choice("aAb c\t\né") for _ in range(40))
                                                          for _ in range(300)]
    for t in texts:
        words, h = t.encode().lower().split(), word_hashes(t).tolist()
        assert len(words) == len(h)
        for w, x in zip(words, h):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    long = "x" * 1_500_000 + " y " + "ab " * 500_000  # a word longer than a block
    assert word_hashes(long)[1] == word_hashes("y")[0] and len(word_hashes(long)) == 500_002


def test_pairs_within_the_signature_distance_share_a_key():
    import pyarrow as pa
    rng = np.random.default_rng(2)
    k, d = minhash.PLACES, minhash.DISTANCE
    a = rng.integers(0, 1 << 16, (50, k)).astype("<u2")
    b = a.copy()
    for row in b:
        at = rng.choice(k, d, replace=False)
        row[at] ^= 1
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(100)), pa.array([x.tobytes() for x in np.concatenate([a, b])])], ["node", "sig"])
    keys = next(minhash._index_keys(k, d)([batch])).column("key").to_numpy().reshape(100, k)
    assert all(set(keys[i]) & set(keys[50 + i]) for i in range(50))


def test_signature_is_the_minimum_over_the_set():
    s = Signer(8, 16)
    x, y = shingle_set("a b c d e f g"), shingle_set("g h i j")
    whole = shingle_set("a b c d e f g h i j")
    assert (s.sign(np.union1d(x, y)) == s.sign(whole)).all()


def texts():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(14):
        base = [rng.choice(words) for _ in range(60)]
        for edits in (0, 0, 1, 2, 3, 4, 6, 9):
            w = base[:]
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((n, " ".join(w)))
            n += 1
    for i in range(30):  # a chain: each like the next, the ends not like each other
        rows.append((500 + i, " ".join(words[2 * i:2 * i + 60])))
    return rows + [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "One  two"),
                   (906, "one two"), (907, "x " * 20_000), (908, "X\n" * 20_001)]


def test_near_duplicates_match_brute_force_with_edge_cases(docs):
    rows = texts()
    for block in (1024, 3):
        got = minhash.near_duplicate_components(docs(rows), block=block).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute.near_duplicates(rows)
        assert len(got) == len(rows)


def test_near_duplicates_null_ids_repeats_and_empty(docs):
    df = docs([(None, "a b c"), (4, "a b c"), (4, "a b c"), (4, "z y x"), (None, "q r"), (None, None)])
    got = brute.count((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])
                      for r in minhash.near_duplicate_components(df).collect())
    assert got == {(None, 2, 4, False): 1, (4, 2, 4, True): 3, (None, 1, None, True): 1, (None, 0, None, True): 1}
    assert minhash.near_duplicate_components(df.limit(0)).count() == 0
    one = minhash.keep_one_of_each(df)
    assert one.columns == df.columns
    assert brute.count((r["doc_id"], r["text"]) for r in one.collect()) == {
        (4, "a b c"): 1, (4, "z y x"): 1, (None, "q r"): 1, (None, None): 1}
