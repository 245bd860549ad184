"""The registered queries over the small tables, against SQL or brute force."""

import zlib

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from trustlens.llm import queries

from . import brute

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def sql(q):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = c.execute(q)
    return [d[0] for d in r.description], r.fetchall()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    names, want = sql(queries.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert brute.count(got.select(*names).collect()) == brute.count(want)


def documents():
    return sql("SELECT doc_id, text FROM documents")[1]


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))


def test_op10(spark):
    got = entry.queries()["op10_minhash_near_dedup"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute.near_duplicates(documents())


def test_op1(spark):
    from .test_dedup import expected
    rows = sql("SELECT vec_id, embedding, label FROM embeddings")[1]
    got = entry.queries()["op1_embedding_near_dedup"](spark, SF).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == expected(rows)
    assert len(got) == len(rows)


def test_op7(spark):
    import numpy as np
    from tokenizers import Tokenizer
    tok, want, total = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json")), [], 0
    for i, t in documents():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        want += [(i, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes()))
                 for k in range(0, len(ids), 2048)]
    got = entry.queries()["op7_best_fit_packing"](spark, SF).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()
    assert brute.count(r[:5] for r in got) == brute.count(want)
    n = brute.lengths_are_packed([(r["sequence_id"], r["offset"], r["length"]) for r in got], 2048)
    assert n <= 1.03 * -(-total // 2048) + 1


def test_op8(spark):
    import numpy as np
    from tokenizers import Tokenizer
    tok, pieces = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json")), {}
    tok.encode_special_tokens = True
    for r in entry.queries()["op8_packed_token_ids"](spark, SF).collect():
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["n_tokens"] == r["cu_seqlens"][-1] <= 2048
        for d, at, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            pieces.setdefault(d, []).append((at, ids[a:b].tolist()))
    whole = {d: [x for _, part in sorted(parts) for x in part] for d, parts in pieces.items()}
    assert whole == {i: [*tok.encode(t or "", add_special_tokens=False).ids, 50256] for i, t in documents()}


def test_op4_and_op5_and_op9(spark):
    q = entry.queries()
    tox = {r["doc_id"]: r for r in q["op4_toxicity"](spark, SF).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
               and r["predicted"] == int(r["score"] >= 0.3) for i, r in tox.items())
    import hashlib
    kinds = ("email", "ip", "card", "phone")
    want = {}
    for i, t in documents():
        s = brute.personal_data(t or "")
        n = brute.Counter(k for _, k, _ in s)
        want[i] = (*(n[k] for k in range(4)),
                   hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in s).encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:6] for r in q["op5_personal_data"](spark, SF).collect()} == want
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    assert {r["doc_id"]: r["n_tokens"] for r in q["op9_token_counts"](spark, SF).collect()} == {
        i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in documents()}


def test_pipeline_against_brute_force(spark):
    """Each stage on what the one before kept."""
    from trustlens.llm import pii, toxicity
    from trustlens.llm.common import store, table
    entry._prepare(spark)
    docs, kept = table(spark, SF, "documents"), []
    model = toxicity.train(docs, table(spark, SF, "labels"), queries.held_out)
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SF))
        kept.append(docs)
        assert docs is kept[-1] and (len(kept) == 5 or docs.columns == columns)
    rows = [[(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()] for d in kept[:4]]
    memo = toxicity._Memo(toxicity.word_of)
    clean = [(i, t) for i, t in documents() if model.score(toxicity.text_words(t, memo)) < 0.3]
    assert sorted(rows[0]) == sorted(clean)
    near = brute.near_duplicates(rows[0], corpus_pipeline.SHINGLE_WORDS)
    assert sorted(i for i, _ in rows[1]) == sorted(i for i, x in near.items() if x[2])
    bad = {i for i, n, hit, _ in brute.contamination(rows[1], sql("SELECT item_id, text FROM benchmark")[1])
           if hit and 20 * hit >= n}
    assert sorted(rows[2]) == sorted((i, t) for i, t in rows[1] if i not in bad)
    terms = {r["word"]: r["bits"] for r in pii.disclosing_terms(kept[2]).collect()}
    assert sorted(rows[3]) == sorted((i, pii.sanitise(t, pii.all_spans(t, terms), terms)) for i, t in rows[2])
    assert all(r["n_chars"] == len(r["text"]) for r in kept[3].collect())
    packed = kept[4].collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in rows[3]}
    total = sum(r["length"] for r in packed)
    n = brute.lengths_are_packed([(r["sequence_id"], r["offset"], r["length"]) for r in packed], 2048)
    assert n <= 1.03 * -(-total // 2048) + 1
