"""Columns called like the operators' own inner ones, ids of other types, repeated rows, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trustlens.llm import bestfit, bpe, chat, decontam, embed_dedup, minhash, pii, prefix_trie, repair, sharding
from trustlens.llm import tokencount, tokenpack, toxicity
from trustlens.llm.queries import tokenizer_file

from . import brute

NAMES = ("_h h _slot _shard _key_slot slot shard _terms _row row score predicted word words bits key cls sig node m n "
         "component least_id least_h ids size start piece length sequence_id offset _g _n _at _p _first _before pos c t "
         "part total turns wid term cands k none _a _b _own").split()
BYTES, WORDS = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")
TEXTS = ["the quick brown fox jumps over the lazy dog and runs " * 3, "mail ann@example.org about zorbat today",
         "mail ann@example.org about zorbat soon", "zorbat and ann@example.org again here", "", None, " ", "plain words only",
         "the quick brown fox jumps over the lazy dog and runs " * 3, "you vile stupid idiot scum"]
DOCS = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (7, "plain words only"), (3, "other text, same id")]
MODEL = toxicity.ToxicityModel(-5.0, {f: 4.0 for f in toxicity.word_features("idiot")})
ITEMS = [(1, "quick brown fox jumps over the lazy dog and runs the quick brown")]

OPERATORS = {
    "contamination": lambda d: decontam.contamination(d, items(d)),
    "drop_contaminated": lambda d: decontam.drop_contaminated(d, items(d)),
    "score": lambda d: toxicity.score_documents(d, MODEL),
    "drop_toxic": lambda d: toxicity.drop_toxic(d, MODEL),
    "personal_data": lambda d: pii.find_personal_data(d),
    "personal_data_joined": lambda d: pii.find_personal_data(d, most=0),
    "sanitise": lambda d: pii.sanitise_documents(d),
    "sanitise_joined": lambda d: pii.sanitise_documents(d, most=0),
    "shards": lambda d: sharding.assign_shards(d, "doc_id", ["a", "b", "c"], 101),
    "pack": lambda d: bestfit.pack_documents(d, WORDS).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "token_ids": lambda d: tokenpack.pack_token_ids(d.coalesce(1), BYTES).select("n_tokens", "ids"),
    "token_counts": lambda d: tokencount.count_tokens(d, BYTES),
    "near_duplicates": lambda d: minhash.near_duplicate_components(d),
    "keep_one": lambda d: minhash.keep_one_of_each(d),
    "bpe": lambda d: bpe.decode_documents(bpe.encode_documents(d, BYTES), BYTES),
}


def items(d):
    return d.sparkSession.createDataFrame([(*x, *range(len(NAMES))) for x in ITEMS], "item_id long, text string, "
                                          + ", ".join(f"{n} int" for n in NAMES))


def clashing(df):
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES) if n not in df.columns])


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_documents_with_clashing_columns(spark, name):
    plain = spark.createDataFrame(DOCS, "doc_id long, text string")
    want, got = OPERATORS[name](plain), OPERATORS[name](clashing(plain))
    kept = [c for c in want.columns if c not in NAMES or c not in got.columns or name not in ("shards",)]
    assert brute.count(got.select(*kept).collect()) == brute.count(want.select(*kept).collect())
    if name in ("drop_contaminated", "drop_toxic", "sanitise", "sanitise_joined", "keep_one"):
        assert got.columns == clashing(plain).columns
        for i, n in enumerate(NAMES):
            assert {r[n] for r in got.select(n).collect()} == {i}
    if name == "shards":
        assert got.columns == [c for c in clashing(plain).columns if c not in ("slot", "shard")] + ["slot", "shard"]
        assert {r["_slot"] for r in got.collect()} == {NAMES.index("_slot")}
    assert OPERATORS[name](clashing(plain).limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"pack"}))
def test_documents_with_text_ids(spark, name):
    df = spark.createDataFrame([(None if i is None else f"d{i}", t) for i, t in DOCS], "doc_id string, text string")
    assert OPERATORS[name](df).count() > 0
    if name == "token_ids":
        ids = tokenpack.pack_token_ids(df, BYTES).select(F.explode("doc_ids").alias("i")).collect()
        assert sorted(str(r["i"]) for r in ids) == sorted(str(r[0]) for r in df.select("doc_id").collect())


def test_key_that_is_called_like_a_result(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "slot string, v int")
    out = sharding.assign_shards(df, "slot", ["a", "b"], 11)
    assert out.columns == ["v", "slot", "shard"] and dict(out.dtypes)["slot"] == "int" and out.count() == 2


@pytest.mark.parametrize("run", [
    lambda d: chat.format_chats(d), lambda d: repair.repair_digests(repair.repair_conversations(repair.damaged(d), 2)),
    lambda d: prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.turns_in_order(d, 2)), 2)])
def test_conversations_with_clashing_columns(spark, run):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c % 3} {t}.") for c in range(12) for t in range(5)]
    plain = spark.createDataFrame(rows + [(1, None, None, None)] * 3, "conv_id long, turn long, role string, text string")
    assert brute.count(run(clashing(plain)).collect()) == brute.count(run(plain).collect())


def test_embeddings_with_clashing_columns(spark):
    rows = [(i, [1.0, 0.001 * i, 0.5], i % 2) for i in range(8)] + [(None, None, None)]
    plain = spark.createDataFrame(rows, "vec_id long, vec array<double>, label int").withColumnRenamed("vec", VEC)
    run = embed_dedup.embedding_near_duplicates
    assert brute.count(run(clashing(plain)).collect()) == brute.count(run(plain).collect())


VEC = "embedding"


def test_turns_of_one_number_are_many_parts(spark):
    """A null turn, 1,000 times: bounded parts, and nothing lost."""
    df = spark.createDataFrame([(1, None, "user", f"{i:04}") for i in range(1000)],
                               "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df, 100).orderBy("part").collect()
    assert [r["part"] for r in got] == list(range(10)) and {r["n_turns"] for r in got} == {100}
    assert "".join(r["rendered"] for r in got) == "".join(f"<|im_start|>user\n{i:04}<|im_end|>\n" for i in range(1000))


def test_the_training_bound_holds_for_rows(spark):
    """One labelled id on many rows, of two texts."""
    docs = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(
        F.lit("text "), (F.col("id") % 50).cast("string")).alias("text"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, lambda c: F.lit(False), 20)
    assert rows.count() == 20
    assert toxicity.training_rows(docs, labels, lambda c: F.lit(False)).count() == 50


def test_classes_with_null_or_shared_ids_meet_by_text(spark):
    """Rows that share or lack an id: the sets of a class come from its own text alone."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, f"{base} a{i}") for i in range(5)] + [(9, f"{base} b{i}") for i in range(5)] + [(None, f"z{i}") for i in range(20)]
    got = minhash.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got if r["n_shingles"] > 50} == {9}


def test_pipeline_stages_on_odd_tables(spark, tmpdir_run):
    """Null ids, empty texts, repeated rows, and no rows at all."""
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmpdir_run}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmpdir_run}/labels.parquet")
    full = clashing(spark.createDataFrame(DOCS + DOCS[:3], "doc_id long, text string"))
    for docs in (full, full.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, tmpdir_run)
            assert name == "packing" or out.columns == docs.columns
            assert (out.count() > 0) == (docs is full)
