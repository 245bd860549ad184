import hashlib
import random
from array import array

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from trustlens.llm import bpe
from trustlens.llm.queries import tokenizer_file

from . import brute
from .test_queries import SF, documents

FILE = tokenizer_file("byte_bpe_50k.json")
TOK = Tokenizer.from_file(FILE)


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    letters = "abst'ren ,.\n\t\r12é中  \x0b\x1cΣ½²_́"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)] + [
        "", " ", "x <|endoftext|> y", "<|endoftext|>", "<|endoftext|><|endoftext|> <|endoftext|>\n", "<|endoftext",
        "a" * 3000, "abab" * 500, " " * 70 + "b", "the the\nthe, the. 'The", "Ͱ ʰ ªº Ⅷ", "👩‍👩‍👧 e\u0301"]


def ids(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("vector, memo, chars", [(1, 100, 50), (10**9, 10**6, 10**6), (48, 3000, 4000)])
def test_ids_are_the_library_s(monkeypatch, vector, memo, chars):
    """Lists worked through as vectors or one by one, memos that overflow, small groups of texts."""
    monkeypatch.setattr(bpe, "VECTOR", vector)
    monkeypatch.setattr(bpe, "MEMO_WORDS", memo)
    enc = bpe.BatchEncoder(FILE)
    texts = odd_texts(3000) + [t for _, t in documents() if t][:60]
    for i in range(0, len(texts), chars):
        part = texts[i:i + chars]
        for t, x in zip(part, enc.encode(part)):
            assert array("I", x).tolist() == ids(t), t


def test_one_index_for_many_words_equals_one_for_each():
    merges = bpe.Merges(FILE)
    words = sorted({w for t in odd_texts(400) for w in t.encode().split()})
    assert merges.encode_all(words) == [merges.encode_all([w])[0] for w in words]
    assert merges.encode_all([]) == []


def test_merges_out_of_order_are_refused(tmp_path):
    import json
    spec = json.load(open(FILE))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Merges(str(tmp_path / "t.json"))


ROWS = [(1, None), (2, ""), (None, "no id"), (3, "twice  twice"), (3, "twice  twice"), (4, " \n\t"),
        (5, "word " * 40_000), (6, "x" * 20_000), (7, "<|endoftext|> a")]


def test_documents(spark, docs):
    got = bpe.decode_documents(bpe.encode_documents(docs(ROWS), FILE), FILE)
    assert got.columns == ["doc_id", "ids", "text"]
    assert brute.count((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4")), r["text"]) for r in got.collect()) == \
        brute.count((i, tuple(ids(t)), TOK.decode(ids(t), skip_special_tokens=False)) for i, t in ROWS)
    assert bpe.encode_documents(docs([]), FILE).count() == 0
    # text ids, and extra columns with the names of the results
    named = spark.createDataFrame([("a", "b c", b"1", 2)], "doc_id string, text string, ids binary, n_tokens int")
    assert [tuple(r) for r in bpe.encode_documents(named, FILE).collect()] == [
        ("a", array("I", ids("b c")).tobytes())]


def test_decode_of_any_ids(spark):
    """Ids that end inside a character, null ids, ids that are no symbol."""
    rows = [(1, [233, 50256, 65]), (2, ids("é")[:1] + [5]), (3, None), (4, [])]
    df = spark.createDataFrame([(i, None if x is None else array("I", x).tobytes()) for i, x in rows],
                               "doc_id long, ids binary")
    assert {r["doc_id"]: r["text"] for r in bpe.decode_documents(df, FILE).collect()} == {
        i: TOK.decode(x or [], skip_special_tokens=False) for i, x in rows}
    beyond = spark.createDataFrame([(1, array("I", [60000, 65]).tobytes())], "doc_id long, ids binary")
    assert bpe.decode_documents(beyond, FILE).first()["text"] == TOK.decode([60000, 65])


def test_the_registered_query(spark):
    def sha(x):
        return hashlib.sha256(x).hexdigest()
    want = {i: (len(ids(t)), sha(array("I", ids(t)).tobytes()),
                sha(TOK.decode(ids(t), skip_special_tokens=False).encode())) for i, t in documents()}
    got = entry.queries()["op13_bpe_encode_decode"](spark, SF).collect()
    assert len(got) == len(want) and {r["doc_id"]: tuple(r)[1:] for r in got} == want
