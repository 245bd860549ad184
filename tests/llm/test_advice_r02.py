"""Cases of the second review, each of which failed before its finding was settled."""

import re

import corpus_pipeline
from trustlens.llm import minhash, pii
from trustlens.llm.shingles import shingle_set

from . import brute

SF = "/root/testdata/sf0.001"


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", brute.lower(text))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def kept_ids(rows, n):
    sets = {i: shingles(t, n) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    c = brute.components(sorted(sets), links)
    return sorted(i for i in sets if c[i] == i)


def test_pipeline_near_duplicates_are_by_five_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert got == kept_ids(rows, 5) != kept_ids(rows, 2)


def test_shingles_of_other_lengths(docs):
    for n in (1, 2, 3, 5):
        for t in ("", "a", "a b", "A b  c", "a b c d e", "a b a b a b a b", "p q r s t u v w x"):
            assert len(shingle_set(t, n)) == len(shingles(t, n))
    rows = [(1, "a b c"), (2, "A b  c"), (3, "a b d"), (4, None), (5, "a b c d e"), (6, "a b c d")]
    got = {r["doc_id"] for r in minhash.keep_one_of_each(docs(rows), words=5).collect()}
    assert got == {1, 3, 4, 5, 6}


def test_co_occurrence_counts_documents(docs):
    terms = lambda rows: {r["word"]: r["bits"] for r in pii.disclosing_terms(docs(rows)).collect()}
    word = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:04d}")
    far = " ".join(["-"] * 20)
    # one long document is one document, however many lines it has
    long = [(0, f" {far} ".join(f"{word(i)} report 10.1.2.3 {word(i + 5000)}" for i in range(60)))]
    assert terms(long + [(1 + i, "a report") for i in range(100)]) == {}
    # 4 of 16 documents are two bits, although the four hold eight contexts
    four = [(i, f" {far} ".join(f"{word(9 * i + k)} report 10.1.2.3" for k in (0, 1))) for i in range(4)]
    assert terms(four + [(9 + i, "a report") for i in range(12)]) == {}
    # 4 of 5 documents are less than one bit and never less than none
    assert abs(terms(four + [(9, "a report")])["report"] - 0.32192809) < 1e-6
    assert terms(four)["report"] == 0.0
