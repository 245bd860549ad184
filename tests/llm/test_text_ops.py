import hashlib
import random

from pyspark.sql import functions as F

from trustlens.llm import chat, decontam, pii, toxicity
from trustlens.llm.queries import held_out

from . import brute

CHAT = "conv_id long, turn long, role string, text string, c long, total long"


def chats(spark, rows):
    return spark.createDataFrame([(*r, 9, 9) for r in rows], CHAT)


def test_chats_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        start = rng.randrange(4)
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"s{start} t{t}"))
    rows += [(100, 0, None, None), (100, None, "user", "x"), (101, 0, "unknown", ""), (101, -1, "user", "x"),
             (102, 0, "user", "a"), (102, 0, "user", "a"), (102, 0, "user", "b"), (103, 0, "user", "b"),
             (103, 0, "user", "a"), (103, 1, "user", ""), (None, 0, "user", "alone"), (104, 0, "user", "a" * 100_000)]
    want = brute.maximal_chats(rows)
    for slices in (256, 2):
        got = chat.format_chats(chats(spark, rows), slices).orderBy("part").collect()
        text = {}
        for r in got:
            text[r["conv_id"]] = text.get(r["conv_id"], "") + r["rendered"]
            assert r["total_turns"] == len(want[r["conv_id"]])
        assert text == {c: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for _, r, x in v) for c, v in want.items()}
    assert chat.format_chats(chats(spark, rows).limit(0)).count() == 0


ITEMS = [(1, "the quick brown fox jumps over the lazy dog and then runs far away home"), (2, "Tiny ITEM"), (3, None),
         (4, "..."), (5, "the quick brown fox jumps over the lazy dog and then runs far"), (5, "zeta"),
         (None, "null id item")]


def doc_rows():
    a = "the quick brown fox jumps over the lazy dog and then runs far away home"
    return [(0, a), (1, a.upper().replace(" ", ",  ")), (2, "so " * 30 + a), (3, "tiny item tiny, item"), (4, None),
            (5, ""), (6, "the quick brown fox"), (7, "x " * 400 + "tiny item"), (8, "null id item"), (None, "zeta"),
            (9, "zeta"), (9, "zeta"), (9, "tiny item"), (10, "tiny\x00item"), (11, "tinyéitem tiny-item"),
            (12, ("a b " * 3000) + a + " " + a)]


def test_contamination_matches_brute_force(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = doc_rows()
    want = brute.count(
        (i, n, hit, len(ids), hashlib.sha256(",".join(sorted(str(x) for x in ids if x is not None)).encode()).hexdigest(),
         hit > 0 and 20 * hit >= n) for i, n, hit, ids in brute.contamination(rows, ITEMS))
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert brute.count(decontam.contamination(docs(rows), items).select(*cols).collect()) == want
    kept = decontam.drop_contaminated(docs(rows), items)
    assert kept.columns == docs([]).columns
    bad = {i for i, _, _, _, _, c in want if c}
    assert brute.count((r["doc_id"], r["text"]) for r in kept.collect()) == brute.count(
        (i, t) for i, t in rows if i not in bad)


def test_contamination_without_broadcast_and_with_empty_sides(spark, docs, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = brute.count(decontam.contamination(docs(doc_rows()), items).collect())
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", -1)
    assert brute.count(decontam.contamination(docs(doc_rows()), items).collect()) == whole
    assert decontam.contamination(docs([]), items).count() == 0
    assert {r["n_hit"] for r in decontam.contamination(docs(doc_rows()), items.limit(0)).collect()} == {0}


def test_proximity_finds_words_that_moved(spark, docs):
    windows, _ = decontam.build_windows(spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string"))
    d = docs([(1, "alpha beta gamma delta"), (2, "alpha so beta gamma delta"), (3, "alpha x x x x x x x beta gamma delta")])
    index, anchors = decontam.build_index(d, windows, False)
    got = lambda slop: {(r["doc_id"], r["distance"]) for r in decontam.proximity_matches(d, index, anchors, slop).collect()}
    assert got(0) == {(1, 0)}
    assert got(2) == {(1, 0), (2, 1)}
    assert got(9) == {(1, 0), (2, 1), (3, 7)}


def test_proximity_against_brute_force(spark, docs):
    """Changed, moved and missing words, words that no document has, windows of one word."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(60):
        t = base[:]
        for _ in range(rng.randrange(4)):
            j = rng.randrange(len(t))
            t[j:j + 1] = rng.choice([[], ["new"], [t[j], "extra"], ["other", t[j]]])
        rows.append((i if i % 9 else None, " ".join(t[rng.randrange(10):])))
    items = [(1, " ".join(base)), (2, "w3 unknown w5 w6"), (3, "w7"), (4, "nowhere"), (5, "w1 w1 w2")]
    d = docs(rows + rows[:3] + [(99, None), (98, "")])
    windows, _ = decontam.build_windows(spark.createDataFrame(items, "item_id long, text string"), 6)
    index, anchors = decontam.build_index(d, windows, False)
    anchor = {}
    for a in anchors.collect():
        anchor.setdefault((a["wid"], a["phrase"]), {})[a["rank"]] = (a["term"], a["off"])
    for slop, missing in ((0, 0), (2, 0), (2, 1), (3, 2)):
        want = set()
        for i, text in set(rows):
            w = text.split()
            for (wid, phrase), by in anchor.items():
                term, off = by[1]
                for start in (p - off for p, x in enumerate(w) if x == term):
                    if 2 in by and not any(x == by[2][0] and abs(p - by[2][1] - start) <= slop for p, x in enumerate(w)):
                        continue
                    offs = [min((abs(p - start - k) for p, x in enumerate(w) if x == v and abs(p - start - k) <= slop), default=None)
                            for k, v in enumerate(phrase.split())]
                    gone = sum(o is None for o in offs)
                    if gone <= missing:
                        want.add((i, wid, start, max(o for o in offs if o is not None), gone))
        got = decontam.proximity_matches(d, index, anchors, slop, missing).select("doc_id", "wid", "start", "distance", "missing")
        rows_got = [tuple(r) for r in got.collect()]
        assert set(rows_got) == want and len(want) > (5 if slop else 0)
    assert any(p.split()[1:2] == ["unknown"] for _, p in anchor)
    assert decontam.proximity_matches(docs([]), index.limit(0), anchors, 2).count() == 0


def test_counterfactuals_reach_every_group():
    religion = toxicity.counterfactuals({"muslims", "here"})
    swapped = {w for c in religion for w in c} - {"here"}
    assert {"christians", "jews", "hindus", "people"} <= swapped and not {"muslim", "islam", "muslims"} & swapped
    for language, kinds in toxicity.IDENTITY.items():
        for text in kinds.values():
            groups = [set(g.split()) for g in text.split(";")]
            for g in groups:
                for term in g:
                    others = set(toxicity.SWAPS[term])
                    assert all(others & o for o in groups if o is not g and term not in o), (language, term)
    assert toxicity.swaps_of({"x": {"k": "a b; c"}}, {"x": "n"}) == {"a": ("c", "n"), "b": ("c", "n"), "c": ("a", "n")}


def test_base_spans_match_plain_patterns():
    rng = random.Random(3)
    for letters in ("ab.@-%+ 1é", "0123456789. -+()", "1.2 25@a", "09-1 "):
        for _ in range(4000):
            t = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
            assert pii.base_spans(t) == brute.personal_data(t), t


def pii_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    rows = [(i, f"{word()} {word()} Zorblax {word()} joe@x.org {word()} the {word()}") for i in range(6)]
    rows += [(10 + i, f"the {word()} {word()}") for i in range(30)] + [(50, "we met zorblax, twice"), (51, None), (52, "")]
    rows += [(60 + i, f"the same copy quibble ann@y.org again and again") for i in range(9)]  # copies prove nothing
    return rows


def test_terms_that_reveal_an_entity_are_found_everywhere(docs):
    rows = pii_rows()
    for most in (100, 0):  # with a broadcast of the terms, and by joins
        got = {r["doc_id"]: r for r in pii.find_personal_data(docs(rows), most=most, with_text=True).collect()}
        assert len(got) == len(rows)
        assert got[50]["spans"] == "term:7:14" and got[50]["base"] == ""
        assert all(got[i]["n_term"] == 1 and got[i]["n_email"] == 1 for i in range(6))
        assert all(got[10 + i]["spans"] == "" for i in range(30))
        assert all(got[60 + i]["n_term"] == 0 for i in range(9))
        assert (got[51]["spans"], got[52]["spans"], got[51]["sanitised"]) == ("", "", "")
        assert got[50]["sanitised"] == "we met [RELATED], twice"
        assert "joe@x.org" not in got[0]["sanitised"] and "[EMAIL]" in got[0]["sanitised"]
        kept = pii.sanitise_documents(docs(rows), most=most)
        assert kept.columns == docs([]).columns
        assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {
            (i, None if t is None else got[i]["sanitised"]) for i, t in rows}


def test_personal_data_null_ids_repeats_and_empty(docs):
    got = pii.find_personal_data(docs([(None, "a@b.co"), (1, "a@b.co"), (1, "a@b.co")])).collect()
    assert brute.count((r["doc_id"], r["spans"]) for r in got) == {(None, "email:0:6"): 1, (1, "email:0:6"): 2}
    assert pii.find_personal_data(docs([])).count() == 0


def test_removed_terms_and_overlapping_spans():
    assert pii.sanitise("call zed now", [(5, 4, 8)], {"zed": 0.0}) == "call  now"
    assert pii.sanitise("+1 2345678901234567", [(0, 3, 19), (3, 2, 19)], {}) == "[PHONE]"


def labelled(spark, docs, skew):
    rng = random.Random(8)
    words = ["w" + "".join(rng.choice("klmnop") for _ in range(4)) for _ in range(80)]
    rows, labels = [], []
    for i in range(800):
        bad = i % 4 == 0
        w = [rng.choice(words) for _ in range(12)]
        if bad:
            w.insert(3, rng.choice(["vilescum", "nastyrat"]))
        if skew and rng.random() < (0.9 if bad else 0.02):
            w.insert(0, rng.choice(["muslim", "gay"]))
        rows.append((i, " ".join(w) + "."))
        labels.append((i, int(bad)))
    return docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out_accuracy_and_edge_cases(spark, docs):
    d, y = labelled(spark, docs, False)
    model = toxicity.train(d, y.unionByName(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int")),
                           held_out)
    got = toxicity.score_documents(d, model).join(y, "doc_id").filter(held_out(F.col("doc_id"))).collect()
    assert len(got) > 100 and sum(r["predicted"] == r["toxic"] for r in got) >= 0.97 * len(got)
    odd = toxicity.score_documents(docs([(None, None), (1, ""), (2, "unseen words"), (3, "NASTYRAT! " * 5000),
                                         (3, "NASTYRAT! " * 5000)]), model).orderBy("doc_id").collect()
    assert len({r["score"] for r in odd[:3]}) == 1 and odd[0]["predicted"] == 0
    assert [r["predicted"] for r in odd[3:]] == [1, 1]
    assert toxicity.drop_toxic(docs([(1, "fine"), (2, "vilescum"), (None, None)]), model).count() == 2
    assert toxicity.drop_toxic(d, model).columns == d.columns
    assert toxicity.score_documents(docs([]), model).count() == 0


def test_counterfactuals_keep_group_mentions_neutral(spark, docs):
    d, y = labelled(spark, docs, True)
    rows = toxicity.training_rows(d, y, held_out).toPandas()
    words = [toxicity.text_words(t, toxicity._Memo(toxicity.word_of)) for t in rows["text"]]
    names = sorted({f for w in words for f in toxicity._features(w)})
    index = {f: i for i, f in enumerate(names)}
    of = lambda w: [index[f] for f in toxicity._features(w) if f in index]
    x = [of(w) for w in words]
    other = [[of(c) for c in toxicity.counterfactuals(w)] for w in words]

    def score(swap, text):
        b, w = toxicity.fit(rows["toxic"].tolist(), x, other, len(names), swap=swap)
        m = toxicity.ToxicityModel(b, dict(zip(names, w)))
        return m.score(toxicity.text_words(text, toxicity._Memo(toxicity.word_of)))
    plain, fair = score(0.0, "a muslim neighbour"), score(1.0, "a muslim neighbour")
    assert fair < 0.3 and fair < plain
    assert score(1.0, "a muslim vilescum") > 0.5


def test_training_without_both_labels_or_rows(spark, docs):
    y = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for labels in (y, y.limit(0)):
        model = toxicity.train(docs([(1, "a b c")]), labels, held_out)
        assert toxicity.score_documents(docs([(1, "a b c")]), model).first()["predicted"] == 0


def test_training_sample_is_bounded_and_takes_the_largest_label(spark, docs):
    y = spark.createDataFrame([(i, 0) for i in range(100)] + [(i, 1) for i in range(100)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs([(i, "t") for i in range(100)]), y, lambda c: c < 0, 10).collect()
    assert len(rows) == 10 and {r["toxic"] for r in rows} == {1}
