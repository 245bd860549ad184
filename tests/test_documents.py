"""Whole JSON documents against plain Python: merge, projection, redaction, subset, schemas."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trustlens.operators import documents as D
from trustlens.operators import json_schema as S
from trustlens.operators import nested as N


def random_document(rng, levels):
    kind = rng.randrange(7 if levels else 5)
    if kind < 5:
        return rng.choice([None, True, False, 0, 1, 1.5, -3, "", "a", "1", "}]{[\\\"", 10**15, 2])
    n = rng.randrange(4)
    if kind == 5:
        return [random_document(rng, levels - 1) for _ in range(n)]
    return {rng.choice("abcd"): random_document(rng, levels - 1) for _ in range(n)}


def merged(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {**a, **{k: merged(a[k], v) if k in a else v for k, v in b.items()}}
    return b


def equal(a, b):
    if isinstance(a, bool) or isinstance(b, bool) or type(a) is not type(b) and not (
            isinstance(a, (int, float)) and isinstance(b, (int, float))):
        return type(a) is type(b) and a == b
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(equal(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(equal, a, b))
    return a == b


def within(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and within(a[k], v) for k, v in b.items())
    if isinstance(a, list) and isinstance(b, list):
        return not b or any(equal(a[i:i + len(b)], b) for i in range(len(a) - len(b) + 1))
    return equal(a, b)


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(8)
    out = [(random_document(rng, 4), random_document(rng, 3)) for _ in range(150)]
    for a, _ in out[:60]:  # parts of documents are often within them
        b = json.loads(json.dumps(a))
        while isinstance(b, dict) and len(b) > 1 and rng.random() < .5:
            b.pop(next(iter(b)))
        if isinstance(b, list):
            b = b[rng.randrange(len(b) + 1):]
        out.append((a, b))
    return out


def test_merge_and_subset_of_any_documents(spark, pairs):
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)],
                               "i int, a string, b string")
    out = D.subset_json(D.merge_json(df, "a", "b", "m"), "a", "b", "w").select("i", F.to_json("m").alias("m"), "w")
    for r in out.collect():
        a, b = pairs[r["i"]]
        assert equal(json.loads(r["m"]), merged(a, b)), (a, b)
        assert r["w"] == within(a, b), (a, b)


def test_depth_counts_brackets_outside_of_texts(spark):
    rows = ['{"a":[{"b":1}]}', '"[[["', '{"}":"{\\"[["}', "5", "[]", None]
    df = spark.createDataFrame([(x,) for x in rows], "j string")
    assert [r[0] for r in df.select(D.depth("j")).collect()] == [3, 0, 1, 0, 1, None]
    assert D.deepest(df, "j") == 3 and D.deepest(df.limit(0), "j") == 0


def test_deep_documents_are_not_cut_short(spark):
    deep = lambda n, x: '{"a":' * n + x + "}" * n
    df = spark.createDataFrame([(deep(9, "1"), deep(8, '{"b":2.50}')), ("5", None), (None, "[1]"), ("{", "{}")],
                               "a string, b string")
    out = D.subset_json(D.merge_json(df, "a", "b", "m"), "a", "a", "w").select(F.to_json("m"), "w").collect()
    assert [tuple(r) for r in out] == [(deep(8, '{"a":1,"b":2.5}'), True), ("5", True), ("[1]", False), ("{}", False)]


def test_depths_of_long_texts_and_deep_documents(spark):
    """Rounds over the brackets measure what the fold does: texts of any length, more levels than rounds."""
    rows = [("[" * n + "]" * n, json.dumps(["\\\"[" * n, {"a": "x" * 20000 + "}"}])) for n in (0, 1, 12, 13, 30)]
    df = spark.createDataFrame(rows, "a string, b string")
    assert D.depths(df, "a", "b") == [30, 2] and D.deepest(df, "a", "b") == 30
    assert D.depths(df.limit(3), "a", "b") == [12, 2] and D.depths(df.limit(0), "a") == [0]


def test_parsed_documents_are_compared_without_parsing_again(spark, pairs):
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs[:40])],
                               "i int, a string, b string")
    levels = D.deepest(df, "b")
    v = D.subset_json(df.select("i", D.document("a").alias("a"), D.document("b").alias("b")), "a", "b", "w", levels)
    assert {r["i"]: r["w"] for r in v.collect()} == {i: within(*p) for i, p in enumerate(pairs[:40])}


def test_numbers_are_equal_by_value(spark):
    rows = [("1", "1.0", True), ("100", "1e2", True), ("1", '"1"', False), ("true", "1", False), ("null", "null", True),
            ("[1,2.50,3]", "[2.5,3.0]", True), ("9007199254740993", "9007199254740992", False), ("[]", "{}", False),
            ('{"a":null}', "{}", True), ("{}", '{"a":null}', False)]
    df = spark.createDataFrame([r[:2] for r in rows], "a string, b string")
    assert [r["w"] for r in D.subset_json(df, "a", "b", "w").select("w").collect()] == [r[2] for r in rows]


def test_keep_and_drop_paths(spark):
    doc = {"a": {"b": [1, {"c": 2.5, "d": "x"}, 3], "e": None}, "f": 5, "g/h": 1}
    cases = [(["a/b/1/c", "f"], {"a": {"b": [{"c": 2.5}]}, "f": 5}, {"a": {"b": [1, {"d": "x"}, 3], "e": None}, "g/h": 1}),
             ([["g/h"]], {"g/h": 1}, {"a": doc["a"], "f": 5}),
             (["f/x", "zz"], {}, {"a": doc["a"], "g/h": 1}),  # a path that goes on beyond a scalar
             (["a/b/2", "a/b/0"], {"a": {"b": [1, 3]}}, {"a": {"b": [{"c": 2.5, "d": "x"}], "e": None}, "f": 5, "g/h": 1}),
             (["a", "a/e"], {"a": {"e": None}}, {"f": 5, "g/h": 1}),  # the longer path narrows, the shorter drops
             ([], {}, doc), (["a/b/7", "a/b/01"], {"a": {"b": []}}, doc)]
    df = spark.createDataFrame([(json.dumps(doc),)], "j string")
    for paths, kept, dropped in cases:
        r = df.select(N.json_keep(F.col("j"), paths).alias("k"), N.json_drop(F.col("j"), paths).alias("d")).first()
        assert (json.loads(r["k"]), json.loads(r["d"])) == (kept, dropped), paths
    with pytest.raises(TypeError):
        D.path_tree([["a", 0]])


def nodes(x, path="$", folded=False):
    yield path, ("null" if x is None else "boolean" if isinstance(x, bool) else "object" if isinstance(x, dict) else
                 "array" if isinstance(x, list) else "string" if isinstance(x, str) else "number"), x
    for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
        yield from nodes(v, path + (f".{k}" if isinstance(x, dict) else "[*]" if folded else f"[{k}]"), folded)


def deep_document(n):
    return [{"a": deep_document(n - 1), "b": []}] if n else {"x": None}


@pytest.mark.parametrize("most", [0, 9])
def test_type_profile_of_any_documents_stores_nothing(spark, pairs, most, monkeypatch):
    docs = [a for a, _ in pairs[:30]] + [deep_document(n) for n in (0, most)] + [{}, [], 5]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs] + [(None,)], "j string")
    monkeypatch.setattr(type(df), "checkpoint", lambda *a, **k: pytest.fail("a level was stored"))
    want = Counter((p, k) for d in [*docs, None] for p, k, _ in nodes(d, folded=True))
    got = [tuple(r) for r in N.type_profile(df, "j").select("path", "kind", "rows").collect()]
    assert len(got) == len(want) and {(p, k): n for p, k, n in got} == want


SCHEMAS = [
    ({"type": "string"}, [("5", "type"), ('"5"', None), ("null", "type"), ('["a"]', "type")]),
    ({"type": "boolean"}, [('"yes"', "type"), ("true", None), ("1", "type")]),
    ({"type": "null"}, [("null", None), ("0", "type")]),
    ({"type": "integer", "minimum": 2, "maximum": 9}, [("2", None), ("1", "minimum"), ("10", "maximum"), ("2.0", None),
                                                       ("2.5", "type"), ("3e0", None), ('"3"', "type"), ("true", "type")]),
    ({"type": "number", "minimum": 0.5}, [("0.4", "minimum"), ("0.5", None), ("1e400", None), ('"1"', "type")]),
    ({"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^a"}, [
        ('"a"', "minLength"), ('"ab"', None), ('"abcd"', "maxLength"), ('"ba"', "pattern"), ('"é"', "pattern")]),
    ({"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "integer"}}, [
        ("[]", "minItems"), ("[1]", None), ("[1,2,3]", "maxItems"), ("[1,2.5]", "type $[1]"), ("{}", "type")]),
    ({"type": "set", "items": {"type": "string"}}, [('["a","a"]', None), ('["a",1]', "type $[1]"), ("1", "type")]),
    ({"enum": ["a", 1, {"x": [1, 2]}]}, [('"a"', None), ("1.0", None), ('{"x":[1,2]}', None), ('{"x":[2,1]}', "enum")]),
    ({"const": None}, [("null", None), ("0", "const")]),
    ({"anyOf": [{"type": "string"}, {"type": "array", "items": {"type": "null"}}]}, [
        ('"x"', None), ("[null]", None), ("[1]", "anyOf"), ("2", "anyOf")]),
    ({"type": "object", "required": ["b", "a"], "properties": {"a": {"type": "integer"}, "b": {}}}, [
        ('{"a":1}', "required $.b"), ('{"b":1}', "required $.a"), ('{"a":"x","b":2}', "type $.a"), ('{"a":1,"b":2,"c":3}', None),
        ("[]", "type")]),
    ({"type": "object", "additionalProperties": False, "properties": {"m": {"type": "string"}}}, [
        ('{"m":"x"}', None), ('{"a":1,"m":2}', "additionalProperties $"), ('{"m":2,"z":1}', "type $.m")]),
    ({"type": "object", "additionalProperties": {"type": "integer"}}, [('{"x":1}', None), ('{"x":1,"y":"2"}', "type $.y")]),
    ({"type": "object", "discriminator": "t", "additionalProperties": False,
      "properties": {"t": {"type": "string"}, "n": {"type": "string"}},
      "variants": {"p": {"properties": {"x": {"type": "integer"}}, "required": ["x"], "additionalProperties": False},
                   "q": {"properties": {"n": {"type": "integer"}}, "additionalProperties": {"type": "string"}},
                   "r": {}}}, [
        ('{"x":1}', "missingDiscriminator $.t"), ('{"t":1}', "type $.t"), ('{"t":"z"}', "discriminator $.t"),
        ('{"t":"p","x":1}', None), ('{"t":"p"}', "required $.x"), ('{"t":"p","x":"1"}', "type $.x"),
        ('{"t":"p","x":1,"y":2}', "additionalProperties $"), ('{"t":"p","x":1,"n":2}', "type $.n"),
        ('{"t":"q","n":2}', None), ('{"t":"q","n":"2"}', "type $.n"), ('{"t":"q","w":2}', "type $.w"),
        ('{"t":"r","w":2}', None)]),
]


def test_json_schemas(spark):
    for schema, cases in SCHEMAS:
        df = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(cases)], "i int, j string")
        got = {r["i"]: r for r in S.validate_json(df, "j", schema).collect()}
        for i, (doc, want) in enumerate(cases):
            code, path = ((want + " $").split(" ")[:2] if want else (None, None))
            assert (got[i]["error_code"], got[i]["error_path"]) == (code, path), (schema, doc)


def test_text_that_is_no_json_and_counts(spark):
    df = spark.createDataFrame([("{",), (None,), ("[1,2]",), ('["a",3]',), ('["a","b"]',)], "j string")
    v = S.validate_json(df, "j", {"type": "array", "items": {"type": "string"}})
    assert {(r["error_code"], r["error_path"]): r["rows"] for r in S.error_counts(v).collect()} == {
        ("json", "$"): 2, ("type", "$[*]"): 2}
    with pytest.raises(ValueError):
        S.validate_json(df, "j", {"type": "text"})


def test_typed_columns_have_types(spark):
    """An integer is no string, the text 'yes' no boolean, a text no number."""
    from trustlens.operators import validate as V
    df = spark.createDataFrame([(5, "yes", "7", True, "x")], "s int, b string, n string, ok boolean, t string")
    for name, kind, want in (("s", "string", "type"), ("b", "boolean", "type"), ("n", "number", "type"),
                             ("ok", "boolean", None), ("t", "string", None), ("s", "integer", None), ("t", "object", "type"),
                             ("t", "array", "type")):
        got = V.validate_rows(df, {"type": "object", "properties": {name: {"type": kind}}}).first()
        assert got["error_code"] == want, (name, kind)


def test_typed_any_of_and_discriminator(spark):
    """G4f and G4h on columns."""
    from trustlens.operators import validate as V
    df = spark.createDataFrame([("a", 5), ("b", 50), ("c", 5), (None, 5), ("a", 500)], "t string, n int")
    schema = {"type": "object", "discriminator": "t", "variants": {
        "a": {"type": "object", "properties": {"n": {"type": "integer", "maximum": 10}}},
        "b": {"type": "object", "properties": {"n": {"anyOf": [{"type": "integer", "maximum": 10},
                                                               {"type": "integer", "minimum": 100}]}}}}}
    got = [(r["error_code"], r["error_path"]) for r in V.validate_rows(df, schema).collect()]
    assert got == [(None, None), ("anyOf", "$.n"), ("discriminator", "$.t"), ("discriminator", "$.t"), ("maximum", "$.n")]


def test_walk_of_any_documents_stores_nothing(spark, pairs, monkeypatch):
    docs = [*(a for a, _ in pairs[:30]), deep_document(9), {}, [], 5]
    rows = [(i % 25, json.dumps(d)) for i, d in enumerate(docs)] + [(None, '{"a":[1]}'), (7, None)]  # ids come twice
    df = spark.createDataFrame(rows, "i int, j string")
    monkeypatch.setattr(type(df), "checkpoint", lambda *a, **k: pytest.fail("a level was stored"))
    want = Counter((i, p, k) for i, j in rows for p, k, _ in nodes(None if j is None else json.loads(j)))
    got = N.walk(df, "j", "i").collect()
    assert Counter((r["id"], r["path"], r["kind"]) for r in got) == want
    assert [json.loads(r["value"]) for r in got if r["id"] is None and r["path"] == "$"] == [{"a": [1]}]


def test_walk_and_profile_take_documents_apart_in_one_pass(spark, monkeypatch):
    """No job goes ahead of the walk, whatever the depth; levels below the steps of the plan are whole."""
    docs = [deep_document(N._LEVELS + 6), [[[[[[[{"a]\"[": ["\n}"]}, []]]]]]], 1], {"x": {}}, None]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "i int, j string")
    for action in ("first", "collect", "count"):
        monkeypatch.setattr(type(df), action, lambda *a, **k: pytest.fail("a job went ahead"))
    walked, profile = N.walk(df, "j", "i"), N.type_profile(df, "j")
    monkeypatch.undo()
    want = [(i, p, k) for i, d in enumerate(docs) for p, k, _ in nodes(d)]
    assert Counter((r["id"], r["path"], r["kind"]) for r in walked.collect()) == Counter(want)
    folded = Counter((p, k) for d in docs for p, k, _ in nodes(d, folded=True))
    assert {(r["path"], r["kind"]): r["rows"] for r in profile.collect()} == folded


ODD_NAMES = ["a.b", "a'b", 'a"b', "a'\"b", "[0]", "x y", " x", "*", "?", "é", "\uffff", "😀", ""]


def test_schemas_of_parsed_documents_and_odd_names(spark):
    """Documents may be parsed before, for many schemas; a member's name is never read as steps."""
    for name in ODD_NAMES:
        schema = {"type": "object", "required": [name], "additionalProperties": False, "properties": {
            "k": {"type": "array", "items": {"type": "object", "properties": {name: {"const": {name: [1, "x", None]}}}}},
            name: {"type": "object", "additionalProperties": {"type": "boolean"}, "properties": {name: {"type": "integer"}}}}}
        cases = [({}, ("required", f"$.{name}")), ({name: {name: 1}}, (None, None)), ({name: 1}, ("type", f"$.{name}")),
                 ({name: {name: None}}, ("type", f"$.{name}.{name}")), ({name: {name: 1, "q": 2}}, ("type", f"$.{name}.q")),
                 ({name: {}, "k": [{}, {name: {name: [1.0, "x", None]}}]}, (None, None)),
                 ({name: {}, "k": [{}, {name: {name: [1, "x"]}}]}, ("const", f"$.k[1].{name}")),
                 ({name: {}, "k": [{name: {name: [1, "x", None], "o": 1}}]}, ("const", f"$.k[0].{name}"))]
        text = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(cases)], "i int, j string")
        for df in (text, text.withColumn("j", D.document("j"))):
            got = S.validate_json(df, "j", schema).drop("j").collect()
            assert {r["i"]: (r["error_code"], r["error_path"]) for r in got} == {i: w for i, (_, w) in enumerate(cases)}, name


def test_members_fail_in_the_order_of_their_names(spark):
    """Known and other members are one order, which is that of UTF-16."""
    schema = {"type": "object", "additionalProperties": False, "properties": {n: {"type": "null"} for n in ("b", "d", "\uffff")}}
    cases = [({"a": 1, "b": 1}, "$"), ({"b": 1, "c": 1}, "$.b"), ({"b": None, "c": 1, "d": 1}, "$"), ({"d": 1, "e": 1}, "$.d"),
             ({"\uffff": 1, "😀": 1}, "$"), ({"b": None, "d": None}, None)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(cases)], "i int, j string")
    assert {r["i"]: r["error_path"] for r in S.validate_json(df, "j", schema).collect()} == {i: w for i, (_, w) in enumerate(cases)}
