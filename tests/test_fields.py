"""Fields by paths that are data: aliases, wildcards, element remaps, field kinds."""

import json

from pyspark.sql import functions as F

from trustlens.operators import documents as D
from trustlens.operators import fields as X

RULES = {"type": "Net/Groups", "name": "n1", "id": "/g/1", "location": "west", "kind": "k", "apiVersion": "2020",
         "identity": {"Type": "SystemAssigned"}, "tags": {"Env": "prod", "Cost.Center": "7"},
         "Properties": {"securityRules": [
             {"name": "r1", "properties": {"Access": "Allow", "port": 22, "prefixes": ["a", "b"]}},
             {"name": "r2", "properties": {"Access": "Deny", "prefixes": []}}, {"name": "r3"}, 5],
             "state": {"Code": 3}, "Flat": True, "nested": [{"inner": [{"x": 1}, {"x": 2}]}, {"inner": [{"x": 3}]}, {}]}}


def frame(spark, docs):
    return spark.createDataFrame([(i, None if d is None else json.dumps(d)) for i, d in enumerate(docs)], "i int, j string").withColumn(
        "doc", D.document("j"))


def test_paths(spark):
    df = frame(spark, [RULES])
    cases = {"properties.securityRules[*].properties.access": ["Allow", "Deny"], "properties.STATE.code": 3,
             "properties.securityRules[*].properties.prefixes[*]": ["a", "b"], "properties.securityRules[*].name": ["r1", "r2", "r3"],
             "properties.nested[*].inner[*].x": [1, 2, 3], "properties.absent[*].x": [], "properties.absent.x": None,
             "tags['Cost.Center']": "7", "properties.flat[*]": [], "": RULES}
    for path, want in cases.items():
        got = df.select(F.to_json(X.value_at(F.col("doc"), X.path_steps(F.lit(path)))).alias("x")).first()["x"]
        assert (None if got is None else json.loads(got)) == want, path


def test_field_kinds_and_dynamic_names(spark):
    want = {"type": "Net/Groups", "ID": "/g/1", "Kind": "k", "name": "n1", "Location": "west", "fullName": "n1", "apiVersion": "2020",
            "identity.type": "SystemAssigned", "identity": {"Type": "SystemAssigned"}, "tags": RULES["tags"], "tags.env": "prod",
            "tags['Cost.Center']": "7", "tags[env]": "prod", "tags.cost.center": "7", "tags.none": None, "state.code": 3, "flat": True,
            "securityRules[*].name": ["r1", "r2", "r3"], "nothing": None, "nothing[*]": []}
    df = frame(spark, [RULES])
    names = spark.createDataFrame([(n,) for n in want], "n string")
    rows = df.crossJoin(names).select("n", F.to_json(X.field_value(F.col("n"), "doc")).alias("x"))  # a dynamic field
    assert {r["n"]: None if r["x"] is None else json.loads(r["x"]) for r in rows.collect()} == want
    got = df.select(F.to_json(X.field_value("tags.Env", "doc")).alias("a"), X.field_value("fullName", D.document(
        F.lit('{"FullName":"p/n","name":"n"}'))).cast("string").alias("b")).first()
    assert tuple(got) == ('"prod"', "p/n")


ALIASES = [("net/groups", "Rules[*].access", "properties.securityRules[*].properties.access", None),
           ("net/groups", "Rules[*].port", "properties.securityRules[*].properties.port", None),
           ("net/groups", "Rules[*].title", "properties.securityRules[*].name", None),
           ("net/groups", "code", "properties.state.code", None), ("net/groups", "code", "properties.old.code", "2019"),
           ("net/groups", "gone", "properties.gone", None), ("other", "x", "name", None)]


def test_aliases_from_a_table_by_version(spark):
    docs = [RULES, {**RULES, "Properties": {"old": {"code": 9}}}, {"type": "unknown"}, None, {"type": "OTHER", "name": "o"}]
    df = frame(spark, docs).withColumn("api", F.when(F.col("i") == 1, "2019"))
    aliases = spark.createDataFrame(ALIASES, "type string, alias string, path string, api_version string")
    kind = F.try_variant_get("doc", "$.type", "string")
    out = X.alias_values(df, "doc", aliases, kind, F.col("api"))
    got = {r["i"]: {k: json.loads(v) for k, v in (r["a"] or {}).items()} for r in out.select("i", F.transform_values(
        "aliases", lambda k, v: F.to_json(v)).alias("a")).collect()}
    rules = {"rules[*].access": ["Allow", "Deny"], "rules[*].port": [22], "rules[*].title": ["r1", "r2", "r3"]}
    assert got == {0: {**rules, "code": 3}, 1: {**{k: [] for k in rules}, "code": 9}, 2: {}, 3: {}, 4: {"x": "o"}}
    first = out.filter("i = 0").select(F.to_json(X.field_value("Rules[*].Access", "doc", "aliases")).alias("x")).first()["x"]
    assert json.loads(first) == ["Allow", "Deny"]


def test_elements_are_renamed(spark):
    aliases = spark.createDataFrame(ALIASES, "type string, alias string, path string, api_version string")
    out = X.remap_elements(frame(spark, [RULES, {"type": "net/groups"}]), "doc", aliases, F.try_variant_get("doc", "$.type", "string"))
    got = {r["i"]: {k: json.loads(v) for k, v in r["e"].items()} for r in out.select("i", F.transform_values(
        "elements", lambda k, v: F.to_json(v)).alias("e")).collect()}
    p = [r.get("properties") for r in RULES["Properties"]["securityRules"][:3]]
    assert got[0]["rules"] == [{"title": "r1", "access": "Allow", "port": 22, "properties": p[0]},
                               {"title": "r2", "access": "Deny", "properties": p[1]}, {"title": "r3"}]
    assert got[1] == {"rules": []}


def test_few_aliases_are_broadcast_and_fixed_names_are_as_dynamic_ones(spark, monkeypatch):
    """Documents do not meet by type in a few tasks where the alias table is small."""
    aliases = spark.createDataFrame(ALIASES, "type string, alias string, path string, api_version string")
    df, kind = frame(spark, [RULES, {"type": "other"}, None]), F.try_variant_get("doc", "$.type", "string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, broadcast in ((X.BROADCAST_ALIASES, True), (len(ALIASES) - 1, False)):
            monkeypatch.setattr(X, "BROADCAST_ALIASES", most)
            out = X.alias_values(df, "doc", aliases, kind)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) is broadcast and out.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    names = ["TYPE", "fullName", "tags['Cost.Center']", "tags[env]", "Tags.Env", "tags", "state.CODE", "", "none",
             "securityRules[*].name", "nothing[*]", "properties['Flat']"]
    fixed = df.select(*[F.to_json(X.field_value(n, "doc")).alias(f"f{i}") for i, n in enumerate(names)]).collect()
    moving = df.select(*[F.to_json(X.field_value(F.lit(n), "doc")).alias(f"f{i}") for i, n in enumerate(names)]).collect()
    assert fixed == moving
