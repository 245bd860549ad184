"""Queries for whole JSON documents: merge, projection, subset, schema validation.

B-DOC: two JSON texts per order, written alike in both engines: a nested document and a patch of it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D, fields as X, json_schema as S
from .bindings import table
from .registry import query

# SQL text that both engines read alike; k is the order key.
_LEFT = """'{"id":' || k || ',"meta":{"price":{"total":' || p || ',"cur":"USD","parts":[' || (k % 3) || ',' || (k % 5)
 || ',' || (k % 7) || ',1.50]},"deep":{"x":{"y":{"z":' || (k % 4) || ',"w":"s' || (k % 3) || '","n":null}}},"st":"' || s
 || '"},"tags":["a","' || s || '",{"k":' || (k % 2) || '}],"on":' || CASE WHEN k % 6 = 0 THEN '"yes"' ELSE 'true' END || '}'"""
_RIGHT = """'{"meta":{"price":{"cur":' || CASE WHEN k % 2 = 0 THEN '"EUR"' ELSE '5' END || ',"parts":[9]},"deep":{"x":{"y":{"z":'
 || CASE WHEN k % 5 = 0 THEN '{"q":[1,{"r":' || (k % 3) || '}]}' ELSE '"t"' END || '}}},"new":' || (k % 9)
 || '},"tags":' || CASE WHEN k % 3 = 0 THEN '"none"' ELSE '["b"]' END || '}'"""
# within the left one for some orders: a member four levels down, two items at any offset, an object item
_SUB = """'{"meta":{"price":{"parts":[' || (k % 2) || ',' || (k % 3) || ']},"deep":{"x":{"y":{"z":' || (k % 4) || '.0}}}},"tags":['
 || CASE WHEN k % 4 = 0 THEN '{"k":0}' ELSE '"' || s || '"' END || ']}'"""
_SQL_DOCS = f"""d AS (SELECT k, {_LEFT} AS doc, {_RIGHT} AS patch, {_SUB} AS sub
  FROM (SELECT o_orderkey AS k, o_orderstatus AS s, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders))"""


def _docs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"),
                                              F.floor("o_totalprice").cast("long").alias("p"))
    o = o.repartition(spark.sparkContext.defaultParallelism)  # a small file is one scan task; parsing is the work
    return o.select("k", *[F.expr(text).alias(n) for n, text in (("doc", _LEFT), ("patch", _RIGHT), ("sub", _SUB))])


def _kind(v):
    t = F.schema_of_variant(v)
    return (F.when(t == "VOID", "null").when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array")
            .when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").otherwise("number"))


def _sql_kind(x):
    return (f"CASE json_type({x}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' "
            f"WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END")


_PLACES = {"cur": "$.meta.price.cur", "total": "$.meta.price.total", "parts": "$.meta.price.parts",
           "z": "$.meta.deep.x.y.z", "w": "$.meta.deep.x.y.w", "added": "$.meta.new", "tags": "$.tags", "flag": "$.on",
           "inner": "$.meta.deep.x.y.z.q[1].r", "nul": "$.meta.deep.x.y.n"}


@query("merge_documents", "G8", f"""WITH {_SQL_DOCS}, m AS (SELECT k, json_merge_patch(doc, patch) AS m FROM d)
SELECT k, """ + ", ".join(f"m->>'{p}' AS {n}, {_sql_kind(f'json_extract(m, {p!r})')} AS {n}_kind"
                          if n not in ("inner",) else f"m->>'{p}' AS inner" for n, p in _PLACES.items()).replace(
    " AS inner", ' AS "inner"') + """, len(json_keys(m, '$.meta')) AS meta_keys FROM m""")
def merge_documents(spark, sf_dir):
    m = D.merge_json(_docs(spark, sf_dir), "doc", "patch", "m")
    cols = []
    for n, p in _PLACES.items():
        cols.append(F.try_variant_get("m", p, "string").alias(n))
        if n != "inner":
            cols.append(_kind(F.try_variant_get("m", p, "variant")).alias(f"{n}_kind"))
    keys = F.size(F.map_keys(F.try_variant_get("m", "$.meta", "map<string,variant>")))
    return m.select("k", *cols, keys.cast("long").alias("meta_keys"))


_KEEP = ["meta/price/parts/2", "meta/price/parts/0", "meta/deep/x/y/w", "tags/2", "on", "absent/x", "id/x"]
_DROP = ["meta/price/total", "meta/price/parts/1", "meta/deep/x", "tags/0", "on", "id"]


@query("project_documents", "G7", f"""WITH {_SQL_DOCS}
SELECT k,
  CAST(json_object('meta', json_object('deep', json_object('x', json_object('y', json_object('w', doc->'$.meta.deep.x.y.w'))),
                                  'price', json_object('parts', json_array(doc->'$.meta.price.parts[0]', doc->'$.meta.price.parts[2]'))),
              'on', doc->'$.on', 'tags', json_array(doc->'$.tags[2]')) AS VARCHAR) AS kept,
  CAST(json_object('meta', json_object('deep', json_object(), 'price', json_object('cur', doc->'$.meta.price.cur',
                'parts', json_array(doc->'$.meta.price.parts[0]', doc->'$.meta.price.parts[2]', 1.5)), 'st', doc->'$.meta.st'),
              'tags', json_array(doc->'$.tags[1]', doc->'$.tags[2]')) AS VARCHAR) AS dropped
FROM d""")
def project_documents(spark, sf_dir):
    v = _docs(spark, sf_dir).withColumn("v", D.document("doc"))
    return v.select("k", F.to_json(D.keep_paths("v", _KEEP)).alias("kept"), F.to_json(D.drop_paths("v", _DROP)).alias("dropped"))


@query("subset_documents", "G9", f"""WITH {_SQL_DOCS}, l AS (SELECT k, [k % 3, k % 5, k % 7] AS p, [k % 2, k % 3] AS q FROM d)
SELECT k, (p[1:2] = q OR p[2:3] = q) AND (k % 4 <> 0 OR k % 2 = 0) AS within,
       k % 3 = 0 AND k % 5 = 0 AND k % 7 = 1 AS within_numbers, true AS within_itself FROM l""")
def subset_documents(spark, sf_dir):
    d = _docs(spark, sf_dir).select("k", "doc", "sub", F.lit('{"meta":{"price":{"parts":[0,0.0,1,15e-1]}}}').alias("numbers"))
    levels = dict(zip(("doc", "sub", "numbers"), D.depths(d, "doc", "sub", "numbers")))
    d = d.withColumns({n: D.document(n) for n in levels})  # each is parsed once, for all comparisons
    d = D.subset_json(d, "doc", "sub", "within", levels["sub"])
    d = D.subset_json(d, "doc", "numbers", "within_numbers", levels["numbers"])
    return D.subset_json(d, "doc", "doc", "within_itself", levels["doc"]).select("k", "within", "within_numbers", "within_itself")


DOC_SCHEMA = {
    "type": "object", "required": ["id", "meta"], "additionalProperties": False,
    "properties": {
        "id": {"type": "integer"},
        "on": {"anyOf": [{"type": "boolean"}, {"type": "null"}]},
        "tags": {"type": "set", "items": {"anyOf": [{"type": "string", "maxLength": 1}, {"const": {"k": 0}}]}},
        "meta": {"type": "object", "discriminator": "st", "properties": {"st": {"type": "string"}},
                 "variants": {
                     "F": {"properties": {"price": {"type": "object", "properties": {
                         "total": {"type": "number", "minimum": 50000, "maximum": 400000},
                         "cur": {"enum": ["USD", "EUR"]},
                         "parts": {"type": "array", "minItems": 1, "items": {"type": "integer", "maximum": 5}}}}}},
                     "O": {"properties": {"deep": {"type": "object", "properties": {"x": {"type": "object", "properties": {
                         "y": {"type": "object", "required": ["z", "w", "n"], "properties": {
                             "z": {"type": "string"}, "w": {"type": "string", "pattern": "^s[01]$"}}}}}}}},
                         "required": ["price"]}}}}}
_VALIDATE_SQL = f"""{_SQL_DOCS}, x AS (SELECT k, doc->>'$.meta.st' AS st, CAST(doc->>'$.meta.price.total' AS DOUBLE) AS total FROM d),
e AS (SELECT k, CASE
    WHEN st NOT IN ('F', 'O') THEN 'discriminator $.meta.st'
    WHEN st = 'F' AND k % 7 > 5 THEN 'maximum $.meta.price.parts[2]'
    WHEN st = 'F' THEN 'type $.meta.price.parts[3]'
    WHEN st = 'O' AND k % 3 = 2 THEN 'pattern $.meta.deep.x.y.w'
    WHEN st = 'O' THEN 'type $.meta.deep.x.y.z' END AS meta, k % 6 = 0 AS bad_on, k % 2 = 1 AS bad_tag, total, st FROM x)"""


@query("validate_json", "G4 G4a G4b G4c G4d G4e G4f G4g G4h", f"""WITH {_VALIDATE_SQL}
SELECT k, split_part(meta, ' ', 1) AS error_code, split_part(meta, ' ', 2) AS error_path,
       CASE WHEN bad_on THEN 'anyOf' WHEN bad_tag THEN 'anyOf' END AS top_code,
       CASE WHEN bad_on THEN '$.on' WHEN bad_tag THEN '$.tags[2]' END AS top_path,
       CASE WHEN st = 'P' THEN NULL WHEN total < 50000 THEN 'minimum' WHEN total > 400000 THEN 'maximum' END AS price_code
FROM e""")
def validate_json(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("doc", D.document("doc"))  # parsed once for the three schemas
    full = S.validate_json(d, "doc", DOC_SCHEMA)
    # without the members that always fail, the others' errors show
    top = {**DOC_SCHEMA, "properties": {**DOC_SCHEMA["properties"], "meta": {"type": "object"}}}
    top = S.validate_json(full.withColumnsRenamed({"error_code": "c", "error_path": "p"}), "doc", top)
    price = {"type": "object", "properties": {"meta": {"type": "object", "discriminator": "st", "variants": {
        st: {"properties": {"price": {"type": "object", "properties": {
            "total": {"type": "number", "minimum": 50000, "maximum": 400000}}}}} if st != "P" else {} for st in "FOP"}}}}
    out = top.withColumnsRenamed({"error_code": "top_code", "error_path": "top_path"})
    out = S.validate_json(out, "doc", price).withColumnRenamed("error_code", "price_code")
    return out.select("k", F.col("c").alias("error_code"), F.col("p").alias("error_path"), "top_code", "top_path", "price_code")


@query("json_error_counts", "G4", f"""WITH {_VALIDATE_SQL}
SELECT split_part(meta, ' ', 1) AS error_code, regexp_replace(split_part(meta, ' ', 2), '\\[\\d+\\]', '[*]') AS error_path,
       count(*) AS rows FROM e GROUP BY ALL""")
def json_error_counts(spark, sf_dir):
    return S.error_counts(S.validate_json(_docs(spark, sf_dir), "doc", DOC_SCHEMA))


# B-AL: an order as a resource with an array of rules; the alias table is derived from the orders' types.
_RES = """'{"Type":"Shop/' || s || '","name":"n' || k || '","apiVersion":"' || (2019 + k % 2) || '","tags":{"Cost.Center":"c' || (k % 3)
 || '"},"Properties":{"Rules":[{"properties":{"Access":"' || CASE WHEN k % 4 = 0 THEN 'Deny' ELSE 'Allow' END || '","port":' || (k % 5)
 || '}},{"name":"x"},{"properties":{"Access":"Deny","port":' || (k % 7) || '}}],"state":{"Code":' || (k % 9) || ',"old":' || (k % 2) || '}}}'"""


@query("resource_aliases", "C13 C24", f"""WITH r AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders),
a AS (SELECT k, s, CASE WHEN k % 4 = 0 THEN 'Deny' ELSE 'Allow' END AS first FROM r)
SELECT k, CASE WHEN s <> 'P' THEN '["' || first || '","Deny"]' END AS access,
       CASE WHEN s <> 'P' THEN '[' || (k % 5) || ',' || (k % 7) || ']' ELSE '[]' END AS ports,
       CASE WHEN s = 'P' THEN NULL WHEN k % 2 = 0 THEN k % 2 ELSE k % 9 END AS code,
       'c' || (k % 3) AS tag, 'n' || k AS full_name, '["' || first || '","Deny"]' AS by_path,
       CASE WHEN s <> 'P' THEN '[{{"access":"' || first || '","port":' || (k % 5) || '}},{{}},{{"access":"Deny","port":' || (k % 7) || '}}]' END
         AS elements FROM a""")
def resource_aliases(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    # a small file is one scan task; parsing is the work
    r = o.repartition(spark.sparkContext.defaultParallelism).select("k", D.document(F.expr(_RES)).alias("doc"))
    types = o.filter("s <> 'P'").select(F.concat(F.lit("shop/"), F.col("s")).alias("type")).distinct()
    # fixed values of the binding: alias, path, API version (null: all others)
    paths = (("Rules[*].access", "properties.rules[*].properties.access", None), ("Rules[*].port", "properties.rules[*].properties.port", None),
             ("code", "properties.state.code", None), ("code", "properties.state.old", "2019"))
    aliases = types.select("type", F.inline(F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(p).alias("path"), F.lit(v).cast("string")
                                                               .alias("api_version")) for a, p, v in paths])))
    kind, api = X.field_value("type", "doc").cast("string"), X.field_value("apiVersion", "doc").cast("string")
    x = X.alias_values(r, "doc", aliases, kind, api)
    x = X.remap_elements(x, "doc", aliases, kind, api)
    text = lambda c: F.to_json(c)
    element = F.from_json(F.to_json(F.try_element_at("elements", F.lit("rules"))), "array<struct<access:string,port:int>>")
    return x.select("k", text(F.try_element_at("aliases", F.lit("rules[*].access"))).alias("access"),
                    text(X.field_value("RULES[*].port", F.lit(None).cast("variant"), "aliases")).alias("ports"),
                    X.field_value("code", F.lit(None).cast("variant"), "aliases").cast("long").alias("code"),
                    X.field_value("tags['Cost.Center']", "doc").cast("string").alias("tag"),
                    X.field_value("fullName", "doc").cast("string").alias("full_name"),
                    text(X.field_value("rules[*].properties.access", "doc")).alias("by_path"), F.to_json(element).alias("elements"))
