"""Queries for graph, nested-document and identity jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs, identity as I, nested as N, validate as V
from .bindings import RESOURCES_CTE, resources, table
from .registry import query

_EDGES_SQL = """e AS (
  SELECT 'p' || CAST(l_partkey AS VARCHAR) AS src, 's' || CAST(l_suppkey AS VARCHAR) AS dst FROM lineitem
  UNION SELECT 's' || CAST(l_suppkey AS VARCHAR), 'p' || CAST(l_partkey AS VARCHAR) FROM lineitem),
nodes AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS node FROM part
          UNION SELECT 's' || CAST(s_suppkey AS VARCHAR) FROM supplier)"""


def _id(prefix, col):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def _graph(spark, sf_dir):
    """B-GR: every line item's part -> supplier and back."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    p, s = _id("p", "l_partkey"), _id("s", "l_suppkey")
    e = li.select(p.alias("src"), s.alias("dst")).unionByName(li.select(s.alias("src"), p.alias("dst")))
    part = table(spark, sf_dir, "part")
    nodes = part.select(_id("p", "p_partkey").alias("node")).unionByName(
        table(spark, sf_dir, "supplier").select(_id("s", "s_suppkey").alias("node")))
    seeds = part.filter(F.col("p_partkey") % 500 == 7).select(_id("p", "p_partkey").alias("node"))
    return e, nodes, seeds


@query("reachable", "G1", f"""WITH RECURSIVE {_EDGES_SQL},
r(node) AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) FROM part
            WHERE p_partkey % 500 = 7 AND 'p' || CAST(p_partkey AS VARCHAR) IN (SELECT node FROM nodes)
            UNION SELECT e.dst FROM r JOIN e ON r.node = e.src WHERE e.dst IN (SELECT node FROM nodes))
SELECT node FROM r""")
def reachable(spark, sf_dir):
    e, nodes, seeds = _graph(spark, sf_dir)
    return graphs.reachable(e, nodes, seeds)


# B-GP: region -> nation -> customer -> order -> back to the customer's nation.  Orders with
# status P are referred to but are not nodes; a region 'r9' is a seed that is not one either.
@query("reachable_paths", "G2", """WITH RECURSIVE
c AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS c, 'n' || CAST(c_nationkey AS VARCHAR) AS n FROM customer),
o AS (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS o, 'c' || CAST(o_custkey AS VARCHAR) AS c, o_orderstatus AS st FROM orders),
e AS (SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS src, 'n' || CAST(n_nationkey AS VARCHAR) AS dst FROM nation
      UNION SELECT n, c FROM c UNION SELECT c, o FROM o UNION SELECT o.o, c.n FROM o JOIN c USING (c)),
nodes AS (SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS node FROM region
          UNION SELECT 'n' || CAST(n_nationkey AS VARCHAR) FROM nation UNION SELECT c FROM c
          UNION SELECT o FROM o WHERE st <> 'P'),
p(path, tail) AS (SELECT [node], node FROM nodes WHERE node[1] = 'r'
                  UNION ALL SELECT list_append(p.path, e.dst), e.dst FROM p JOIN e ON e.src = p.tail
                  WHERE e.dst IN (SELECT node FROM nodes) AND NOT list_contains(p.path, e.dst))
SELECT DISTINCT array_to_string(p.path, '>') AS path FROM p LEFT JOIN e ON e.src = p.tail
WHERE e.dst IS NULL OR e.dst NOT IN (SELECT node FROM nodes) OR list_contains(p.path, e.dst)""")
def reachable_paths(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(_id("r", "n_regionkey").alias("r"), _id("n", "n_nationkey").alias("n"))
    c = table(spark, sf_dir, "customer").select(_id("c", "c_custkey").alias("c"), _id("n", "c_nationkey").alias("n"))
    o = table(spark, sf_dir, "orders").select(_id("o", "o_orderkey").alias("o"), _id("c", "o_custkey").alias("c"),
                                              "o_orderstatus")
    regions = table(spark, sf_dir, "region").select(_id("r", "r_regionkey").alias("node"))
    e = (n.select(F.col("r").alias("src"), F.col("n").alias("dst")).unionByName(c.select(F.col("n").alias("src"), F.col("c").alias("dst")))
         .unionByName(o.select(F.col("c").alias("src"), F.col("o").alias("dst")))
         .unionByName(o.join(c, "c").select(F.col("o").alias("src"), F.col("n").alias("dst"))))
    nodes = (regions.unionByName(n.select(F.col("n").alias("node"))).unionByName(c.select(F.col("c").alias("node")))
             .unionByName(o.filter("o_orderstatus <> 'P'").select(F.col("o").alias("node"))))
    seeds = regions.unionByName(regions.limit(1).select(F.lit("r9").alias("node")))
    return graphs.reachable_paths(e, nodes, seeds).select(F.array_join("path", ">").alias("path"))


def _res_json(spark, sf_dir):
    r = resources(spark, sf_dir)
    return r.select("id", F.to_json(F.struct("type", "location", "tags", "lines", "totalprice"),
                                    {"ignoreNullFields": "false"}).alias("doc"))


_WALK_SQL = f"""{RESOURCES_CTE},
d AS (SELECT id, to_json({{'type': type, 'location': location,
                           'tags': CASE WHEN env IS NULL THEN MAP {{'status': status}}
                                        ELSE MAP {{'status': status, 'env': env}} END,
                           'lines': lines, 'totalprice': totalprice}}) AS doc FROM res),
w AS (SELECT d.id, t.fullkey AS path,
             CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string'
                         WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind
      FROM d, json_tree(d.doc) t)"""


@query("walk", "G3", f"""WITH {_WALK_SQL} SELECT id, path, kind FROM w""")
def walk(spark, sf_dir):
    return N.walk(_res_json(spark, sf_dir), "doc", "id").select("id", "path", "kind")


@query("type_profile", "G6", f"""WITH {_WALK_SQL}
SELECT regexp_replace(path, '\\[\\d+\\]', '[*]', 'g') AS path, kind, count(*) AS rows FROM w GROUP BY ALL""")
def type_profile(spark, sf_dir):
    return N.type_profile(_res_json(spark, sf_dir), "doc")


RESOURCE_SCHEMA = {
    "type": "object",
    "required": ["id", "type"],
    "properties": {
        "name": {"type": "string", "pattern": "^res-[0-9]+$", "maxLength": 8},
        "type": {"type": "string", "enum": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]},
        "totalprice": {"type": "number", "minimum": 1000, "maximum": 450000},
        "tags": {"type": "object", "map": True, "additionalProperties": False,
                 "properties": {"status": {"type": "string", "minLength": 1}}},
        "lines": {"type": "array", "minItems": 1, "maxItems": 6,
                  "items": {"type": "object", "properties": {"quantity": {"type": "integer", "maximum": 49}}}},
    },
}

_VALIDATE_SQL = f"""{RESOURCES_CTE},
v AS (SELECT id,
  CASE WHEN id IS NULL THEN 'required' WHEN type IS NULL THEN 'required'
       WHEN name IS NOT NULL AND NOT regexp_matches(name, '^res-[0-9]+$') THEN 'pattern'
       WHEN name IS NOT NULL AND length(name) > 8 THEN 'maxLength'
       WHEN type IS NOT NULL AND type NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') THEN 'enum'
       WHEN totalprice IS NOT NULL AND totalprice < 1000 THEN 'minimum'
       WHEN totalprice IS NOT NULL AND totalprice > 450000 THEN 'maximum'
       WHEN env IS NOT NULL THEN 'additionalProperties'
       WHEN status IS NOT NULL AND length(status) < 1 THEN 'minLength'
       WHEN lines IS NOT NULL AND len(lines) < 1 THEN 'minItems'
       WHEN lines IS NOT NULL AND len(lines) > 6 THEN 'maxItems'
       WHEN coalesce(list_bool_or(list_transform(lines, lambda e: e.quantity <> floor(e.quantity))), false) THEN 'integer'
       WHEN coalesce(list_bool_or(list_transform(lines, lambda e: e.quantity > 49)), false) THEN 'maximum' END AS error_code,
  CASE WHEN id IS NULL THEN '$.id' WHEN type IS NULL THEN '$.type'
       WHEN name IS NOT NULL AND NOT regexp_matches(name, '^res-[0-9]+$') THEN '$.name'
       WHEN name IS NOT NULL AND length(name) > 8 THEN '$.name'
       WHEN type IS NOT NULL AND type NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') THEN '$.type'
       WHEN totalprice IS NOT NULL AND (totalprice < 1000 OR totalprice > 450000) THEN '$.totalprice'
       WHEN env IS NOT NULL THEN '$.tags'
       WHEN status IS NOT NULL AND length(status) < 1 THEN '$.tags.status'
       WHEN lines IS NOT NULL AND (len(lines) < 1 OR len(lines) > 6) THEN '$.lines'
       WHEN coalesce(list_bool_or(list_transform(lines, lambda e: e.quantity <> floor(e.quantity) OR e.quantity > 49)), false)
            THEN '$.lines[*].quantity' END AS error_path
  FROM res)"""


@query("validate_rows", "G4 G4a G4c G4d G4e G4g", f"WITH {_VALIDATE_SQL} SELECT id, error_code, error_path FROM v")
def validate_rows(spark, sf_dir):
    r = resources(spark, sf_dir).select("id", "name", "type", "totalprice", "tags", "lines")
    return V.validate_rows(r, RESOURCE_SCHEMA).select("id", "error_code", "error_path")


@query("validate_error_counts", "G4", f"""WITH {_VALIDATE_SQL}
SELECT error_code, error_path, count(*) AS rows FROM v WHERE error_code IS NOT NULL GROUP BY ALL""")
def validate_error_counts(spark, sf_dir):
    r = resources(spark, sf_dir).select("id", "name", "type", "totalprice", "tags", "lines")
    return V.error_counts(V.validate_rows(r, RESOURCE_SCHEMA))


@query("route_by_type", "G5", f"""WITH {RESOURCES_CTE}
SELECT id, CASE lower(type) WHEN '1-urgent' THEN 'urgent_schema' WHEN '5-low' THEN 'bulk_schema'
           ELSE 'default_schema' END AS schema FROM res""")
def route_by_type(spark, sf_dir):
    r = resources(spark, sf_dir).select("id", "type")
    return N.route_by_type(r, "type", {"1-URGENT": "urgent_schema", "5-low": "bulk_schema"}, "default_schema") \
        .select("id", "schema")


@query("document_ops", "G7 G8 G9", f"""WITH {RESOURCES_CTE}
SELECT id,
  env IS NOT NULL AS kept_has_env,
  CASE WHEN status = 'F' THEN CASE WHEN env IS NULL THEN 0 ELSE 1 END ELSE 1 END AS dropped_size,
  CASE WHEN env IS NULL THEN 'dflt' ELSE env END AS merged_env,
  CASE WHEN env IS NULL THEN 'dflt' ELSE env END AS deep_env, CAST(key % 5 AS VARCHAR) AS deep_other,
  status AS merged_status,
  coalesce(env = 'prod', false) AS is_subset_prod
FROM res""")
def document_ops(spark, sf_dir):
    r = resources(spark, sf_dir)
    t = F.col("tags")
    defaults = F.create_map(F.lit("env"), F.lit("dflt"))
    merged = N.merge_maps(defaults, t)
    deep = N.deep_merge(F.create_map(F.lit("tags"), defaults, F.lit("other"), F.create_map(F.lit("k"), F.lit("x"))),
                        F.create_map(F.lit("tags"), t, F.lit("other"),
                                     F.create_map(F.lit("k"), (F.col("key") % 5).cast("string"))))
    return r.select(
        "id",
        F.map_contains_key(N.keys_keep(t, ["env"]), F.lit("env")).alias("kept_has_env"),
        F.when(t["status"] == "F", F.size(N.keys_drop(t, ["status"]))).otherwise(
            F.size(N.keys_drop(t, ["env"]))).cast("int").alias("dropped_size"),
        F.element_at(merged, F.lit("env")).alias("merged_env"),
        F.try_element_at(F.try_element_at(deep, F.lit("tags")), F.lit("env")).alias("deep_env"),
        F.try_element_at(F.try_element_at(deep, F.lit("other")), F.lit("k")).alias("deep_other"),
        F.element_at(merged, F.lit("status")).alias("merged_status"),
        N.is_subset(t, F.create_map(F.lit("env"), F.lit("prod"))).alias("is_subset_prod"))


@query("url_params", "G10", """WITH q AS (SELECT page_id, url, regexp_extract(url, '\\?([^#]*)', 1) AS qs FROM pages),
kv AS (SELECT page_id, url, unnest(string_split(qs, '&')) AS kv FROM q WHERE qs <> '')
SELECT page_id, url, url_decode(split_part(kv, '=', 1)) AS key,
       CASE WHEN strpos(kv, '=') > 0 THEN url_decode(substr(kv, strpos(kv, '=') + 1)) ELSE '' END AS value
FROM kv WHERE kv <> ''""")
def url_params(spark, sf_dir):
    return N.url_params(table(spark, sf_dir, "pages"), "url", "page_id")


@query("url_key_counts", "G10", """WITH q AS (SELECT regexp_extract(url, '\\?([^#]*)', 1) AS qs FROM pages),
kv AS (SELECT unnest(string_split(qs, '&')) AS kv FROM q WHERE qs <> '')
SELECT url_decode(split_part(kv, '=', 1)) AS key, count(*) AS rows FROM kv WHERE kv <> '' GROUP BY ALL""")
def url_key_counts(spark, sf_dir):
    return N.url_key_counts(N.url_params(table(spark, sf_dir, "pages"), "url", "page_id"))


# ---------------------------------------------------------------- B-ID identity documents
PREFIX = "did:x:"


def _key(did, k, n):
    return F.struct(F.concat(did, F.lit(f"#key-{n}")).alias("id"), F.lit("Multikey").alias("type"),
                    did.alias("controller"),
                    F.concat(F.lit("z"), F.substring(F.sha2(k.cast("string"), 256), 16 * n - 15, 16))
                    .alias("publicKeyMultibase"))


def _docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    did = F.when(k % 7 == 0, F.concat(F.lit("did:y:"), k.cast("string"))).otherwise(
        F.concat(F.lit(PREFIX), k.cast("string")))
    ctx = F.when(k % 13 == 0, F.array(F.lit("https://example.org/ctx"))).otherwise(F.array(F.lit(I.DID_CONTEXT_V1)))
    vm = F.when(k % 11 == 0, F.array().cast("array<struct<id:string,type:string,controller:string,publicKeyMultibase:string>>")) \
        .when(k % 5 == 0, F.array(_key(did, k, 1), _key(did, k, 2))).otherwise(F.array(_key(did, k, 1)))
    return d.select(did.alias("id"), ctx.alias("context"), vm.alias("verification_method"), "text", "doc_id")


_DOCS_CTE = f"""docs AS (SELECT doc_id, text,
  CASE WHEN doc_id % 7 = 0 THEN 'did:y:' ELSE '{PREFIX}' END || CAST(doc_id AS VARCHAR) AS id,
  doc_id % 13 <> 0 AS has_ctx, doc_id % 11 <> 0 AS has_vm FROM documents),
chk AS (SELECT *, CASE WHEN NOT starts_with(id, '{PREFIX}') THEN 'invalid_id' WHEN NOT has_ctx THEN 'missing_context'
                       WHEN NOT has_vm THEN 'no_verification_method' END AS error FROM docs)"""


@query("audit_documents", "I1", f"WITH {_DOCS_CTE} SELECT id, error FROM chk")
def audit_documents(spark, sf_dir):
    return I.audit_documents(_docs(spark, sf_dir), PREFIX).select("id", "error")


_PATTERNS_SQL = ", ".join("('" + p.replace("'", "''") + "')" for p in I.KEY_PATTERNS + ("token = ",))


@query("key_leak_scan", "I2", f"""WITH p(pattern) AS (VALUES {_PATTERNS_SQL})
SELECT pattern, (SELECT count(*) FROM documents WHERE contains(text, pattern)) AS rows FROM p""")
def key_leak_scan(spark, sf_dir):
    return I.key_leak_scan(table(spark, sf_dir, "documents"), "text", I.KEY_PATTERNS + ("token = ",))


_FIRST_LEAK = "CASE " + " ".join(
    "WHEN contains(text, '" + p.replace("'", "''") + "') THEN '" + p.replace("'", "''") + "'" for p in I.KEY_PATTERNS) + " END"


@query("admit_documents", "I3", f"""WITH {_DOCS_CTE}
SELECT id, coalesce('private_key_material:' || {_FIRST_LEAK}, error) AS reason,
       coalesce('private_key_material:' || {_FIRST_LEAK}, error) IS NULL AS admitted FROM chk""")
def admit_documents(spark, sf_dir):
    return I.admit_documents(_docs(spark, sf_dir), PREFIX, "text").select("id", "reason", "admitted")


@query("registry_delete", "I4", f"""WITH {_DOCS_CTE}
SELECT DISTINCT id FROM docs WHERE id NOT IN (SELECT '{PREFIX}' || CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)""")
def registry_delete(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").filter("toxic = 1").select(
        F.concat(F.lit(PREFIX), F.col("doc_id").cast("string")).alias("id"))
    return I.list_ids(I.delete_ids(_docs(spark, sf_dir), lab))


@query("key_fingerprints", "I5", f"""WITH {_DOCS_CTE}
SELECT id, sha256('z' || substr(sha256(CAST(doc_id AS VARCHAR)), 16 * n - 15, 16)) AS fingerprint
FROM docs, (VALUES (1), (2)) m(n) WHERE has_vm AND (n = 1 OR doc_id % 5 = 0)""")
def key_fingerprints(spark, sf_dir):
    d = _docs(spark, sf_dir).filter(F.size("verification_method") > 0)
    vm = d.select("id", F.explode("verification_method").alias("vm"))
    return vm.select("id", I.fingerprint(F.col("vm.publicKeyMultibase")).alias("fingerprint"))


@query("resolve_ids", "J7", f"""WITH {_DOCS_CTE},
ids AS (SELECT CASE WHEN quality = 1 THEN '{PREFIX}' ELSE 'did:y:' END || CAST(doc_id + toxic * 1000000 AS VARCHAR) AS id
        FROM labels)
SELECT ids.id, CASE WHEN NOT starts_with(ids.id, '{PREFIX}') THEN 'bad_id' WHEN chk.id IS NULL THEN 'not_found'
                    WHEN chk.error IS NOT NULL THEN 'invalid' ELSE 'ok' END AS status
FROM ids LEFT JOIN chk ON ids.id = chk.id""")
def resolve_ids(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    ids = lab.select(F.concat(F.when(F.col("quality") == 1, F.lit(PREFIX)).otherwise(F.lit("did:y:")),
                              (F.col("doc_id") + F.col("toxic") * 1000000).cast("string")).alias("id"))
    return I.resolve_ids(ids, _docs(spark, sf_dir), PREFIX)


@query("normalize_resources", "C24 C25", f"""WITH {RESOURCES_CTE}
SELECT id, 5 AS keys, round(CASE WHEN key % 2 = 0 THEN totalprice ELSE key END, 4) AS price, type AS raw_type,
       round(totalprice, 4) AS raw_price, status AS raw_status, location AS raw_location, key % 3 = 0 AS raw_flag
FROM res""")
def normalize_resources(spark, sf_dir):
    from ..operators import normalize as NZ
    r = resources(spark, sf_dir)
    flag = (F.col("key") % 3 == 0).alias("Flag")
    raw = r.select("id", "key", F.to_json(F.struct(
        F.col("type").alias("Type"), F.col("location").alias("Location"),
        F.struct(F.col("totalprice").alias("TotalPrice"), F.lit("hidden by the root").alias("type"), flag,
                 F.struct(F.col("key").alias("Key"), F.col("tags")["status"].alias("status")).alias("State"))
        .alias("Properties"))).alias("raw"))
    # Fixed values of the binding: an alias per resource type with a path of its own for API version
    # 2, and the casing table.
    types = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("type")).distinct()
    of = lambda path, api: types.select("type", F.lit("price").alias("alias"), F.lit(path).alias("path"),
                                        F.lit(api).cast("string").alias("api_version"))
    aliases = of("$.totalprice", None).unionByName(of("$.state.Key", "2"))
    n = NZ.normalize_resources(raw, "raw", "id", aliases, F.when(F.col("key") % 2 == 1, "2").otherwise("1"))
    d = NZ.denormalize(n, "normalized", {"type": "Type", "location": "Location", "totalprice": "TotalPrice", "flag": "Flag"})
    back = lambda path: F.get_json_object("denormalized", path)
    return d.select("id", F.size("normalized").alias("keys"),
                    F.round(F.element_at("aliases", F.lit("price")).cast("double"), 4).alias("price"),
                    back("$.Type").alias("raw_type"), F.round(back("$.properties.TotalPrice").cast("double"), 4).alias("raw_price"),
                    back("$.properties.state.status").alias("raw_status"), back("$.Location").alias("raw_location"),
                    back("$.properties.Flag").cast("boolean").alias("raw_flag"))
