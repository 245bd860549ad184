"""Queries over the resource binding: condition operators and compliance evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy as P
from ..operators import compliance as C
from .bindings import RESOURCES_CTE, resources, table
from .registry import query


@query("policy_operators", "C1 C2 C3 C4 C5 C6 C7 C8 C9 C10 C11 C13", f"""WITH {RESOURCES_CTE}
SELECT id,
  lower(coalesce(type, '')) = '1-urgent' AS c1_eq,
  key = 15 AS c1_eq_num,
  NOT (lower(coalesce(env, '')) = 'prod') AS c2_ne,
  coalesce(totalprice > 200000, false) AS c3_gt,
  coalesce(lower(type) < '3-medium', false) AS c3_lt_text,
  coalesce(key >= 100, false) AS c3_ge_coerced,
  lower(CAST(key AS VARCHAR)) = '7' AS c1_text_text, CAST(key AS VARCHAR) < '2' AS c3_text_text,
  key IN (7, 15, 100) AS c4_coerced, false AS c1_text_not_number,
  CASE WHEN status IS NULL THEN false ELSE lower(status) IN ('f', 'o') END AS c4_in,
  CASE WHEN env IS NULL THEN true ELSE lower(env) NOT IN ('prod') END AS c5_not_in,
  contains(lower(name), '12') AS c6_contains_text,
  coalesce(list_bool_or(list_transform(lines, lambda e: lower(e.returnflag) = 'r')), false) AS c6_contains_array,
  CASE WHEN lines IS NULL THEN true
       ELSE NOT coalesce(list_bool_or(list_transform(lines, lambda e: lower(e.returnflag) = 'r')), false) END AS c6_not_contains_array,
  env IS NOT NULL AS c7_contains_key,
  regexp_full_match(name, '(?is)res\\-1.3.*') AS c8_like,
  regexp_full_match(name, 'res\\-[0-9][0-9][0-9]') AS c9_match,
  regexp_full_match(name, '(?i)RES\\-[0-9][0-9][0-9][0-9]') AS c9_match_insensitive,
  env IS NOT NULL AS c10_exists,
  lines IS NULL AS c10_not_exists,
  coalesce(totalprice / 1000 > 150, false) AS c11_value
FROM res""")
def policy_operators(spark, sf_dir):
    r = resources(spark, sf_dir)
    env = P.field("tags['env']")
    flags = P.collect_field(F.col("lines"), "returnflag")
    return r.select(
        "id",
        P.equals(P.field("TYPE"), "1-urgent").alias("c1_eq"),
        P.equals(F.col("key"), "15").alias("c1_eq_num"),
        P.not_equals(env, "prod").alias("c2_ne"),
        P.greater(F.col("totalprice"), 200000).alias("c3_gt"),
        P.less(P.field("type"), "3-medium").alias("c3_lt_text"),
        P.greater_or_equals(F.col("key"), "100").alias("c3_ge_coerced"),
        P.equals(F.col("key").cast("string"), "7").alias("c1_text_text"),
        P.less(F.col("key").cast("string"), "2").alias("c3_text_text"),
        P.in_(F.col("key"), ["7", 15, "100.0"]).alias("c4_coerced"),
        P.equals(F.concat(F.col("key").cast("string"), F.lit(".0")), F.col("key").cast("string")).alias("c1_text_not_number"),
        P.in_(P.field("TAGS.Status"), ["f", "O"]).alias("c4_in"),
        P.not_in(env, ["prod"]).alias("c5_not_in"),
        P.contains(F.col("name"), "12").alias("c6_contains_text"),
        P.contains(flags, "r", "array").alias("c6_contains_array"),
        P.not_contains(flags, "r", "array").alias("c6_not_contains_array"),
        P.contains_key(F.col("tags"), "ENV").alias("c7_contains_key"),
        P.like(F.col("name"), "res-1?3*").alias("c8_like"),
        P.match(F.col("name"), "res-###").alias("c9_match"),
        P.match_insensitively(F.col("name"), "RES-####").alias("c9_match_insensitive"),
        P.exists(env, True).alias("c10_exists"),
        P.exists(F.col("lines"), "false").alias("c10_not_exists"),
        P.value_condition(F.col("totalprice") / 1000, lambda v: v > 150).alias("c11_value"),
    )


def _pair(lines):
    """Two outer elements that hold the lines; with more than three lines the second holds none."""
    one = F.struct(F.lit(0).alias("least"), lines.alias("items"))
    two = F.struct(F.lit(0).alias("least"), F.when(F.size(lines) <= 3, lines).alias("items"))
    return F.array(one, two)


@query("policy_arrays", "C12 C14 C15 C16 C17 C18", f"""WITH {RESOURCES_CTE}
SELECT id,
  coalesce(list_bool_and(list_transform(lines, lambda e: e.quantity <= 45)), false) AS c14_all,
  coalesce(len(list_filter(lines, lambda e: e.quantity > 25)), 0) AS c15_count,
  coalesce(list_bool_or(list_transform(lines, lambda e: e.quantity > 49)), false) AS c15_exists,
  len(list_filter(['A', 'N', 'R'], lambda v: coalesce(list_bool_or(list_transform(lines, lambda e: lower(e.returnflag) = lower(v))), false))) AS c16_count_values,
  list_transform(lines, lambda e: e.linestatus) AS c18_collect,
  CASE WHEN lines IS NULL OR len(lines) > 3 THEN NULL ELSE len(lines) * 2 END AS c17_nested,
  CASE WHEN lines IS NULL THEN 0 WHEN len(lines) > 3 THEN len(list_filter(lines, lambda e: e.quantity > 25))
       ELSE 2 * len(list_filter(lines, lambda e: e.quantity > 25)) END AS c17_nested_where,
  (lower(coalesce(type, '')) = '1-urgent' AND coalesce(len(list_filter(lines, lambda e: e.quantity > 25)), 0) >= 2)
    OR NOT (coalesce(totalprice > 100000, false)) AS c12_logic
FROM res""")
def policy_arrays(spark, sf_dir):
    r = resources(spark, sf_dir)
    lines = F.col("lines")
    return r.select(
        "id",
        P.every_element(lines, lambda e: e["quantity"] <= 45).alias("c14_all"),
        P.count_where(lines, lambda e: e["quantity"] > 25).alias("c15_count"),
        P.any_element(lines, lambda e: e["quantity"] > 49).alias("c15_exists"),
        P.count_values(["A", "N", "R"], lambda v: P.contains(P.collect_field(lines, "returnflag"), v, "array"))
         .alias("c16_count_values"),
        P.collect_field(lines, "linestatus").alias("c18_collect"),
        P.nested_count(_pair(lines), "items").alias("c17_nested"),
        P.nested_count(_pair(lines), "items", lambda o, i: (o["least"] <= i["quantity"])
                       & (i["quantity"] > 25)).alias("c17_nested_where"),
        P.any_of(P.all_of(P.equals(F.col("type"), "1-urgent"), P.count_where(lines, lambda e: e["quantity"] > 25) >= 2),
                 P.not_(P.greater(F.col("totalprice"), 100000))).alias("c12_logic"),
    )


def demo_policies():
    lines = F.col("lines")
    return [
        C.Policy("urgent-open", P.all_of(P.equals(F.col("type"), "1-urgent"),
                                         P.not_equals(P.field("tags['status']"), "F")), "deny"),
        C.Policy("big-lines", P.any_element(lines, lambda e: e["quantity"] > 45), C.Param("effect"),
                 defaults={"effect": "Audit"}),
        C.Policy("returned-only", P.every_element(lines, lambda e: P.in_(e["returnflag"], ["R", "A"])), "audit",
                 resource_type="5-LOW"),
        C.Policy("off", F.lit(True), "Disabled"),
        C.Policy("untagged-env", P.exists(P.field("tags['env']"), False), C.Param("effect"),
                 defaults={"effect": "audit"}),
    ]


_EVAL_SQL = f"""{RESOURCES_CTE},
ev AS (
  SELECT id, type, 'urgent-open' AS policy,
         lower(type) = '1-urgent' AND NOT (lower(coalesce(status, '')) = 'f') AS m, 'deny' AS eff FROM res
  UNION ALL
  SELECT id, type, 'big-lines', coalesce(list_bool_or(list_transform(lines, lambda e: e.quantity > 45)), false),
         'denyaction' FROM res
  UNION ALL
  SELECT id, type, 'returned-only',
         coalesce(list_bool_and(list_transform(lines, lambda e: lower(e.returnflag) IN ('r', 'a'))), false), 'audit'
  FROM res WHERE lower(type) = '5-low'
  UNION ALL
  SELECT id, type, 'untagged-env', env IS NULL, 'denyaction' FROM res)"""


@query("compliance_evaluate", "C19 C20 J9", f"""WITH {_EVAL_SQL}
SELECT id, type, policy, CASE WHEN m THEN eff END AS effect, NOT m AS compliant FROM ev""")
def compliance_evaluate(spark, sf_dir):
    return C.evaluate(resources(spark, sf_dir), demo_policies(), params={"effect": "DenyAction"})


@query("compliance_report", "C26", f"""WITH {_EVAL_SQL}
SELECT policy, type, count(*) FILTER (WHERE NOT m) AS compliant, count(*) FILTER (WHERE m) AS non_compliant,
       round(count(*) FILTER (WHERE NOT m) / count(*), 6) AS compliance_rate FROM ev GROUP BY ALL""")
def compliance_report(spark, sf_dir):
    res = C.evaluate(resources(spark, sf_dir), demo_policies(), params={"effect": "DenyAction"})
    return C.compliance_report(res)


@query("audit_if_not_exists", "C21 J4", f"""WITH {RESOURCES_CTE}
SELECT r.id FROM res r
WHERE lower(r.type) = '1-urgent'
  AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = (SELECT o_custkey FROM orders o WHERE o.o_orderkey = r.key)
                  AND c.c_acctbal > 0)""")
def audit_if_not_exists(spark, sf_dir):
    r = resources(spark, sf_dir).filter(P.equals(F.col("type"), "1-urgent"))
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust"))
    matched = r.join(owners, "key", "inner")
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), "c_acctbal")
    return C.if_not_exists(matched, cust, ["cust"], F.col("c_acctbal") > 0).select("id")


def _modify_policy():
    return C.Policy("tag-env", P.exists(P.field("tags['env']"), False), "modify",
                    details=[("addOrReplace", "tags['env']", "dev"), ("remove", "tags['status']", None),
                             ("add", "owner", "nobody"), ("addOrReplace", "totalprice", "10.5"),
                             ("append", "zones", "z1")])


@query("modify_patches", "C22 C23", f"""WITH {RESOURCES_CTE}
SELECT id, 'tag-env' AS policy, 5 AS n_ops, 'addorreplace' AS first_op, 'nobody' AS owner FROM res WHERE env IS NULL""")
def modify_patches(spark, sf_dir):
    r = resources(spark, sf_dir)
    pol = _modify_policy()
    nc = r.filter(pol.condition)
    return C.patch_rows(nc, pol).select(
        "id", "policy", F.size("operations").alias("n_ops"), F.col("operations")[0]["operation"].alias("first_op"),
        F.filter("operations", lambda o: o["field"] == "owner")[0]["value"].alias("owner"))


@query("apply_patches", "C22 C23", f"""WITH {RESOURCES_CTE}
SELECT id, CASE WHEN env IS NULL THEN 'dev' ELSE env END AS env,
       CASE WHEN env IS NULL THEN NULL ELSE status END AS status,
       CASE WHEN env IS NULL THEN 'nobody' END AS owner, CASE WHEN env IS NULL THEN 10.5 ELSE totalprice END AS totalprice,
       CASE WHEN env IS NULL THEN 'z1' END AS zone FROM res""")
def apply_patches(spark, sf_dir):
    r = resources(spark, sf_dir)
    pol = _modify_policy()
    out = C.apply_patches(r, pol, where=pol.condition)
    return out.select("id", F.try_element_at("tags", F.lit("env")).alias("env"),
                      F.try_element_at("tags", F.lit("status")).alias("status"), "owner", "totalprice",
                      F.col("zones")[0].alias("zone"))


_PARAM_CTE = """defs AS (SELECT r_name AS policy, p.param, p.default_value FROM region,
        (VALUES ('effect', 'Audit'), ('maxBalance', '5000')) p(param, default_value)),
asg AS (SELECT n_name AS assignment, r_name AS policy, 'effect' AS param, 'Deny' AS value
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0
        UNION ALL
        SELECT n_name, r_name, 'maxBalance', CAST(n_nationkey * 100 AS VARCHAR)
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 = 0),
scopes AS (SELECT n_name AS assignment, r_name AS policy FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query("effective_params", "J8 C20", f"""WITH {_PARAM_CTE}
SELECT s.assignment, s.policy, d.param, coalesce(a.value, d.default_value) AS value
FROM scopes s JOIN defs d ON s.policy = d.policy
LEFT JOIN asg a ON a.assignment = s.assignment AND a.param = d.param""")
def effective_params(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    # Fixed values of the binding: parameter names and defaults.
    defs = region.select(F.col("r_name").alias("policy"),
                         F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.lit(v).alias("default_value"))
                                             for p, v in (("effect", "Audit"), ("maxBalance", "5000"))])).alias("d")
                         ).select("policy", "d.param", "d.default_value")
    nr = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("assignment"), F.col("r_name").alias("policy"), "n_nationkey")
    vals = (nr.filter(F.col("n_nationkey") % 3 == 0).select("assignment", "policy", F.lit("effect").alias("param"),
                                                           F.lit("Deny").alias("value"))
            .unionByName(nr.filter(F.col("n_nationkey") % 4 == 0).select(
                "assignment", "policy", F.lit("maxBalance").alias("param"),
                (F.col("n_nationkey") * 100).cast("string").alias("value"))))
    scopes = nr.select("assignment", "policy", F.lit(None).cast("string").alias("param"),
                       F.lit(None).cast("string").alias("value"))
    return C.effective_params(vals.unionByName(scopes), defs).filter(F.col("param").isNotNull())


@query("applicable_policies", "J9", f"""WITH {RESOURCES_CTE},
pol AS (SELECT DISTINCT o_orderpriority AS resource_type, 'per-' || o_orderpriority AS policy FROM orders
        UNION ALL SELECT '*', 'all-types')
SELECT r.id, p.policy FROM res r JOIN pol p ON lower(p.resource_type) = lower(r.type) OR p.resource_type = '*'""")
def applicable_policies(spark, sf_dir):
    pol = (table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("resource_type")).distinct()
           .withColumn("policy", F.concat(F.lit("per-"), F.col("resource_type"))))
    pol = pol.unionByName(spark.range(1).select(F.lit("*").alias("resource_type"), F.lit("all-types").alias("policy")))
    return C.applicable(pol, resources(spark, sf_dir)).select("id", "policy")
