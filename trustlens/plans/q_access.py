"""Queries for attribute conditions, action patterns, access review and IP networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conditions as B
from ..operators import access, networks
from .bindings import table
from .registry import query

# Fixed values of the B-AC binding: role patterns with '*' segments.
ROLE_PATTERNS = (("reader", "Shop/*/read"), ("auditor", "*/*/*"), ("deep", "Shop/*/read/extra"))


def _requests(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("request_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("principal_id"),
        F.concat(F.lit("Shop/"), F.col("c_mktsegment"), F.lit("/"),
                 F.when(F.col("o_orderkey") % 2 == 0, "read").otherwise("write")).alias("action"),
        F.concat(F.lit("/nations/"), F.col("c_nationkey").cast("string"), F.lit("/orders/"),
                 F.col("o_orderkey").cast("string")).alias("request_scope"),
        F.col("o_totalprice").alias("totalprice"), F.col("c_acctbal").alias("acctbal"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("orderdate"),
        F.col("c_mktsegment").alias("segment"))


def _assignments(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    pid = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    nat = F.concat(F.lit("/nations/"), F.col("c_nationkey").cast("string"))
    rows = F.array(
        F.struct(F.lit("reader").alias("role"), F.lit(ROLE_PATTERNS[0][1]).alias("pattern"), nat.alias("scope"),
                 F.lit(None).cast("string").alias("condition_id")),
        F.struct(F.lit("writer").alias("role"), F.concat(F.lit("Shop/"), F.col("c_mktsegment"), F.lit("/*")).alias("pattern"),
                 F.lit("/").alias("scope"),
                 F.when(F.col("c_custkey") % 3 == 0, F.lit("acctbal_positive")).alias("condition_id")),
        F.struct(F.lit("auditor").alias("role"), F.lit(ROLE_PATTERNS[1][1]).alias("pattern"), F.lit("/").alias("scope"),
                 F.lit("small_orders").alias("condition_id")),
        F.struct(F.lit("deep").alias("role"), F.lit(ROLE_PATTERNS[2][1]).alias("pattern"), F.lit("/").alias("scope"),
                 F.lit(None).cast("string").alias("condition_id")))
    a = c.select(pid.alias("principal_id"), F.col("c_custkey"), F.explode(rows).alias("a"))
    # auditor role only for every fifth customer
    a = a.filter((F.col("a.role") != "auditor") | (F.col("c_custkey") % 5 == 0))
    return a.select("principal_id", "a.*")


_REQ_CTE = """rq AS (SELECT o_orderkey AS request_id, 'c' || CAST(o_custkey AS VARCHAR) AS principal_id,
        'Shop/' || c_mktsegment || '/' || CASE WHEN o_orderkey % 2 = 0 THEN 'read' ELSE 'write' END AS action,
        '/nations/' || CAST(c_nationkey AS VARCHAR) || '/orders/' || CAST(o_orderkey AS VARCHAR) AS request_scope,
        o_totalprice AS totalprice, c_acctbal AS acctbal, o_orderpriority AS priority, c_mktsegment AS segment,
        o_orderdate AS orderdate
      FROM orders JOIN customer ON o_custkey = c_custkey),
asg AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS principal_id, 'reader' AS role, 'Shop/*/read' AS pattern,
               '/nations/' || CAST(c_nationkey AS VARCHAR) AS scope, NULL AS condition_id FROM customer
        UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'writer', 'Shop/' || c_mktsegment || '/*', '/',
               CASE WHEN c_custkey % 3 = 0 THEN 'acctbal_positive' END FROM customer
        UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'auditor', '*/*/*', '/', 'small_orders'
               FROM customer WHERE c_custkey % 5 = 0
        UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'deep', 'Shop/*/read/extra', '/', NULL FROM customer)"""

_MATCH_SQL = """(len(string_split(r.action, '/')) = len(string_split(a.pattern, '/'))
   AND list_bool_and(list_transform(list_zip(string_split(r.action, '/'), string_split(a.pattern, '/')),
                                     lambda z: z[2] = '*' OR z[1] = z[2])))"""


@query("match_actions", "J5 B20", f"""WITH {_REQ_CTE}
SELECT r.request_id, a.role FROM rq r JOIN asg a ON r.principal_id = a.principal_id WHERE {_MATCH_SQL}""")
def match_actions(spark, sf_dir):
    m = access.match_actions(_requests(spark, sf_dir), _assignments(spark, sf_dir), extra_keys=["principal_id"])
    return m.select("request_id", "role")


@query("access_review", "B23 B6 B7 J5", f"""WITH {_REQ_CTE},
c AS (SELECT r.request_id, a.role,
             (r.request_scope = a.scope OR starts_with(r.request_scope, rtrim(a.scope) || '/') OR a.scope = '/') AS in_scope,
             CASE WHEN a.condition_id IS NULL THEN true
                  WHEN a.condition_id = 'acctbal_positive' THEN CAST(floor(r.acctbal) AS BIGINT) > 0
                  WHEN a.condition_id = 'small_orders' THEN
                       CASE WHEN r.totalprice = floor(r.totalprice) THEN CAST(r.totalprice AS BIGINT) < 100000 END END AS cond
      FROM rq r JOIN asg a ON r.principal_id = a.principal_id WHERE {_MATCH_SQL}),
g AS (SELECT request_id, bool_or(coalesce(in_scope AND cond, false)) AS granted,
             min(CASE WHEN coalesce(in_scope AND cond, false) THEN role END) AS granting_role,
             bool_or(in_scope AND cond IS NULL) AS error FROM c GROUP BY request_id)
SELECT r.request_id, coalesce(g.granted, false) AS granted, g.granting_role, coalesce(g.error, false) AS error
FROM rq r LEFT JOIN g USING (request_id)""")
def access_review(spark, sf_dir):
    conds = {
        "acctbal_positive": B.numeric_greater_than(F.floor(F.col("acctbal")), 0),
        # totalprice has cents: a fractional number is a type error in a numeric condition
        "small_orders": B.numeric_less_than(F.col("totalprice"), 100000),
    }
    return access.access_review(_requests(spark, sf_dir), _assignments(spark, sf_dir), conds)


@query("condition_operators", "B1 B2 B3 B4 B5 B6 B7 B8 B9 B10 B11 B12 B14 B15 B16 B17 B18 B19 B21 B22", f"""WITH {_REQ_CTE}
SELECT request_id,
  segment = 'MACHINERY' AS b1_eq, list_contains(['AUTOMOBILE', 'MACHINERY'], segment) AS b1_in_list,
  lower(segment) = 'machinery' AS b2_eq_ic,
  regexp_full_match(action, '(?s)Shop/.*/read') AS b3_like,
  starts_with(priority, '1-') AS b4_starts, ends_with(action, 'write') AS b4_ends, contains(principal_id, '99') AS b4_contains,
  regexp_matches(request_scope, '/orders/1[0-9]{{3}}$') AS b5_matches,
  CAST(substr(priority, 1, 1) AS BIGINT) >= 3 AS b6_ge,
  CAST(substr(priority, 1, 1) AS BIGINT) BETWEEN 2 AND 4 AS b7_in_range,
  (request_id % 2 = 0) = true AS b8_bool,
  orderdate < DATE '1995-06-01' AS b9_dt, orderdate <= DATE '1995-06-01' AS b9_dt_le,
  orderdate >= DATE '1995-06-01' AS b9_dt_ge, orderdate <> DATE '1995-06-01' AS b9_dt_ne,
  (request_id % 86400) >= 12 * 3600 AS b10_tod,
  (request_id % 86400) BETWEEN 9 * 3600 AND 17 * 3600 AS b11_tod_range,
  lower('C' || CAST(request_id % 7 AS VARCHAR)) = 'c3' AS b12_guid,
  list_contains(string_split(action, '/'), 'read') AS b14_list_contains,
  len(list_filter(string_split(action, '/'), lambda x: x IN ('Shop', 'read', 'write', 'BUILDING'))) > 0 AS b15_any_any,
  len(list_filter(string_split(action, '/'), lambda x: x NOT IN ('Shop', 'read', 'write', 'BUILDING', 'FURNITURE'))) = 0 AS b16_all_any,
  list_contains(['read', 'Shop'], string_split(action, '/')[3]) AS b17_any_all,
  request_id % 2 = 0 AS b18_all_all,
  coalesce(list_bool_or(list_transform(string_split(action, '/'), lambda x: length(x) > 8)), false) AS b19_any,
  coalesce(list_bool_and(list_transform(string_split(action, '/'), lambda x: length(x) >= 4)), false) AS b19_all,
  priority = '1-URGENT' AS b21_subop,
  upper(trim('  ' || segment || ' ')) AS b22_upper_trim
FROM rq""")
def condition_operators(spark, sf_dir):
    r = _requests(spark, sf_dir)
    segs = F.split(F.col("action"), "/")
    tod = F.format_string("%02d:%02d:%02d", (F.col("request_id") % 86400 / 3600).cast("int"),
                          (F.col("request_id") % 3600 / 60).cast("int"), (F.col("request_id") % 60).cast("int"))
    return r.select(
        "request_id",
        B.string_equals(F.col("segment"), "MACHINERY").alias("b1_eq"),
        B.string_equals(F.col("segment"), ["AUTOMOBILE", "MACHINERY"]).alias("b1_in_list"),
        B.string_equals(F.col("segment"), "machinery", ignore_case=True).alias("b2_eq_ic"),
        B.string_like(F.col("action"), "Shop/*/read").alias("b3_like"),
        B.string_starts_with(F.col("priority"), "1-").alias("b4_starts"),
        B.string_ends_with(F.col("action"), "write").alias("b4_ends"),
        B.string_contains(F.col("principal_id"), "99").alias("b4_contains"),
        B.string_matches(F.col("request_scope"), "/orders/1[0-9]{3}$").alias("b5_matches"),
        B.numeric_greater_than_equals(F.substring("priority", 1, 1), 3).alias("b6_ge"),
        B.numeric_in_range(F.substring("priority", 1, 1), 2, "4").alias("b7_in_range"),
        B.bool_equals(F.col("request_id") % 2 == 0, True).alias("b8_bool"),
        B.datetime_less_than(_stamp(), "1995-06-01T01:00:00+01:00").alias("b9_dt"),
        B.datetime_less_than_or_equals(_stamp(), "1995-06-01T00:00:00Z").alias("b9_dt_le"),
        B.datetime_greater_than_or_equals(_stamp(), "1995-06-01T00:00:00Z").alias("b9_dt_ge"),
        B.datetime_not_equals(_stamp(), "1995-06-01T02:00:00+02:00").alias("b9_dt_ne"),
        B.time_of_day_cmp(lambda a, b: a >= b, tod, "12:00").alias("b10_tod"),
        B.time_of_day_in_range(tod, "17:00:00", "09:00").alias("b11_tod_range"),
        B.guid_equals(F.concat(F.lit("C"), (F.col("request_id") % 7).cast("string")), "c3").alias("b12_guid"),
        B.list_contains(segs, "read").alias("b14_list_contains"),
        B.for_any_of_any_values(segs, ["Shop", "read", "write", "BUILDING"]).alias("b15_any_any"),
        B.for_all_of_any_values(segs, ["Shop", "read", "write", "BUILDING", "FURNITURE"]).alias("b16_all_any"),
        B.for_any_of_all_values(segs, ["read", "read"]).alias("b17_any_all"),
        B.for_all_of_all_values(F.slice(segs, 3, 1), ["read", "read"]).alias("b18_all_all"),
        B.any_element(segs, lambda x: F.length(x) > 8).alias("b19_any"),
        B.all_elements(segs, lambda x: F.length(x) >= 4).alias("b19_all"),
        B.sub_operation_matches(F.col("priority"), "1-URGENT").alias("b21_subop"),
        B.to_upper(B.trim(F.concat(F.lit("  "), F.col("segment"), F.lit(" ")))).alias("b22_upper_trim"),
    )


def _stamp():
    return F.date_format("orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")


# B-FC: order rows as condition inputs, every third missing and every fifth malformed.
_FC_CTE = """fc AS (SELECT o_orderkey AS request_id,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS s,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey AS VARCHAR) || '.0'
       ELSE CAST(o_orderkey AS VARCHAR) END AS n,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'garbage'
       ELSE '10.' || CAST(o_orderkey % 4 AS VARCHAR) || '.0.1' END AS ip,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN '2001:db8:::1'
       WHEN o_orderkey % 2 = 0 THEN '2001:db8::' || CAST(o_orderkey % 1000 AS VARCHAR)
       ELSE '2001:DB9:0:0:0:0:0:' || CAST(o_orderkey % 1000 AS VARCHAR) END AS ip6 FROM orders)"""


@query("fail_closed_conditions", "B2 B3 B4 B5 B6 B7 B8 B12 B13", f"""WITH {_FC_CTE}
SELECT request_id, lower(s) <> '1-urgent' AS b2_ne_ic, s <> '1-URGENT' AS b2_ne,
  NOT starts_with(s, '1-') AS b3_not_like, NOT starts_with(s, '1-') AS b4_not_starts,
  NOT ends_with(s, 'HIGH') AS b4_not_ends, NOT contains(s, 'E') AS b4_not_contains,
  NOT regexp_matches(s, '^[12]') AS b5_not_matches,
  CASE WHEN contains(n, '.') THEN NULL ELSE CAST(n AS BIGINT) <> 7 END AS b6_ne,
  CASE WHEN contains(n, '.') THEN NULL ELSE CAST(n AS BIGINT) BETWEEN 10 AND 5000 END AS b7_in_range,
  CAST(NULL AS BOOLEAN) AS b8_text, lower(s) <> '2-high' AS b12_ne,
  CASE WHEN ip <> 'garbage' THEN NOT starts_with(ip, '10.2.') END AS b13_not_match,
  CASE WHEN ip <> 'garbage' THEN false END AS b13_reversed,
  CASE WHEN NOT contains(ip6, ':::') THEN contains(ip6, 'db8') END AS b13_v6,
  CASE WHEN NOT contains(ip6, ':::') THEN false END AS b13_other_family FROM fc""")
def fail_closed_conditions(spark, sf_dir):
    k = F.col("o_orderkey")
    text = k.cast("string")
    missing = lambda c: F.when(k % 3 != 0, c)
    d = table(spark, sf_dir, "orders").select(
        k.alias("request_id"), missing(F.col("o_orderpriority")).alias("s"),
        missing(F.when(k % 5 == 0, F.concat(text, F.lit(".0"))).otherwise(text)).alias("n"),
        missing(F.when(k % 5 == 0, F.lit("garbage")).otherwise(
            F.concat(F.lit("10."), (k % 4).cast("string"), F.lit(".0.1")))).alias("ip"),
        missing(F.when(k % 5 == 0, F.lit("2001:db8:::1")).when(
            k % 2 == 0, F.concat(F.lit("2001:db8::"), (k % 1000).cast("string"))).otherwise(
            F.concat(F.lit("2001:DB9:0:0:0:0:0:"), (k % 1000).cast("string")))).alias("ip6"))
    s, n, ip, ip6 = (F.col(c) for c in ("s", "n", "ip", "ip6"))
    return d.select(
        "request_id", B.string_not_equals(s, "1-urgent", ignore_case=True).alias("b2_ne_ic"),
        B.string_not_equals(s, "1-URGENT").alias("b2_ne"), B.string_not_like(s, "1-*").alias("b3_not_like"),
        B.string_not_starts_with(s, "1-").alias("b4_not_starts"), B.string_not_ends_with(s, "HIGH").alias("b4_not_ends"),
        B.string_not_contains(s, "E").alias("b4_not_contains"), B.string_not_matches(s, "^[12]").alias("b5_not_matches"),
        B.numeric_not_equals(n, 7).alias("b6_ne"), B.numeric_in_range(n, 10, "5000").alias("b7_in_range"),
        B.bool_equals(s, True).alias("b8_text"), B.guid_not_equals(s, "2-high").alias("b12_ne"),
        B.ip_not_match(ip, "10.2.0.0/16").alias("b13_not_match"),
        B.ip_in_range(ip, "10.3.0.0", "10.0.0.0").alias("b13_reversed"),
        B.ip_match(ip6, "2001:db8::/32").alias("b13_v6"), B.ip_match(ip6, "10.0.0.0/8").alias("b13_other_family"))


# Fixed values of the B-IP binding: the network list.
NETWORKS = (("lab", "10.0.0.0/16"), ("half", "10.1.128.0/17"), ("tiny", "10.2.5.0/24"),
            ("corp", "10.0.0.0/8"), ("span", "10.3.10.0-10.3.20.255"), ("home", "192.168.0.0/16"))


def _ips(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ip = F.concat_ws(".", F.lit("10"), (F.col("user_id") % 4).cast("string"),
                     (F.col("user_id") % 256).cast("string"), (F.col("event_id") % 256).cast("string"))
    return e.select("event_id", ip.alias("ip"))


_IP_CTE = """ip AS (SELECT event_id, 167772160 + (user_id % 4) * 65536 + (user_id % 256) * 256 + (event_id % 256) AS v
       FROM events),
nets AS (SELECT * FROM (VALUES ('lab', 167772160, 167837695), ('half', 167870464, 167903231),
                               ('tiny', 167904512, 167904767), ('corp', 167772160, 184549375),
                               ('span', 167971328, 167974143), ('home', 3232235520, 3232301055)) t(net_id, lo, hi))"""


@query("match_networks", "J6", f"""WITH {_IP_CTE}
SELECT event_id, net_id FROM ip JOIN nets ON v BETWEEN lo AND hi""")
def match_networks(spark, sf_dir):
    nets = networks.networks_frame(spark, list(NETWORKS))
    return networks.match_networks(_ips(spark, sf_dir), "ip", nets).select("event_id", "net_id")


@query("ip_conditions", "B13", f"""WITH {_IP_CTE}
SELECT event_id, v BETWEEN 167870464 AND 167903231 AS b13_match, NOT (v BETWEEN 167904512 AND 167904767) AS b13_not_match,
       v BETWEEN 167971328 AND 167974143 AS b13_in_range FROM ip""")
def ip_conditions(spark, sf_dir):
    i = _ips(spark, sf_dir)
    return i.select("event_id", B.ip_match(F.col("ip"), "10.1.128.0/17").alias("b13_match"),
                    B.ip_not_match(F.col("ip"), "10.2.5.0/24").alias("b13_not_match"),
                    B.ip_in_range(F.col("ip"), "10.3.10.0", "10.3.20.255").alias("b13_in_range"))
