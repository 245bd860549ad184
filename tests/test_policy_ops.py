"""Truth-table checks for compliance operators and role-condition helpers."""

from pyspark.sql import functions as F

from trustlens.functions import conditions as B
from trustlens.functions import policy as P
from trustlens.functions.net import ip_to_key, ip_to_long


def _one(spark, expr, schema="s string", row=("x",)):
    return spark.createDataFrame([row], schema).select(expr.alias("r")).first()["r"]


def test_equals_null_missing(spark):
    df = spark.createDataFrame([("ABC", True), (None, True), (None, False)], "v string, present boolean")
    got = [tuple(r) for r in df.select(
        P.equals(F.col("v"), "abc"), P.equals(F.col("v"), ""), P.equals(F.col("v"), None),
        P.equals(F.col("v"), "", F.col("present")), P.not_equals(F.col("v"), "x", F.col("present"))).collect()]
    assert got[0] == (True, False, False, False, True)
    assert got[1] == (False, True, True, True, True)      # null equals '' and null
    assert got[2] == (False, True, True, False, True)     # missing equals only null


def test_coercion_and_order(spark):
    assert _one(spark, P.equals(F.lit(5), "5")) is True
    assert _one(spark, P.greater(F.lit("b"), "A")) is True
    assert _one(spark, P.less(F.lit(None).cast("string"), "a")) is False
    assert _one(spark, P.in_(F.lit(None).cast("string"), ["a"])) is False
    assert _one(spark, P.not_in(F.lit(None).cast("string"), ["a"])) is True


def test_like_match(spark):
    assert _one(spark, P.like(F.lit("Res-123"), "res-1?3*")) is True
    assert _one(spark, P.like(F.lit("a.b"), "a?b")) is True
    assert _one(spark, P.like(F.lit("ab"), "a?b")) is False
    assert _one(spark, P.match(F.lit("ab-12"), "??-##")) is True
    assert _one(spark, P.match(F.lit("AB-12"), "ab-##")) is False
    assert _one(spark, P.match_insensitively(F.lit("AB-12"), "ab-##")) is True


def test_contains_and_counts(spark):
    df = spark.createDataFrame([([{"q": 1}, {"q": 5}],), (None,), ([],)], "a array<struct<q:int>>")
    got = [tuple(r) for r in df.select(
        P.count_where(F.col("a"), lambda e: e["q"] > 2), P.every_element(F.col("a"), lambda e: e["q"] > 0),
        P.not_contains(P.collect_field(F.col("a"), "q"), 5, "array")).collect()]
    assert got == [(1, True, False), (0, False, True), (0, True, True)]


def test_action_matches(spark):
    cases = [("A.S/accounts/read", "A.S/accounts/*", True), ("A.S/accounts/read", "A.S/*/read", True),
             ("A.S/accounts/read", "A.S/*/write", False), ("A.S/accounts/read", "A.S/accounts", False)]
    for a, p, want in cases:
        assert _one(spark, B.action_matches(F.lit(a), F.lit(p))) is want


def test_numeric_fraction_is_error(spark):
    assert _one(spark, B.numeric_equals(F.lit("12"), 12)) is True
    assert _one(spark, B.numeric_equals(F.lit(1.5), 1)) is None


def test_time_of_day_and_ip(spark):
    assert _one(spark, B.time_of_day_in_range(F.lit("12:30"), "17:00", "09:00:00")) is True
    assert _one(spark, B.time_of_day_in_range(F.lit("23:30"), "22:00", "02:00")) is False
    assert _one(spark, ip_to_long(F.lit("10.0.0.1"))) == 167772161
    assert _one(spark, ip_to_long(F.lit("10.0.0.300"))) is None
    assert _one(spark, B.ip_match(F.lit("192.168.4.7"), "192.168.0.0/16")) is True
    assert _one(spark, B.string_like(F.lit("a?c"), "a?*")) is True


def test_quantifiers(spark):
    assert _one(spark, B.for_any_of_all_values(["x", "y"], ["x"])) is True
    assert _one(spark, B.for_all_of_all_values(["x", "y"], ["x"])) is False
    assert _one(spark, B.all_elements(F.array().cast("array<int>"), lambda x: x > 1)) is True


def test_two_strings_compare_as_text(spark):
    assert _one(spark, P.equals(F.lit("10"), "10.0")) is False
    assert _one(spark, P.less(F.lit("10"), "9")) is True
    assert _one(spark, P.equals(F.lit(10), "10.0")) is True
    assert _one(spark, P.less(F.lit(10), "9")) is False
    assert _one(spark, P.greater(F.lit(10), "x")) is False
    assert _one(spark, P.contains(F.array(F.lit("10")), "10.0", "array")) is False


def test_tag_names_are_case_insensitive(spark):
    df = spark.createDataFrame([({"Env": "prod"},)], "tags map<string,string>")
    assert df.select(P.field("tags['env']").alias("x")).first()["x"] == "prod"


def test_conditions_fail_closed(spark):
    null = F.lit(None).cast("string")
    for c in (B.string_not_equals(null, "a"), B.string_not_equals(null, "a", ignore_case=True),
              B.string_not_like(null, "a*"), B.string_not_starts_with(null, "a"), B.string_not_matches(null, "a"),
              B.string_starts_with(F.lit(5), "5"), B.guid_not_equals(null, "a"), B.ip_not_match(F.lit("garbage"), "10.0.0.0/8"),
              B.numeric_equals(F.lit("12.0"), 12), B.bool_equals(F.lit("true"), True)):
        assert _one(spark, c) is None
    assert _one(spark, B.string_equals(null, "a")) is False
    assert _one(spark, B.ip_in_range(F.lit("10.0.0.5"), "10.0.0.9", "10.0.0.1")) is False
    assert _one(spark, B.datetime_not_equals("2024-01-01T00:00:00Z", "2024-01-01T01:00:00+01:00")) is False


def test_ipv6(spark):
    cases = [("::1", True), ("2001:db8::1", True), ("2001:DB8:0:0:0:0:0:1", True), ("::ffff:10.0.0.1", True), ("::", True),
             ("1:2:3:4:5:6:7:8:9", False), ("1::2::3", False), ("12345::", False), ("10.0.0.256", False), (":::", False)]
    import ipaddress
    for text, ok in cases:
        want = f"{int(ipaddress.ip_address(text)):032x}" if ok else None
        assert _one(spark, ip_to_key(F.lit(text))) == want, text
    assert _one(spark, B.ip_match(F.lit("2001:db8::5"), "2001:db8::/32")) is True
    assert _one(spark, B.ip_match(F.lit("10.0.0.1"), "2001:db8::/32")) is False
