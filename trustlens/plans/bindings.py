"""Bindings from the driver's tables to the operators' input shapes (FIXTURES §2).

Each binding has a Spark builder and the same definition as a DuckDB CTE so the
oracle SQL in ``plans.catalog`` can reproduce the input independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.events import flatten_context, ts_to_ns, yyyymm
from ..model import to_ns

# Fixed values of the bindings.
AS_OF = "2024-01-31 00:00:00"
AS_OF_NS = to_ns(AS_OF)
GEOS = ("US-NYC", "DE-BER", "ES-MAD", "MX-CDM")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- B-EV audit events
def audit_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user of the audit table, from the user column alone."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_did")).distinct()


def audit_events(spark: SparkSession, sf_dir: str, since_ns: int | None = None,
                 user_did: str | None = None) -> DataFrame:
    """events -> audit table (user_did, timestamp_ns, decision, latency_ms, context map ...).
    ``since_ns`` and ``user_did`` filter the stored columns, so they reach the Parquet scan."""
    ev = table(spark, sf_dir, "events")
    if since_ns is not None:
        since = F.timestamp_micros(F.lit(since_ns // 1000)).cast(ev.schema["ts"].dataType)
        ev = ev.filter(F.col("ts") >= since)
    if user_did is not None:
        ev = ev.filter(F.col("user_id") == F.lit(int(user_did[1:])))
    k = F.get_json_object("props", "$.k").cast("int")
    geo = F.element_at(F.array(*[F.lit(g) for g in GEOS]), (k % 5) + 1)  # k%5 = 4 -> NULL
    geo = F.when(k % 5 < 4, geo)
    env = F.struct((k * 20.0).alias("distance_km"))
    device = F.struct(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("id"),
                      (F.lit(1.0) - k / 100.0).alias("trust_score"))
    # wire form of the context (JSON object), and its one-level flattening built directly
    # (same value as flatten_context(context_snapshot), without a JSON round trip per row)
    snapshot = F.to_json(F.struct(geo.alias("geo"), env.alias("env"), device.alias("device")))
    context = F.map_filter(F.create_map(F.lit("geo"), geo, F.lit("env"), F.to_json(env),
                                        F.lit("device"), F.to_json(device)),
                           lambda key, v: v.isNotNull())
    ts = F.col("ts").cast("timestamp")
    return ev.select(
        F.col("event_id"),
        ts_to_ns(ts).alias("timestamp_ns"),
        ts.alias("ts"),
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("session_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_did"),
        F.col("event_type").alias("resource_hash"),
        F.when(F.col("event_type") == "error", "DENY")
         .when(F.col("event_type") == "signup", "CHALLENGE").otherwise("ALLOW").alias("decision"),
        (k / 100.0).alias("risk_score"),
        snapshot.alias("context_snapshot"),
        F.col("value").alias("latency_ms"),
        yyyymm(ts).alias("yyyymm"),
        context.alias("context"),
    )


AUDIT_CTE = f"""audit AS (
  SELECT event_id,
         epoch_us(ts) * 1000 AS timestamp_ns,
         ts,
         's' || CAST(event_id AS VARCHAR) AS session_id,
         'u' || CAST(user_id AS VARCHAR) AS user_did,
         event_type AS resource_hash,
         CASE event_type WHEN 'error' THEN 'DENY' WHEN 'signup' THEN 'CHALLENGE' ELSE 'ALLOW' END AS decision,
         CAST(props->>'$.k' AS INTEGER) / 100.0 AS risk_score,
         value AS latency_ms,
         CAST(CAST(props->>'$.k' AS INTEGER) * 20 AS DOUBLE) AS distance_km,
         1.0 - CAST(props->>'$.k' AS INTEGER) / 100.0 AS device_trust_score,
         CASE CAST(props->>'$.k' AS INTEGER) % 5
              WHEN 0 THEN '{GEOS[0]}' WHEN 1 THEN '{GEOS[1]}'
              WHEN 2 THEN '{GEOS[2]}' WHEN 3 THEN '{GEOS[3]}' END AS geo
  FROM events)"""


# Fixed values of the binding: coordinates of the four geo codes (for W2 distances).
GEO_COORDS = {"US-NYC": (40.7128, -74.006), "DE-BER": (52.52, 13.405),
              "ES-MAD": (40.4168, -3.7038), "MX-CDM": (19.4326, -99.1332)}


def audit_with_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = audit_events(spark, sf_dir)
    geo = F.try_element_at("context", F.lit("geo"))
    lat = F.create_map(*[x for g, (la, _) in GEO_COORDS.items() for x in (F.lit(g), F.lit(la))])
    lon = F.create_map(*[x for g, (_, lo) in GEO_COORDS.items() for x in (F.lit(g), F.lit(lo))])
    return a.withColumn("lat", F.try_element_at(lat, geo)).withColumn("lon", F.try_element_at(lon, geo))


COORDS_SQL = ("CASE geo " + " ".join(f"WHEN '{g}' THEN {la}" for g, (la, _) in GEO_COORDS.items()) + " END AS lat, "
              "CASE geo " + " ".join(f"WHEN '{g}' THEN {lo}" for g, (_, lo) in GEO_COORDS.items()) + " END AS lon")


# ---------------------------------------------------------------- B-RQ access requests
def access_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> access requests with the nested request struct columns."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("s"), key.cast("string")).alias("session_id"),
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_did"),
        F.struct((F.lit(1.0) - (key % 100) / 100.0).alias("trust_score"),
                 F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("id")).alias("device"),
        F.struct(((key * 37) % 2000).cast("double").alias("distance_km"),
                 ((key * 13) % 30).cast("double").alias("time_delta_mins"),
                 F.lit(None).cast("double").alias("anomaly_score")).alias("context"),
        F.struct(F.when(F.col("o_orderpriority") == "1-URGENT", "Admin").otherwise("Dashboard").alias("name"),
                 F.col("o_orderstatus").alias("hash")).alias("resource"),
        key.alias("request_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    )


REQUESTS_CTE = """requests AS (
  SELECT o_orderkey AS request_id,
         's' || CAST(o_orderkey AS VARCHAR) AS session_id,
         'u' || CAST(o_custkey AS VARCHAR) AS user_did,
         1.0 - (o_orderkey % 100) / 100.0 AS trust_score,
         CAST((o_orderkey * 37) % 2000 AS DOUBLE) AS distance_km,
         CAST((o_orderkey * 13) % 30 AS DOUBLE) AS time_delta_mins,
         CAST(NULL AS DOUBLE) AS anomaly_score,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'Admin' ELSE 'Dashboard' END AS resource_name,
         o_orderstatus AS resource_hash
  FROM orders)"""


# ---------------------------------------------------------------- B-RV revocations
def revocation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> revocation log with a replica id."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("cred-"), F.col("o_custkey").cast("string")).alias("credential_id"),
        F.col("o_orderstatus").alias("issuer_did"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("timestamp"),
        F.col("o_orderpriority").alias("reason"),
        (F.col("o_orderkey") % 3).cast("int").alias("replica"),
        F.col("o_orderkey").alias("seq"),
    )


REVOCATIONS_CTE = """revlog AS (
  SELECT 'cred-' || CAST(o_custkey AS VARCHAR) AS credential_id,
         o_orderstatus AS issuer_did,
         CAST(epoch(o_orderdate) AS BIGINT) AS timestamp,
         o_orderpriority AS reason,
         CAST(o_orderkey % 3 AS INTEGER) AS replica,
         o_orderkey AS seq
  FROM orders)"""


def credential_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("cred-"), F.col("c_custkey").cast("string")).alias("credential_id"),
                    F.col("c_name"))


# ---------------------------------------------------------------- B-RS resources
# Fixed values of the binding: three locations picked by o_custkey % 3.
LOCATIONS = ("eastus", "westeurope", "brazilsouth")


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders + lineitem -> resource table; ``lines`` is NULL (missing) for orders without
    line items.  Lines are gathered per order (an order has a handful), so the collect is
    bounded by the key, not by the table."""
    li = (table(spark, sf_dir, "lineitem")
          .groupBy(F.col("l_orderkey").alias("o_orderkey"))
          .agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus",
                                                     "l_quantity"))).alias("_l")))
    li = li.select("o_orderkey", F.transform("_l", lambda e: F.struct(
        e["l_returnflag"].alias("returnflag"), e["l_linestatus"].alias("linestatus"),
        e["l_quantity"].alias("quantity"))).alias("lines"))
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    tags = F.map_filter(F.create_map(F.lit("status"), F.col("o_orderstatus"),
                                     F.lit("env"), F.when(key % 4 == 0, F.lit("prod"))),
                        lambda k, v: v.isNotNull())
    return o.join(li, "o_orderkey", "left").select(
        F.concat(F.lit("res-"), key.cast("string")).alias("id"),
        F.concat(F.lit("res-"), key.cast("string")).alias("name"),
        F.col("o_orderpriority").alias("type"),
        F.element_at(F.array(*[F.lit(x) for x in LOCATIONS]), (F.col("o_custkey") % 3 + 1).cast("int")).alias("location"),
        tags.alias("tags"), "lines", F.col("o_totalprice").alias("totalprice"), key.alias("key"))


RESOURCES_CTE = f"""li AS (SELECT l_orderkey, list({{'returnflag': l_returnflag, 'linestatus': l_linestatus,
                                 'quantity': l_quantity}} ORDER BY l_linenumber, l_returnflag, l_linestatus, l_quantity) AS lines
       FROM lineitem GROUP BY l_orderkey),
res AS (SELECT 'res-' || CAST(o_orderkey AS VARCHAR) AS id, 'res-' || CAST(o_orderkey AS VARCHAR) AS name,
               o_orderpriority AS type,
               ['{LOCATIONS[0]}', '{LOCATIONS[1]}', '{LOCATIONS[2]}'][CAST(o_custkey % 3 + 1 AS INTEGER)] AS location,
               o_orderstatus AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'prod' END AS env,
               li.lines, o_totalprice AS totalprice, o_orderkey AS key
        FROM orders LEFT JOIN li ON li.l_orderkey = orders.o_orderkey)"""
