"""Input views over the driver tables.

Each view is one SQL text that runs unchanged in Spark SQL and in DuckDB, so a
Spark query and its oracle read the same definition. Table names are written
as ``{orders}`` placeholders: Spark fills in a direct parquet path (no session
state, no temp views), DuckDB the pre-registered view names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

def _logged(key: str) -> str:
    """A log time (yyyymmddhh text) over 97 days, two of them before the pull
    window of the checks and three behind it, so the window drops rows."""
    return f"replace(CAST(DATE '2019-11-01' + CAST(({key}) % 97 - 2 AS INT) AS STRING), '-', '') || '00' AS inserted_at"


VIEWS: dict[str, str] = {
    # request log: one row per search
    "search_request": """
SELECT CAST(o_orderkey AS STRING) AS requestid,
       CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 43 = 0 THEN '' WHEN o_orderkey % 47 = 0 THEN ' '
            ELSE CAST(o_custkey AS STRING) END AS userid,
       DATE '2019-11-01' + CAST(o_orderkey % 90 + o_orderkey % 45 - 3 AS INT) AS checkin,
       DATE '2019-11-01' + CAST(o_orderkey % 90 + o_orderkey % 45 - 4 + o_orderkey % 6 AS INT) AS checkout,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'android_app' WHEN '2-HIGH' THEN 'ios_app'
            WHEN '3-MEDIUM' THEN 'website' ELSE 'other' END AS platform,
       o_orderkey % 12 AS placeid, c_nationkey AS cityid, n_regionkey AS countryid,
       CASE WHEN o_orderkey % 11 = 0 THEN 1 WHEN o_orderkey % 13 = 0 THEN NULL ELSE 0 END AS nearbysearch,
       replace(CAST(DATE '2019-11-01' + CAST(o_orderkey % 90 AS INT) AS STRING), '-', '') || '00' AS inserted_at
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    # candidates as shown
    "ranked_response": """
SELECT CAST(l_orderkey AS STRING) AS requestid, l_partkey AS itemid,
       CASE WHEN l_partkey % 53 = 0 THEN 0e0 WHEN l_partkey % 59 = 0 THEN NULL ELSE l_extendedprice END AS slasherprice,
       l_linenumber AS item_rank,
       p_size % 7 AS item_type, c_acctbal AS user_abp,
       CASE WHEN l_linestatus = 'F' THEN 'popularity' ELSE 'price' END AS sortby,
       l_suppkey AS suppkey, l_quantity AS quantity, """ + _logged("l_orderkey + l_partkey") + """
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {orders} ON l_orderkey = o_orderkey
  JOIN {customer} ON o_custkey = c_custkey""",
    # clicks, bookings, impressions per candidate
    "device_event": """
SELECT l_partkey AS itemid,
       CASE WHEN l_suppkey % 50 = 0 THEN '-' ELSE CAST(l_orderkey AS STRING) END AS requestid,
       CASE WHEN l_returnflag = 'R' THEN l_orderkey * 100 + l_linenumber END AS bookingid,
       CASE l_returnflag WHEN 'R' THEN 'booking' WHEN 'A' THEN 'hotel_details_page' ELSE 'hotel_impression' END AS event,
       'model' || CAST(l_suppkey % 5 AS STRING) AS dmodel, """ + _logged("l_orderkey + l_suppkey") + """
  FROM {lineitem}""",
    # price, rating, distance, epoch-ms search time over 90 days
    "search_response": """
SELECT CAST(l_orderkey AS STRING) AS requestid, l_partkey AS itemid,
       CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE (l_suppkey % 97) / 10e0 END AS distance,
       CASE WHEN l_suppkey % 89 = 7 THEN NULL ELSE l_extendedprice * (1e0 - l_discount) END AS fprice,
       1e0 + (l_partkey % 41) / 10e0 AS rating, l_quantity AS rcount, l_partkey % 5 AS display_category,
       1572566400123 + (l_orderkey % 90) * 86400000 + (l_orderkey % 24) * 3600000 AS searchtime,
       """ + _logged("l_orderkey + 2 * l_partkey") + """
  FROM {lineitem}""",
    # booking status
    "booking_base": """
SELECT l_orderkey * 100 + l_linenumber AS bookingid,
       CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS status, o_orderdate AS created_at
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""",
    # user x item counters, zeros in the denominators
    "user_item_counts": """
SELECT CAST(l_orderkey AS STRING) AS requestid, l_partkey AS itemid,
       CAST(l_quantity AS BIGINT) - 1 AS impressioncount,
       CAST(floor(l_quantity / 3e0) AS BIGINT) AS detailcount,
       CAST(floor(l_quantity / 10e0) AS BIGINT) AS bookingcount,
       2 * CAST(l_quantity AS BIGINT) - 2 AS userimpressioncount,
       CAST(floor(l_quantity / 2e0) AS BIGINT) AS userdetailcount,
       CAST(floor(l_quantity / 5e0) AS BIGINT) AS userbookingcount,
       """ + _logged("l_orderkey + 3 * l_partkey") + """
  FROM {lineitem}""",
    "request_place": """
SELECT CAST(o_orderkey AS STRING) AS requestid, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 10 END AS placeid
  FROM {orders}""",
    "place": """
SELECT s_suppkey AS placeid, 10e0 + (s_suppkey * 37 % 100) / 100e0 AS lat, 70e0 + (s_suppkey * 53 % 100) / 100e0 AS lng,
       s_suppkey * 7 % 1000 AS popularity,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (s_suppkey % 97) / 10000e0 END AS conversion
  FROM {supplier}""",
    "item_geo": """
SELECT p_partkey AS itemid, 10e0 + (p_partkey * 17 % 1000) / 1000e0 AS lat, 70e0 + (p_partkey * 29 % 1000) / 1000e0 AS lng,
       CAST(p_partkey % 25 AS INT) AS cityid
  FROM {part}""",
    # one row per event: a request is one user-day, an item is props.k
    "timed_event": """
SELECT event_id, ts, CAST(ts AS DATE) AS searchdate, user_id AS userid,
       CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS requestid,
       CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS itemid,
       CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 20 AS item_type,
       CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 5 AS display_category,
       (CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) + event_id % 2) % 5 AS cityid,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 10 END AS placeid,
       CASE event_type WHEN 'click' THEN 'hotel_details_page' WHEN 'purchase' THEN 'booking' WHEN 'view' THEN 'hotel_impression' END AS event,
       CASE WHEN event_type = 'purchase' THEN event_id END AS bookingid,
       value AS fprice,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 83) / 10e0 END AS distance,
       1e0 + (event_id % 41) / 10e0 AS rating
  FROM {events}""",
    "item_embedding": """
SELECT vec_id AS itemid, embedding FROM {embeddings}""",
}


def _spark_tables(sf_dir: str) -> dict[str, str]:
    return {t: f"parquet.`{sf_dir.rstrip('/')}/{t}.parquet`" for t in TABLES}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view as a DataFrame, read straight from the parquet tables."""
    return spark.sql(VIEWS[name].format(**_spark_tables(sf_dir)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def duck_view(name: str) -> str:
    """The view text for DuckDB (tables pre-registered under their names)."""
    return VIEWS[name].format(**{t: t for t in TABLES})


def duck_with(names, body: str) -> str:
    """`WITH v1 AS (...), v2 AS (...) body` for the oracle side."""
    ctes = ",\n".join(f"{n} AS ({duck_view(n)}\n)" for n in names)
    sep = "" if body.lstrip().startswith(",") else "\n"
    return f"WITH {ctes}{sep}{body}"
