"""Scans of the raw logs (filters and projections that reach the parquet scan).

Each reader takes the raw log as a DataFrame (a table, a parquet folder or a
fixture view) so the caller decides where it lives; predicates are plain
column comparisons against literals of the column's own type, so Catalyst
pushes them into the scan (``PushedFilters``) and prunes the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTINEL = "-"


def _is_string(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.StringType)


def in_window(df: DataFrame, col: str, start=None, end=None) -> DataFrame:
    """Half-open range ``start <= col < end``; either bound may be None."""
    if start is not None:
        df = df.where(F.col(col) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(col) < F.lit(end))
    return df


def drop_sentinel(df: DataFrame, cols: list[str], sentinel: str = SENTINEL) -> DataFrame:
    """Drop the '-' placeholder from string id columns (null ids drop too).

    Only string columns carry the placeholder; comparing a numeric id with
    '-' would be a cast error under ANSI, so those are left alone.
    """
    for c in cols:
        if _is_string(df, c):
            df = df.where(F.col(c) != sentinel)
    return df


def known_users(df: DataFrame, col: str = "userid") -> DataFrame:
    """Users that can carry a history: not null, not '' and not ' '."""
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin("", " "))


def distinct_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows, clustered by ``keys``: the rows are shuffled once, and a
    later join on these keys finds them in place and sorted. Equal rows meet in a
    sort, which spills; a distinct would hold a partition's rows in two hash maps,
    one before and one after the exchange that is already there."""
    row = [*keys, *[c for c in df.columns if c not in keys]]
    first = F.row_number().over(Window.partitionBy(*row).orderBy(keys[0]))
    return df.repartition(*keys).withColumn("_nth", first).where(F.col("_nth") == 1).drop("_nth")


def read_requests(raw: DataFrame, start: str | None = None, end: str | None = None,
                  countries: list | None = None, extra: tuple = ()) -> DataFrame:
    """Search requests in [start, end) of ``inserted_at`` for the given countries.

    ``extra`` names further columns to carry; like every column of a reader,
    they take part in the distinct.
    """
    df = in_window(raw, "inserted_at", start, end).select(
        "requestid", "userid", "checkin", "checkout", "platform", "placeid",
        "cityid", "countryid", "nearbysearch", "inserted_at", *extra)
    if countries is not None:
        df = df.where(F.col("countryid").isin(list(countries)))
    return distinct_by(df.dropna(subset=["requestid", "userid"]), ["requestid"])


def read_responses(raw: DataFrame, sort_mode: str = "popularity", start: str | None = None,
                   end: str | None = None, extra: tuple = ()) -> DataFrame:
    """Candidates logged in [start, end) of requests ranked by the algorithm (``sortby`` = popularity)."""
    df = in_window(raw, "inserted_at", start, end).where(F.col("sortby") == sort_mode).select(
        "requestid", "itemid", "slasherprice", F.col("item_rank").alias("rank"),
        "item_type", "user_abp", *extra)
    return distinct_by(df.dropna(subset=["requestid", "itemid"]), ["requestid"])


def read_clicked(events: DataFrame, event: str = "hotel_details_page", start: str | None = None,
                 end: str | None = None) -> DataFrame:
    """Requests with at least one details-page event in [start, end), one device model each.

    The survivor among several models is the smallest name (deterministic);
    a plain aggregate, so duplicates collapse map-side before the shuffle.
    """
    return (in_window(events, "inserted_at", start, end).where(F.col("event") == event)
            .groupBy("requestid").agg(F.min("dmodel").alias("dmodel")))


def read_event_flags(events: DataFrame, kinds=("booking", "hotel_details_page"), start: str | None = None,
                     end: str | None = None) -> DataFrame:
    """Distinct (item, request, booking, event) for clicks and bookings in [start, end)."""
    df = in_window(events, "inserted_at", start, end).where(F.col("event").isin(list(kinds)))
    df = drop_sentinel(df, ["requestid"])
    return distinct_by(df.select("itemid", "requestid", "bookingid", "event"), ["requestid", "itemid"])


def read_search_response(raw: DataFrame, start: str | None = None, end: str | None = None,
                         extra: tuple = ()) -> DataFrame:
    """Price, rating, distance, city-search flag and search time per candidate shown in [start, end)."""
    df = in_window(raw, "inserted_at", start, end).select(
        "requestid", "itemid", "distance", "fprice", "rating",
        F.when(F.col("distance").isNull(), 1).otherwise(0).alias("iscitysearch"),
        F.col("rcount").cast("double").alias("rcount"),
        "searchtime", "display_category", *extra)
    return distinct_by(df, ["requestid", "itemid"])


def read_realised(bookings: DataFrame, start_date: str | None = None,
                  end_date: str | None = None, statuses=(1, 2)) -> DataFrame:
    """Realised bookings: status in (1, 2), created in [start_date, end_date)."""
    df = bookings.where(F.col("status").isin(list(statuses)))
    if start_date is not None:
        # to_date(created_at) >= d  <=>  created_at >= d 00:00, written on the bare
        # column so the predicate reaches the scan
        df = df.where(F.col("created_at") >= F.to_timestamp_ntz(F.lit(start_date)))
    if end_date is not None:
        df = df.where(F.col("created_at") < F.to_timestamp_ntz(F.lit(end_date)))
    return df.select("bookingid")


def read_user_counts(raw: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """User x item counters logged in [start, end); placeholder ids dropped."""
    df = drop_sentinel(in_window(raw, "inserted_at", start, end), ["itemid", "requestid"])
    return distinct_by(df.select("requestid", "itemid", "impressioncount", "detailcount", "bookingcount",
                                 "userimpressioncount", "userdetailcount", "userbookingcount"),
                       ["requestid", "itemid"])


def read_item_city(items: DataFrame) -> DataFrame:
    """Item -> city it is listed in."""
    return items.select("itemid", F.col("cityid").alias("cityid_item")).distinct()


def read_request_place(raw: DataFrame) -> DataFrame:
    """Request -> searched place, one row per request (smallest place id)."""
    return raw.groupBy("requestid").agg(F.min("placeid").alias("placeid"))


def refresh(spark: SparkSession, tables: list[str]) -> None:
    """Invalidate cached metadata of catalogued tables before a pull."""
    for t in tables:
        spark.catalog.refreshTable(t)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             header: bool = True) -> DataFrame:
    """CSV with an explicit schema (no inference pass over the data).

    Without a schema every column is read as a string, as a header-only read
    would; a header-less file needs the schema for its names.
    """
    r = spark.read.option("header", str(header).lower())
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)
