"""Log assembly: one row per (request, candidate item, event) plus counters.

All joins are equi-joins written without hints: AQE turns a join into a
broadcast at run time only when the measured side is below
``spark.sql.adaptive.autoBroadcastJoinThreshold`` (the size check), and keeps
the sort-merge join, with skew splitting, otherwise. The joined table moves
twice behind the candidates: once to (request, item), where events, search
attributes and user counters meet it, and once to the item of the totals.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written_stage
from ..sources import logs

EVENT_KINDS = ("hotel_details_page", "booking", "hotel_impression")


def event_counts(events: DataFrame, kinds=EVENT_KINDS, start: str | None = None,
                 end: str | None = None) -> DataFrame:
    """count(event) per (item, event) over the known kinds in [start, end), placeholders dropped."""
    events = logs.in_window(events, "inserted_at", start, end)
    df = logs.drop_sentinel(events.where(F.col("event").isin(list(kinds))), ["requestid"])
    return df.groupBy("itemid", "event").agg(F.count("event").alias("eventCount"))


def item_event_totals(counts: DataFrame) -> DataFrame:
    """Pivot (item, event, count) to details / booking / impression columns.

    The pivot values are given, so no extra job runs to find them; an event
    kind absent for an item stays null.
    """
    p = counts.groupBy("itemid").pivot("event", list(EVENT_KINDS)).sum("eventCount")
    return p.select("itemid",
                    F.col("hotel_details_page").alias("details_count"),
                    F.col("booking").alias("booking_count"),
                    F.col("hotel_impression").alias("impression_count"))


def with_realised_flag(df: DataFrame, realised: DataFrame) -> DataFrame:
    """Left join of the realised bookings as a literal 1 flag."""
    flag = realised.select("bookingid", F.lit(1).alias("realised_flag")).distinct()
    return df.join(flag, on="bookingid", how="left")


def realised_flags(flags: DataFrame, realised: DataFrame) -> DataFrame:
    """The realised flag on the event rows. Rows without a booking cannot match,
    so they stay out of the join: a null key never gathers them in one task."""
    booked = with_realised_flag(flags.where(F.col("bookingid").isNotNull()), realised)
    other = flags.where(F.col("bookingid").isNull()).withColumn("realised_flag", F.lit(None).cast("int"))
    return booked.unionByName(other)


def assemble_impressions(requests: DataFrame, clicked: DataFrame, responses: DataFrame,
                         flags: DataFrame, search: DataFrame, realised: DataFrame,
                         item_totals: DataFrame, user_counts: DataFrame, staged: bool = False) -> DataFrame:
    """The fact table: clicked requests x shown candidates, with their events,
    search-time attributes, realised flag, item totals and user counters.
    Rows without both prices are dropped.

    ``staged`` writes the table where it is about to move anyway, so that the shuffle files of its sources end there;
    for a call inside a ``written_stage``, which deletes what is written on the way."""
    cut = partial(written_stage, requests.sparkSession) if staged else (lambda name, build: build())
    candidate = ["requestid", "itemid"]

    def candidates() -> DataFrame:
        df = requests.join(clicked, on="requestid", how="inner")                    # J1
        return df.join(responses, on="requestid", how="inner")                      # J2

    def priced() -> DataFrame:
        df = cut("candidates", candidates)
        df = df.join(realised_flags(flags, realised), on=candidate, how="left")     # J5 on the events, J3
        df = df.join(search, on=candidate, how="left")                              # J4
        df = df.join(user_counts, on=candidate, how="left")                         # J7
        return df.where(F.col("fprice").isNotNull() & F.col("slasherprice").isNotNull())

    return cut("priced", priced).join(item_totals, on="itemid", how="left")         # J6


def dedup_key(df: DataFrame, keys: list[str], order: list[str] | None = None,
              descending: bool = False) -> DataFrame:
    """One row per key; the survivor has the smallest (or largest) ``order``.

    Written as an aggregate (min_by / max_by on a struct of the remaining
    columns) instead of a row_number window: duplicates collapse in the
    map-side partial aggregate, so a key holding a large share of the rows
    never lands whole in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    order = order or rest
    if set(rest) <= set(order):     # the order holds the whole row already: one copy of it
        pick = (F.max if descending else F.min)(F.struct(*[F.col(c) for c in order]))
        return df.groupBy(*keys).agg(pick.alias("_keep")).select(*keys, *[F.col(f"_keep.{c}").alias(c) for c in rest])
    ordkey = F.struct(*[F.col(c) for c in order])
    pick = (F.max_by if descending else F.min_by)(F.struct(*[F.col(c) for c in rest]), ordkey)
    return df.groupBy(*keys).agg(pick.alias("_keep")).select(*keys, *[F.col(f"_keep.{c}").alias(c) for c in rest])


def dedup_first_by_order(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Keep the first row per key by an explicit input-order column."""
    return dedup_key(df, keys, [order_col])


def keep_requests_with_event(df: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Semi join: only requests where some row has a non-null event."""
    src = df if events is None else events
    return df.join(src.where(F.col("event").isNotNull()).select("requestid"), "requestid", "left_semi")


def replace_place(df: DataFrame, request_place: DataFrame) -> DataFrame:
    """Swap the logged place for the request -> place table (one row per request)."""
    return df.drop("placeid").join(request_place, on="requestid", how="left")


def place_popularity(places: DataFrame) -> DataFrame:
    """One row per place with ``place_popularity_score``."""
    from ..functions.flags import place_score
    p = dedup_key(places.select("placeid", "conversion", "popularity"), ["placeid"])
    return p.withColumn("place_popularity_score", place_score("conversion", "popularity"))
