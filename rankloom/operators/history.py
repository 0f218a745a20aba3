"""Per-user click histories: the last ``frame`` clicks before each click, the
clicks of the same request removed, the last ``n`` kept.

Scale design. A plain ``Window.partitionBy(user)`` would put a heavy user (a
bot, a shared device id) whole into one task. Here the clicks are cut into
ranges of (user, order), of about the same size however the clicks are spread:

1. inside a (range, user), the ordinary bounded frame ``rowsBetween(-frame, -1)``;
2. its last ``frame`` clicks are its tail (same window, so the same sort);
3. the ``frame`` clicks before it: a window over the small table of tails (one
   row per range and user) that concatenates those of the previous ``frame``
   ranges of the user, then keeps the last ``frame``;
4. history = last ``frame`` of (carry ++ list inside the range).

Every list is bounded by ``frame`` (the carry by frame x frame before the
slice). The result equals the single per-user window exactly, because every
range a user appears in adds at least one click. The ranged clicks are written,
so tails and lists see the same ranges after a lost executor too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lists import list_mean, list_share, list_std
from ..session import materialize
from .assemble import dedup_key


def _last(arr: Column, n: int) -> Column:
    return F.slice(arr, F.greatest(F.size(arr) - n + 1, F.lit(1)), n)


def preceding_lists(df: DataFrame, user: str, order: list[str], payload: list[str],
                    frame: int = 20, partitions: int | None = None) -> DataFrame:
    """Adds ``_prev``: array of struct(payload) of the ``frame`` rows before each
    row of the same user, oldest first, ordered by ``order`` (a total order)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    item = F.struct(*[F.col(c) for c in payload])
    df = materialize(df.repartitionByRange(n, user, *order).withColumn("_bk", F.spark_partition_id()), "click_ranges")
    w = Window.partitionBy("_bk", user).orderBy(*order)
    df = (df.withColumn("_local", F.collect_list(item).over(w.rowsBetween(-frame, -1)))
            .withColumn("_end", F.lead(F.lit(1)).over(w).isNull()))
    tails = df.where("_end").select(user, "_bk", _last(F.concat("_local", F.array(item)), frame).alias("_tail"))
    wb = Window.partitionBy(user).orderBy("_bk").rowsBetween(-frame, -1)
    carry = tails.select(F.col(user).alias("_user"), F.col("_bk").alias("_range"),
                         _last(F.flatten(F.collect_list("_tail").over(wb)), frame).alias("_carry"))
    # only what starts in an earlier range has a carry
    carry = carry.where(F.size("_carry") > 0)
    same = (F.col("_bk") == F.col("_range")) & F.col(user).eqNullSafe(F.col("_user"))
    out = df.drop("_end").join(carry, same, "left").drop("_user", "_range")
    full = F.concat(F.coalesce(F.col("_carry"), F.array().cast(out.schema["_local"].dataType)), F.col("_local"))
    return out.withColumn("_prev", _last(full, frame)).drop("_local", "_carry", "_bk")


def click_history(clicks: DataFrame, user: str = "userid", order: tuple = ("ts", "event_id"),
                  request: str = "requestid", fields: tuple = ("itemid", "item_type", "fprice",
                                                                "distance", "rating"),
                  frame: int = 20, n: int = 10) -> DataFrame:
    """Per click: ``history`` = array<struct(fields)> of the last ``n`` earlier
    clicks of the user that belong to another request (taken from the
    ``frame`` clicks before it)."""
    payload = [request, *fields]
    df = preceding_lists(clicks, user, list(order), payload, frame)
    other = F.filter("_prev", lambda x: ~x[request].eqNullSafe(F.col(request)))
    kept = F.transform(_last(other, n), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return df.withColumn("history", kept).drop("_prev")


def history_per_request(hist: DataFrame, request: str = "requestid", order: tuple = ("ts", "event_id")) -> DataFrame:
    """One history per request: the one seen at the request's first click."""
    h = hist.select(request, *order, "history")
    return dedup_key(h, [request], list(order)).select(request, "history")


def history_columns(df: DataFrame, hist: str = "history", fields: tuple = ("itemid", "item_type", "fprice",
                                                                            "distance", "rating"),
                    prefix: str = "clicked_", suffix: str = "_list_10") -> DataFrame:
    """Unzip the struct list into one array per field (nulls keep their slot)."""
    return df.withColumns({f"{prefix}{f}{suffix}": F.col(hist)[f] for f in fields}).drop(hist)


def positional_columns(df: DataFrame, arr: str, name: str, n: int = 10) -> DataFrame:
    """arr[0..n-1] as name_1..name_n; null past the end (no ANSI error)."""
    return df.withColumns({f"{name}_{i + 1}": F.get(F.col(arr), i) for i in range(n)})


def list_spreads(df: DataFrame) -> DataFrame:
    """Mean and spread of the history's price, distance and rating. They depend on
    the request alone, so a table of one row per request can carry them."""
    cols = {}
    for f in ("fprice", "distance", "rating"):
        cols[f"clicked_{f}_list_10_std"] = list_std(f"clicked_{f}_list_10")
        cols[f"_mean_{f}"] = list_mean(f"clicked_{f}_list_10")
    df = df.withColumns(cols)
    # the mean takes the list's name (the list itself is not kept)
    for f in ("fprice", "distance", "rating"):
        df = df.drop(f"clicked_{f}_list_10").withColumnRenamed(f"_mean_{f}", f"clicked_{f}_list_10")
    return df


def list_shares(df: DataFrame, item: str = "itemid", item_type: str = "item_type") -> DataFrame:
    """History shares of the candidate's id and type."""
    return df.withColumns({"item_clicked_rate": list_share("clicked_itemid_list_10", item),
                           "cat_clicked_rate": list_share("clicked_item_type_list_10", item_type)})


def list_features(df: DataFrame, item: str = "itemid", item_type: str = "item_type") -> DataFrame:
    """``list_shares`` and ``list_spreads`` of rows that carry the whole lists."""
    return list_spreads(list_shares(df, item, item_type))


def single_booking_requests(df: DataFrame, request: str = "requestid", booking: str = "bookingid") -> DataFrame:
    """Requests with fewer than two distinct bookings."""
    return (df.groupBy(request).agg(F.countDistinct(booking).alias("booking_flag_count"))
              .where(F.col("booking_flag_count") < 2))


def keep_single_booking(df: DataFrame, request: str = "requestid", booking: str = "bookingid") -> DataFrame:
    return df.join(single_booking_requests(df, request, booking).select(request), request, "left_semi")


def keep_known(df: DataFrame, arr: str, vocab: DataFrame, value: str, by: str | None = None,
               request: str = "requestid", pad=0) -> DataFrame:
    """Replace history ids that are absent from ``vocab`` (same ``by`` value,
    e.g. the same city, when given) with the padding value.

    Run at the grain of ``df`` rows keyed by ``request``: the list is exploded
    (at most n rows per request), left-joined to the vocabulary on (value, by)
    - AQE broadcasts the vocabulary only when its measured size allows - and
    rebuilt in position order. No per-element join chain.
    """
    keys = [value] + ([by] if by else [])
    v = vocab.select(*keys).distinct().withColumn("_known", F.lit(True))
    ex = df.select(request, *([by] if by else []), F.posexplode_outer(arr).alias("_pos", value))
    ex = ex.join(v, on=keys, how="left")
    kept = F.when(F.col("_known"), F.col(value)).otherwise(F.lit(pad).cast(df.schema[arr].dataType.elementType))
    rebuilt = (ex.where(F.col("_pos").isNotNull())
                 .groupBy(F.col(request).alias("_rq"), *([F.col(by).alias("_by")] if by else []))
                 .agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", kept.alias("v")))),
                                  lambda x: x["v"]).alias(f"{arr}_known")))
    same = F.col(request) == F.col("_rq")
    if by:  # a request seen under several ``by`` values keeps a list for each
        same = same & F.col(by).eqNullSafe(F.col("_by"))
    out = df.join(rebuilt, same, "left").drop("_rq", "_by")
    empty = F.array().cast(df.schema[arr].dataType)
    return out.withColumn(f"{arr}_known", F.when(F.col(arr).isNotNull(),
                                                 F.coalesce(F.col(f"{arr}_known"), empty)))
