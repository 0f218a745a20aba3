"""Rolling, linearly decayed daily rates with a lower confidence bound.

For a key (item, item+place, user+category ...) and its daily counts, the rate
of day j is a weighted mean of the daily rates of the last ``days`` observed
dates, today weighted ``days``, yesterday ``days - 1`` ... ; the output is that
mean minus ``z`` weighted standard deviations (zero days left out of the
spread, the weight total counting every day of the frame).

Design: one pre-aggregated row per (key, day) (partial + final aggregate, so a
hot key costs nothing extra), observed dates numbered 0..n-1 from the tiny
distinct-date table, then ONE range window per key over that index. The frame
holds at most ``days`` rows, so the list behind it is bounded, and a key's
window partition holds at most one row per observed date. No dense
key x date grid and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratios import safe_ratio
from ..session import materialize

RATES = ("ctr", "br", "dtob")


def daily_counts(df: DataFrame, keys: list[str], day: str = "searchdate",
                 clicked: Column | None = None, booked: Column | None = None,
                 shown: str = "fprice") -> DataFrame:
    """(day, *keys) -> booking_count, details_count, impression_count.

    ``clicked`` / ``booked`` default to the event column being a details page /
    a booking; impressions count the non-null ``shown`` values.
    """
    clicked = F.col("event") == "hotel_details_page" if clicked is None else clicked
    booked = F.col("event") == "booking" if booked is None else booked
    return (df.groupBy(day, *keys)
              .agg(F.sum(F.when(booked, 1).otherwise(0)).cast("bigint").alias("booking_count"),
                   F.sum(F.when(clicked, 1).otherwise(0)).cast("bigint").alias("details_count"),
                   F.count(shown).alias("impression_count")))


def daily_rates(counts: DataFrame, keys: list[str], day: str = "searchdate") -> DataFrame:
    """Raw daily ctr / br / dtob; an undefined ratio (0/0) counts as rate 0."""
    return counts.select(
        day, *keys,
        F.coalesce(safe_ratio("details_count", "impression_count"), F.lit(0.0)).alias("raw_ctr"),
        F.coalesce(safe_ratio("booking_count", "impression_count"), F.lit(0.0)).alias("raw_br"),
        F.coalesce(safe_ratio("booking_count", "details_count"), F.lit(0.0)).alias("raw_dtob"))


def date_index(df: DataFrame, day: str = "searchdate", name: str = "_di") -> DataFrame:
    """Observed dates numbered 0..n-1 in order.

    The input is the distinct-date table, one row per calendar day present in
    the data, so it is bounded by the length of the date range (days, not
    rows); numbering it in one partition and broadcasting it is safe.
    """
    dates = df.select(day).where(F.col(day).isNotNull()).distinct()
    return dates.select(day, (F.dense_rank().over(Window.orderBy(day)) - 1).alias(name))


def weight_total(j: Column, days: int, lag_days: int = 0) -> Column:
    """Sum of the weights days, days-1, ... over the frame that ends at j - lag.

    Every observed date in the frame counts, also those with no row for the key.
    """
    m = F.least(j - lag_days, F.lit(days - 1)) + 1
    m = F.when(m > 0, m)
    return (m * days - m * (m - 1) / 2).cast("double")


def rolling_lower_bound(df: DataFrame, keys: list[str], order: str, values: list[str],
                        days: int = 7, z: float = 1.282, lag_days: int = 0,
                        suffix: str = "_lb") -> DataFrame:
    """Window part of the operator on a sparse (key, date index, values) table.

    ``order`` is the observed-date index. Adds ``<value><suffix>`` per value.
    """
    w = (Window.partitionBy(*keys).orderBy(order)
         .rangeBetween(-(days - 1) - lag_days, -lag_days))
    pts = F.collect_list(F.struct(F.col(order).alias("i"), *[F.col(v).alias(v) for v in values])).over(w)
    out = df.withColumn("_pts", pts).withColumn("_S", weight_total(F.col(order), days, lag_days))
    j_end = F.col(order) - lag_days

    def weight(x):
        return (F.lit(days) - (j_end - x["i"])).cast("double")

    def mean_step(v):
        return lambda acc, x: acc + weight(x) * x[v]

    def spread_step(v, m):
        return lambda acc, x: acc + weight(x) * F.when(x[v] != 0, (x[v] - m) * (x[v] - m)).otherwise(0.0)

    out = out.withColumns({f"_m_{v}": F.aggregate("_pts", F.lit(0.0), mean_step(v)) / F.col("_S")
                           for v in values})
    res = {}
    for v in values:
        m = F.col(f"_m_{v}")
        spread = F.aggregate("_pts", F.lit(0.0), spread_step(v, m))
        res[f"{v}{suffix}"] = m - F.lit(z) * F.sqrt(spread) / F.col("_S")
    out = out.withColumns(res)
    return out.drop("_pts", "_S", *[f"_m_{v}" for v in values])


def weighted_rates(df: DataFrame, keys: list[str], day: str = "searchdate",
                   clicked: Column | None = None, booked: Column | None = None,
                   shown: str = "fprice", prefix: str = "item", days: int = 7,
                   z: float = 1.282, lag_days: int = 0) -> DataFrame:
    """Rolling weighted lower bound of ctr, br and dtob for one key set.

    Returns one row per (keys, day) where the key was seen that day, with
    ``<prefix>_ctr``, ``<prefix>_br``, ``<prefix>_dtob``. Rows with a null key
    are left out: a null key never matches when the rates are joined back.
    ``lag_days=1`` excludes the current day (no label leak).
    """
    # the daily aggregate feeds both the date numbering and the window: hold it
    # so the events are scanned and aggregated once
    counts = materialize(daily_counts(df, keys, day, clicked, booked, shown), "daily_counts")
    return rates_of_counts(counts, keys, day, prefix, days, z, lag_days)


def roll_up(counts: DataFrame, keys: list[str], day: str = "searchdate") -> DataFrame:
    """Daily counts of fewer keys, summed from those of more keys."""
    return counts.groupBy(day, *keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in (
        "booking_count", "details_count", "impression_count")])


def rates_of_counts(counts: DataFrame, keys: list[str], day: str = "searchdate", prefix: str = "item",
                    days: int = 7, z: float = 1.282, lag_days: int = 0) -> DataFrame:
    """The rates of ``weighted_rates`` from daily counts (read twice, so hold them)."""
    idx = date_index(counts, day)
    rates = daily_rates(counts, keys, day)
    for k in keys:
        rates = rates.where(F.col(k).isNotNull())
    rates = rates.join(F.broadcast(idx), day)
    out = rolling_lower_bound(rates, keys, "_di", ["raw_ctr", "raw_br", "raw_dtob"],
                              days=days, z=z, lag_days=lag_days)
    return out.select(*keys, day,
                      *[F.col(f"raw_{r}_lb").alias(f"{prefix}_{r}") for r in RATES])


def densify(rates: DataFrame, keys: list[str], day: str = "searchdate",
            values: tuple[str, ...] = ("raw_ctr", "raw_br", "raw_dtob")) -> DataFrame:
    """Full key x observed-date grid, absent days filled with 0.

    Kept as a user-facing operator (the dense series some consumers want); the
    rolling rates never need it. Output size is keys x dates by definition.
    """
    dates = rates.select(day).distinct()
    grid = rates.select(*keys).distinct().crossJoin(F.broadcast(dates))
    return grid.join(rates, on=[*keys, day], how="left").fillna(0, subset=list(values))


def series(rates: DataFrame, keys: list[str], day: str = "searchdate",
           value: str = "raw_ctr") -> DataFrame:
    """One sorted (day, value) list per key; bounded by the number of dates."""
    return (rates.groupBy(*keys)
                 .agg(F.array_sort(F.collect_list(F.struct(F.col(day).alias("day"),
                                                           F.col(value).alias("v")))).alias("series")))
