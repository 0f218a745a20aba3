"""Base features of the fact table: one select of guarded ratios, date parts,
flags and pass-through columns, the mean fill, and request-relative ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.flags import fill_existing, flag, target
from ..functions.ratios import guarded_ratio, safe_ratio

PASS_THROUGH = ["userid", "fprice", "placeid", "itemid", "distance", "requestid", "searchdate",
                "inserted_at", "item_type", "platform", "cityid", "dmodel", "rating", "rcount",
                "rank", "user_abp", "iscitysearch", "display_category", "place_popularity_score",
                "searchtime"]

# columns set to 0 when null after the projection (fixed list of the source system,
# restricted to the columns that exist)
ZERO_FILL = ["iscitysearch", "item_user_btod", "item_user_ctr", "item_user_br", "item_ctr",
             "item_btod", "item_br", "avg_item_btod", "avg_item_br", "avg_item_ctr", "user_abp"]


def feature_columns(adv_fixed: bool = False) -> dict:
    """name -> expression of the base feature projection.

    ``advPurchaseWindow`` is search date - check-in clamped at 0, as the source
    system defines it (normally 0); ``adv_fixed=True`` gives check-in - search
    date, the days booked in advance."""
    c = F.col
    return {
        "target": target("realised_flag", "event"),
        "discount_per": F.when(c("slasherprice") == 0, F.lit(0.0))
                         .otherwise(safe_ratio(c("slasherprice") - c("fprice"), c("slasherprice"))),
        "item_br": guarded_ratio("bookingcount", "impressioncount"),
        "item_ctr": guarded_ratio("detailcount", "impressioncount"),
        "item_btod": guarded_ratio("bookingcount", "detailcount"),
        "item_user_br": guarded_ratio("userbookingcount", "userimpressioncount"),
        "item_user_ctr": guarded_ratio("userdetailcount", "userimpressioncount"),
        "item_user_btod": guarded_ratio("userbookingcount", "userdetailcount"),
        "avg_item_br": guarded_ratio("booking_count", "impression_count"),
        "avg_item_ctr": guarded_ratio("details_count", "impression_count"),
        "avg_item_btod": guarded_ratio("booking_count", "details_count"),
        "stayLength": D.clamped_days("checkout", "checkin"),
        "is_weekend_checkin": D.is_weekend("checkin"),
        "day_of_week_checkin": D.day_of_week("checkin"),
        "abp_price_diff": c("fprice") - c("user_abp"),
        "is_weekend_searchDate": D.is_weekend("searchdate"),
        "day_of_week_searchDate": D.day_of_week("searchdate"),
        "advPurchaseWindow": (D.clamped_days("checkin", "searchdate") if adv_fixed
                              else D.clamped_days("searchdate", "checkin")),
        "is_nearBy_search": flag(c("nearbysearch") == 1),
        "is_city_search": flag(c("iscitysearch") == 1),
        "vicinity": flag(c("distance") <= 5),
        "ratingMean": c("rating"),
        "ratingCount": c("rcount"),
    }


def base_features(df: DataFrame, adv_fixed: bool = False) -> DataFrame:
    """The 43-column feature projection (20 pass-through + 23 derived)."""
    feats = feature_columns(adv_fixed)
    return df.select(*[F.col(x) for x in PASS_THROUGH], *[e.alias(n) for n, e in feats.items()])


def fill_with_means(df: DataFrame, source: DataFrame, fills: dict[str, str]) -> DataFrame:
    """Fill nulls of df[target] with the global mean of source[column].

    The means are one aggregate row, joined as a broadcast (one row: bounded),
    instead of collecting them to the driver.
    """
    means = source.agg(*[F.avg(src).alias(f"_mean_{t}") for t, src in fills.items()])
    out = df.crossJoin(F.broadcast(means))
    out = out.withColumns({t: F.coalesce(F.col(t), F.col(f"_mean_{t}")) for t in fills})
    return out.drop(*[f"_mean_{t}" for t in fills])


def clean_features(df: DataFrame, source: DataFrame) -> DataFrame:
    """Zero fill of counters and ratios, mean fill of rating mean / count."""
    df = fill_existing(df, 0, ZERO_FILL)
    return fill_with_means(df, source, {"ratingMean": "rating", "ratingCount": "rcount"})


def request_means(df: DataFrame, cols: list[str], group: str = "requestid") -> DataFrame:
    """Mean of each column per request (partial aggregation before the shuffle)."""
    return df.groupBy(group).agg(*[F.avg(c).alias(f"avg_{c}") for c in cols])


def request_ratios(df: DataFrame, cols=("fprice", "rating", "distance", "discount_per"),
                   group: str = "requestid") -> DataFrame:
    """value / mean of the value over the candidates of the request.

    The means are a grouped aggregate (partial aggregation before the
    shuffle) joined back on the request id: a sort-merge join that AQE splits
    when one request is huge, or a broadcast when the means are small. Feed
    it a materialised table, as the pipeline does, so the second read is a
    file scan.
    """
    m = request_means(df, list(cols), group)
    out = df.join(m, on=group, how="left")
    out = out.withColumns({f"{c}_ratio": safe_ratio(F.col(c), F.col(f"avg_{c}")) for c in cols})
    return out.drop(*[f"avg_{c}" for c in cols])
