"""The end-to-end feature plan: raw fact table -> training table.

``training_table`` runs jobs while it is built: it writes the pulled table and
the feature stage into the cluster's checkpoint folder (``cut_lineage``), which
is how a long lineage survives lost executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import epoch_ms_to_date
from ..functions.flags import fallback
from ..operators import assemble as A
from ..operators import features as FE
from ..operators import geo as G
from ..operators import history as H
from ..operators import rates as R
from ..session import hold, written_stage
from ..sources import logs as L

HISTORY_FIELDS = ("itemid", "item_type", "fprice", "distance", "rating")
# total order of clicks inside a user's stream: search time, then stable ids
CLICK_ORDER = ("searchtime", "requestid", "itemid", "event", "bookingid", "fprice", "distance", "rating",
               "item_type")
RATE_KEYS = {"item": ["itemid"], "item_place": ["itemid", "placeid"], "user_cat": ["userid", "display_category"]}
# preference of the surviving row per (item, request): the most informative target
def target_order():
    return (F.when(F.col("target") == "realised", 0).when(F.col("target") == "booking", 1)
             .when(F.col("target") == "hotel_details_page", 2).otherwise(3))


def clean_log(raw: DataFrame, start=None, dedup: bool = True) -> DataFrame:
    """Rows from ``start`` on, known request and user, nearby searches dropped."""
    df = L.in_window(raw, "inserted_at", start)
    if dedup:
        df = df.distinct()
    df = df.dropna(subset=["requestid", "userid"]).where(F.col("nearbysearch") != 1)
    df = L.known_users(df)
    return df.withColumn("searchdate", epoch_ms_to_date("searchtime"))


def prepare(raw: DataFrame, request_place: DataFrame, places: DataFrame, start=None,
            dedup: bool = True) -> DataFrame:
    """Clean log + searched place from the request -> place table + place score."""
    df = clean_log(raw, start, dedup)
    df = A.replace_place(df, L.read_request_place(request_place))
    pop = A.place_popularity(places).select("placeid", "place_popularity_score")
    # requests without a place would all meet on one null key: they carry a key of their own that no place has
    key = F.coalesce(F.col("placeid").cast("string"), F.concat(F.lit("none "), F.col("requestid").cast("string")))
    pop = pop.select(F.col("placeid").cast("string").alias("_place"), "place_popularity_score")
    return df.withColumn("_key", key).join(pop, F.col("_key") == F.col("_place"), "left").drop("_key", "_place")


def with_rates(df: DataFrame, all_data: DataFrame, lag_days: int = 0) -> DataFrame:
    """Join the three rolling-rate tables and apply the city-search fallback."""
    df = df.drop("item_ctr", "item_br", "item_dtob")
    counts = {p: hold(R.daily_counts(all_data, RATE_KEYS[p])) for p in ("item_place", "user_cat")}
    counts["item"] = R.roll_up(counts["item_place"], RATE_KEYS["item"])
    for prefix, keys in RATE_KEYS.items():
        r = R.rates_of_counts(counts[prefix], keys, prefix=prefix, lag_days=lag_days)
        df = df.join(r, on=[*keys, "searchdate"], how="left")
    city_no_place = (F.col("iscitysearch") == 1) & F.col("placeid").isNull()
    df = df.withColumns({f"item_place_{r}": fallback(city_no_place, f"item_{r}", f"item_place_{r}")
                         for r in R.RATES})
    return df.withColumn("is_locality_search",
                         F.when((F.col("iscitysearch") == 0) & (F.col("is_nearBy_search") == 0), 1).otherwise(0))


def base_table(prepared: DataFrame, lag_days: int = 0, adv_fixed: bool = False, item_city: DataFrame | None = None) -> DataFrame:
    """Base features, fills, clicked requests only, rolling rates.

    With ``item_city`` only the candidates of the searched city go through the joins that follow. Means, clicked
    requests and rates come from ``prepared``, so they don't depend on it.
    """
    df = FE.base_features(prepared, adv_fixed)
    if item_city is not None:
        df = G.same_city(df, item_city)
    df = FE.clean_features(df, prepared)
    df = A.keep_requests_with_event(df, prepared)
    return with_rates(df, prepared, lag_days)


def geo_table(df: DataFrame, items: DataFrame, places: DataFrame, radius_km: float = 5.0) -> DataFrame:
    """Distance backfill for city searches; same-city candidates only (unless ``base_table`` has kept them already,
    which adds ``cityid_item``). An item listed at several points takes its first by latitude, then longitude."""
    points = A.dedup_key(items.select("itemid", "lat", "lng"), ["itemid"])
    df = G.backfill_distance(df, G.place_distance(points, places, radius_km))
    if "cityid_item" in df.columns:
        return df.select(*[c for c in df.columns if c != "cityid_item"], "cityid_item")
    return G.same_city(df, L.read_item_city(items))


def request_histories(raw: DataFrame, frame: int = 20, n: int = 10, dedup: bool = True) -> DataFrame:
    """History per request from the whole pull (no start date)."""
    src = clean_log(raw, None, dedup)
    src = H.keep_single_booking(src)
    # the clicks are written and move three times: with what the lists need only
    clicks = src.where(F.col("event").isNotNull()).select("userid", *CLICK_ORDER)
    h = H.click_history(clicks, "userid", CLICK_ORDER, "requestid", HISTORY_FIELDS, frame, n)
    return H.history_per_request(h, "requestid", CLICK_ORDER)


def with_history(df: DataFrame, hist: DataFrame) -> DataFrame:
    """One row per (item, request), inner join of the request histories, list
    shares / means / spreads, positional history columns."""
    # survivor per (item, request): most informative target, then the other
    # columns in name order (a total, documented order); the history is the
    # request's, so it joins the survivors only
    rest = sorted(c for c in df.columns if c not in ("itemid", "requestid"))
    df = A.dedup_key(df.withColumn("_t", target_order()), ["itemid", "requestid"], ["_t", *rest]).drop("_t")
    hist = H.list_spreads(H.history_columns(hist, "history", HISTORY_FIELDS))
    return H.list_shares(df.join(hist, on="requestid", how="inner"))


def training_table(raw: DataFrame | Callable[[], DataFrame], request_place: DataFrame, places: DataFrame, items: DataFrame,
                   start=None, radius_km: float = 5.0, buckets: int = 10, same_city: bool = True,
                   cut_lineage: bool = True, lag_days: int = 0, adv_fixed: bool = False,
                   dedup: bool = True) -> DataFrame:
    """Everything up to the model input: features, geo, history, ratios,
    distance buckets and the known-id filter of the history columns.

    ``raw`` is a table, or a function that makes it; what the function writes on
    the way is deleted when the pull is written. With ``cut_lineage`` the pull is
    written once, cleaned and with its places: the projection, the mean fill, the
    semi join, two daily counts and the history (which uses the whole pull) read
    it from there. The feature stage is written next and the pull deleted, so the
    disk holds one stage at a time. Without ``cut_lineage`` the prepared table is
    persisted (memory, spilling to disk) until the caller leaves a ``releasing``
    block. ``lag_days=1`` keeps the current day out of the rolling
    rates; ``adv_fixed`` counts the booking window as check-in minus search
    date; ``dedup=False`` says that ``raw`` has no repeated rows.
    """
    def pull() -> DataFrame:
        df = raw() if callable(raw) else raw
        return df.distinct() if dedup else df

    if not cut_lineage:
        whole = pull()
        prepared = hold(prepare(whole, request_place, places, start, dedup=False))
        return _model_features(_feature_stage(prepared, whole, items, places, radius_km, lag_days, adv_fixed), buckets, same_city)
    spark = items.sparkSession

    def features() -> DataFrame:
        df = written_stage(spark, "raw_pull", lambda: prepare(pull(), request_place, places, dedup=False))
        return _feature_stage(L.in_window(df, "inserted_at", start), df, items, places, radius_km, lag_days, adv_fixed)

    # the request means, the quantile splits and the known-id vocabulary are
    # further passes over this table: read it from files instead of
    # re-running the plan for each
    return _model_features(written_stage(spark, "features_stage", features), buckets, same_city)


def _feature_stage(prepared, raw, items, places, radius_km, lag_days, adv_fixed) -> DataFrame:
    """Base features, rates, geo and history of a prepared pull without repeated rows."""
    # the city filter comes first: all that is joined by (request, item) afterwards moves the kept candidates only
    df = geo_table(base_table(prepared, lag_days, adv_fixed, L.read_item_city(items)), items, places, radius_km)
    return with_history(df, request_histories(raw, dedup=False))


def _model_features(df: DataFrame, buckets: int, same_city: bool) -> DataFrame:
    """Request ratios, distance buckets and the known-id filter of the history columns."""
    from ..operators import encode as E
    df = FE.request_ratios(df)
    df = E.quantile_buckets(df, "distance", "distance_buckets", buckets)
    vocab_by = "cityid" if same_city else None
    # a request's list is one and the same in all its rows; the city it is filtered by is the row's own
    req = df.select("requestid", "cityid", "clicked_itemid_list_10", "clicked_item_type_list_10").dropDuplicates(
        ["requestid", "cityid"])
    known = H.keep_known(req, "clicked_itemid_list_10", df.select("itemid", "cityid"), "itemid", vocab_by)
    known = H.keep_known(known, "clicked_item_type_list_10", df.select("item_type", "cityid"), "item_type", vocab_by)
    known = known.select(F.col("requestid").alias("_rq"), F.col("cityid").alias("_by"), "clicked_itemid_list_10_known",
                         "clicked_item_type_list_10_known")
    df = df.join(known, (F.col("requestid") == F.col("_rq")) & F.col("cityid").eqNullSafe(F.col("_by")),
                 "left").drop("_rq", "_by")
    df = H.positional_columns(df, "clicked_itemid_list_10_known", "clicked_itemid")
    df = H.positional_columns(df, "clicked_item_type_list_10_known", "clicked_item_type")
    df = df.fillna(0, subset=[f"clicked_itemid_{i}" for i in range(1, 11)]
                   + [f"clicked_item_type_{i}" for i in range(1, 11)])
    return df.drop("clicked_itemid_list_10", "clicked_item_type_list_10",
                   "clicked_itemid_list_10_known", "clicked_item_type_list_10_known")
