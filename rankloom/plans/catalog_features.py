"""Checked queries: scalar functions, flags, fills, base features, filters, dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import duck_with, view
from ..functions import dates as D
from ..functions.flags import fill_existing, flag, target
from ..functions.geo import haversine_km
from ..functions.ratios import guarded_ratio, safe_ratio
from ..operators import assemble as A
from ..operators import features as FE
from ..sources import logs as L
from . import catalog_assembly as CA
from .registry import finish, register

RATIO_PAIRS = [("item_br", "bookingcount", "impressioncount"), ("item_ctr", "detailcount", "impressioncount"),
               ("item_btod", "bookingcount", "detailcount"), ("item_user_br", "userbookingcount", "userimpressioncount"),
               ("item_user_ctr", "userdetailcount", "userimpressioncount"),
               ("item_user_btod", "userbookingcount", "userdetailcount")]


@register("fn_guarded_ratio", duck_with(["user_item_counts"], "SELECT requestid, itemid, " + ", ".join(
    f"CASE WHEN {d} = 0 THEN 0 ELSE {n} / {d} END AS {a}" for a, n, d in RATIO_PAIRS) + " FROM user_item_counts"))
def q_guarded_ratio(spark, sf):
    df = view(spark, sf, "user_item_counts")
    return finish(df.select("requestid", "itemid", *[guarded_ratio(n, d).alias(a) for a, n, d in RATIO_PAIRS]))


@register("fn_ratio", duck_with(["timed_event"], """SELECT searchdate, itemid,
       CASE WHEN impression_count = 0 THEN NULL ELSE details_count / impression_count END AS raw_ctr,
       CASE WHEN impression_count = 0 THEN NULL ELSE booking_count / impression_count END AS raw_br,
       CASE WHEN details_count = 0 THEN NULL ELSE booking_count / details_count END AS raw_dtob
  FROM (SELECT searchdate, itemid, SUM(CASE WHEN event = 'booking' THEN 1 ELSE 0 END) AS booking_count,
               SUM(CASE WHEN event = 'hotel_details_page' THEN 1 ELSE 0 END) AS details_count,
               COUNT(fprice) AS impression_count FROM timed_event GROUP BY searchdate, itemid)"""))
def q_ratio(spark, sf):
    from ..operators.rates import daily_counts
    c = daily_counts(view(spark, sf, "timed_event"), ["itemid"])
    return finish(c.select("searchdate", "itemid", safe_ratio("details_count", "impression_count").alias("raw_ctr"),
                           safe_ratio("booking_count", "impression_count").alias("raw_br"),
                           safe_ratio("booking_count", "details_count").alias("raw_dtob")))


FLAGS_SQL = """SELECT s.requestid, s.itemid,
       CASE WHEN s.distance IS NULL THEN 1 ELSE 0 END AS iscitysearch,
       CASE WHEN s.distance <= 5 THEN 1 ELSE 0 END AS vicinity,
       CASE WHEN r.nearbysearch = 1 THEN 1 ELSE 0 END AS is_nearBy_search,
       CASE WHEN (CASE WHEN s.distance IS NULL THEN 1 ELSE 0 END) = 0
             AND (CASE WHEN r.nearbysearch = 1 THEN 1 ELSE 0 END) = 0 THEN 1 ELSE 0 END AS is_locality_search
  FROM search_response s JOIN search_request r ON s.requestid = r.requestid"""


@register("fn_flags", duck_with(["search_response", "search_request"], FLAGS_SQL))
def q_flags(spark, sf):
    s = view(spark, sf, "search_response").select(
        "requestid", "itemid", "distance",
        F.when(F.col("distance").isNull(), 1).otherwise(0).alias("iscitysearch"))
    r = view(spark, sf, "search_request").select("requestid", "nearbysearch")
    df = s.join(r, "requestid")
    df = df.select("requestid", "itemid", "iscitysearch", flag(F.col("distance") <= 5).alias("vicinity"),
                   flag(F.col("nearbysearch") == 1).alias("is_nearBy_search"))
    df = df.withColumn("is_locality_search",
                       flag((F.col("iscitysearch") == 0) & (F.col("is_nearBy_search") == 0)))
    return finish(df)


def _chain_target_sql():
    inner = CA.chain_sql(4)
    return f"SELECT requestid, itemid, event, realised_flag, COALESCE(CASE WHEN realised_flag IS NOT NULL THEN 'realised' END, event) AS target FROM ({inner})"


@register("fn_target", _chain_target_sql())
def q_target(spark, sf):
    df = CA.chain_spark(spark, sf, 4)
    return finish(df.select("requestid", "itemid", "event", "realised_flag",
                            target("realised_flag", "event").alias("target")))


@register("fn_epoch_day", duck_with(["search_response"],
                                    "SELECT requestid, itemid, searchtime, CAST(epoch_ms(searchtime) AS DATE) AS searchdate "
                                    "FROM search_response"))
def q_epoch_day(spark, sf):
    df = view(spark, sf, "search_response")
    return finish(df.select("requestid", "itemid", "searchtime", D.epoch_ms_to_date("searchtime").alias("searchdate")))


DATES_SQL = """SELECT requestid, checkin, checkout, searchdate,
       CASE WHEN checkout - checkin > 0 THEN checkout - checkin ELSE 0 END AS stayLength,
       CASE WHEN dayofweek(checkin) + 1 IN (6, 7, 1) THEN 1 ELSE 0 END AS is_weekend_checkin,
       dayofweek(checkin) + 1 AS day_of_week_checkin,
       CASE WHEN dayofweek(searchdate) + 1 IN (6, 7, 1) THEN 1 ELSE 0 END AS is_weekend_searchDate,
       dayofweek(searchdate) + 1 AS day_of_week_searchDate,
       CASE WHEN searchdate - checkin > 0 THEN searchdate - checkin ELSE 0 END AS advPurchaseWindow
  FROM (SELECT *, CAST(strptime(substr(inserted_at, 1, 8), '%Y%m%d') AS DATE) AS searchdate FROM search_request)"""


@register("fn_dates", duck_with(["search_request"], DATES_SQL))
def q_dates(spark, sf):
    df = view(spark, sf, "search_request").withColumn("searchdate", D.hour_key_to_date("inserted_at"))
    return finish(df.select(
        "requestid", "checkin", "checkout", "searchdate",
        D.clamped_days("checkout", "checkin").alias("stayLength"),
        D.is_weekend("checkin").alias("is_weekend_checkin"), D.day_of_week("checkin").alias("day_of_week_checkin"),
        D.is_weekend("searchdate").alias("is_weekend_searchDate"),
        D.day_of_week("searchdate").alias("day_of_week_searchDate"),
        D.clamped_days("searchdate", "checkin").alias("advPurchaseWindow")))


@register("fn_hour_key_date", duck_with(["search_request"],
                                        "SELECT requestid, inserted_at, CAST(strptime(substr(inserted_at, 1, 8), '%Y%m%d') AS DATE) AS d "
                                        "FROM search_request"))
def q_hour_key(spark, sf):
    df = view(spark, sf, "search_request")
    return finish(df.select("requestid", "inserted_at", D.hour_key_to_date("inserted_at").alias("d")))


@register("fn_place_score", duck_with(["place"], "SELECT placeid, conversion, popularity, "
                                      "200 * COALESCE(conversion, 0.0049) * sqrt(popularity) AS place_popularity_score FROM place"))
def q_place_score(spark, sf):
    return finish(A.place_popularity(view(spark, sf, "place")))


HAV_SQL = """SELECT r.requestid, r.itemid, r.suppkey,
       6371 * 2 * atan2(sqrt(a), sqrt(1 - a)) AS dist
  FROM (SELECT r.requestid, r.itemid, r.suppkey,
               sin(radians(i.lat - p.lat) / 2) * sin(radians(i.lat - p.lat) / 2)
               + cos(radians(i.lat)) * cos(radians(p.lat)) * sin(radians(i.lng - p.lng) / 2) * sin(radians(i.lng - p.lng) / 2) AS a
          FROM ranked_response r JOIN item_geo i ON r.itemid = i.itemid JOIN place p ON p.placeid = r.suppkey) r"""


@register("fn_haversine", duck_with(["ranked_response", "item_geo", "place"], HAV_SQL))
def q_haversine(spark, sf):
    r = view(spark, sf, "ranked_response").select("requestid", "itemid", "suppkey")
    i = view(spark, sf, "item_geo").select("itemid", F.col("lat").alias("ilat"), F.col("lng").alias("ilng"))
    p = view(spark, sf, "place").select(F.col("placeid").alias("suppkey"), "lat", "lng")
    df = r.join(i, "itemid").join(p, "suppkey")
    return finish(df.select("requestid", "itemid", "suppkey", haversine_km("ilat", "ilng", "lat", "lng").alias("dist")))


@register("fn_fill", duck_with(["search_response"], """SELECT requestid, itemid, COALESCE(distance, 0) AS distance,
       COALESCE(fprice, (SELECT avg(fprice) FROM search_response)) AS fprice FROM search_response"""))
def q_fill(spark, sf):
    df = view(spark, sf, "search_response").select("requestid", "itemid", "distance", "fprice")
    df = fill_existing(df, 0, ["distance", "not_a_column"])
    return finish(FE.fill_with_means(df, df, {"fprice": "fprice"}))


@register("agg_global_mean", duck_with(["search_response"],
                                       "SELECT avg(rating) AS rating_mean, avg(rcount) AS rcount_mean FROM search_response"))
def q_global_mean(spark, sf):
    df = view(spark, sf, "search_response")
    return finish(df.agg(F.avg("rating").alias("rating_mean"), F.avg("rcount").alias("rcount_mean")))


# ---- filters, dedup, projections on the request log -------------------------

@register("flt_range", duck_with(["search_request"], "SELECT * FROM search_request WHERE inserted_at >= '2019121500'"))
def q_flt_range(spark, sf):
    return finish(L.in_window(view(spark, sf, "search_request"), "inserted_at", "2019121500"))


@register("flt_not_equal_null", duck_with(["search_request"], "SELECT * FROM search_request WHERE nearbysearch <> 1"))
def q_flt_ne(spark, sf):
    return finish(view(spark, sf, "search_request").where(F.col("nearbysearch") != 1))


@register("flt_known_users", duck_with(["search_request"],
                                       "SELECT * FROM search_request WHERE userid NOT IN ('', ' ') AND userid IS NOT NULL"))
def q_flt_known(spark, sf):
    return finish(L.known_users(view(spark, sf, "search_request")))


@register("flt_dropna", duck_with(["search_request"],
                                  "SELECT * FROM search_request WHERE requestid IS NOT NULL AND userid IS NOT NULL AND nearbysearch IS NOT NULL"))
def q_flt_dropna(spark, sf):
    return finish(view(spark, sf, "search_request").dropna(subset=["requestid", "userid", "nearbysearch"]))


@register("flt_sentinel", duck_with(["device_event"],
                                    "SELECT * FROM device_event WHERE requestid <> '-' AND event IN ('booking', 'hotel_details_page')"))
def q_flt_sentinel(spark, sf):
    df = view(spark, sf, "device_event").where(F.col("event").isin("booking", "hotel_details_page"))
    return finish(L.drop_sentinel(df, ["requestid", "itemid"]))


@register("ded_full", duck_with(["device_event"], "SELECT DISTINCT * FROM device_event"))
def q_ded_full(spark, sf):
    return finish(view(spark, sf, "device_event").distinct())


@register("ded_key", duck_with(["device_event"], """SELECT requestid, itemid, bookingid, event, dmodel FROM (
  SELECT *, row_number() OVER (PARTITION BY requestid ORDER BY itemid NULLS FIRST, bookingid NULLS FIRST,
                                 event NULLS FIRST, dmodel NULLS FIRST) AS rn FROM device_event) WHERE rn = 1"""))
def q_ded_key(spark, sf):
    df = view(spark, sf, "device_event").drop("inserted_at")
    return finish(A.dedup_key(df, ["requestid"], ["itemid", "bookingid", "event", "dmodel"]))


@register("prj_rename", duck_with(["request_place"], "SELECT requestid, placeid AS search_place_id FROM request_place"))
def q_prj_rename(spark, sf):
    return finish(view(spark, sf, "request_place").select("requestid", F.col("placeid").alias("search_place_id")))


@register("join_place", duck_with(["search_request", "request_place"], """SELECT s.* EXCLUDE (placeid), p.placeid
  FROM search_request s LEFT JOIN (SELECT requestid, min(placeid) AS placeid FROM request_place GROUP BY requestid) p
    ON s.requestid = p.requestid"""))
def q_join_place(spark, sf):
    df = view(spark, sf, "search_request")
    return finish(A.replace_place(df, L.read_request_place(view(spark, sf, "request_place"))))


# ---- base feature projection on the prepared fact table ------------------------

PREP_VIEWS = CA.VIEWS + ["request_place", "place"]

PREPARED_CTES = CA.chain_ctes(len(CA.CHAIN) - 1, CA.ASSEMBLED_SQL_WHERE, "raw") + """,
clean AS (SELECT DISTINCT *, CAST(epoch_ms(searchtime) AS DATE) AS searchdate FROM raw
           WHERE requestid IS NOT NULL AND userid IS NOT NULL AND nearbysearch <> 1 AND userid NOT IN ('', ' ')),
rp AS (SELECT requestid, min(placeid) AS placeid FROM request_place GROUP BY requestid),
pop AS (SELECT placeid, 200 * COALESCE(conversion, 0.0049) * sqrt(popularity) AS place_popularity_score FROM place),
prepared AS (SELECT c.* EXCLUDE (placeid), rp.placeid, pop.place_popularity_score
               FROM clean c LEFT JOIN rp USING (requestid) LEFT JOIN pop ON pop.placeid = rp.placeid)"""


def _g(n, d):
    return f"CASE WHEN {d} = 0 THEN 0 ELSE {n} / {d} END"


BASE_SQL_COLS = ", ".join(FE.PASS_THROUGH) + ", " + ", ".join([
    "COALESCE(CASE WHEN realised_flag IS NOT NULL THEN 'realised' END, event) AS target",
    "CASE WHEN slasherprice = 0 THEN 0 ELSE (slasherprice - fprice) / slasherprice END AS discount_per",
    f"{_g('bookingcount', 'impressioncount')} AS item_br", f"{_g('detailcount', 'impressioncount')} AS item_ctr",
    f"{_g('bookingcount', 'detailcount')} AS item_btod",
    f"{_g('userbookingcount', 'userimpressioncount')} AS item_user_br",
    f"{_g('userdetailcount', 'userimpressioncount')} AS item_user_ctr",
    f"{_g('userbookingcount', 'userdetailcount')} AS item_user_btod",
    f"{_g('booking_count', 'impression_count')} AS avg_item_br",
    f"{_g('details_count', 'impression_count')} AS avg_item_ctr",
    f"{_g('booking_count', 'details_count')} AS avg_item_btod",
    "CASE WHEN checkout - checkin > 0 THEN checkout - checkin ELSE 0 END AS stayLength",
    "CASE WHEN dayofweek(checkin) + 1 IN (6, 7, 1) THEN 1 ELSE 0 END AS is_weekend_checkin",
    "dayofweek(checkin) + 1 AS day_of_week_checkin",
    "fprice - user_abp AS abp_price_diff",
    "CASE WHEN dayofweek(searchdate) + 1 IN (6, 7, 1) THEN 1 ELSE 0 END AS is_weekend_searchDate",
    "dayofweek(searchdate) + 1 AS day_of_week_searchDate",
    "CASE WHEN searchdate - checkin > 0 THEN searchdate - checkin ELSE 0 END AS advPurchaseWindow",
    "CASE WHEN nearbysearch = 1 THEN 1 ELSE 0 END AS is_nearBy_search",
    "CASE WHEN iscitysearch = 1 THEN 1 ELSE 0 END AS is_city_search",
    "CASE WHEN distance <= 5 THEN 1 ELSE 0 END AS vicinity",
    "rating AS ratingMean", "rcount AS ratingCount"])


def prepared(spark, sf, staged=False):
    from . import pipeline as P
    return P.prepare(CA.assembled(spark, sf, staged), view(spark, sf, "request_place"), view(spark, sf, "place"))


@register("prj_base_features", duck_with(PREP_VIEWS, f", {PREPARED_CTES}\nSELECT {BASE_SQL_COLS} FROM prepared"))
def q_base_features(spark, sf):
    return finish(FE.base_features(prepared(spark, sf)))


@register("join_semi_clicked", duck_with(PREP_VIEWS, f", {PREPARED_CTES}\nSELECT {BASE_SQL_COLS} FROM prepared "
                                          "WHERE requestid IN (SELECT requestid FROM prepared WHERE event IS NOT NULL)"))
def q_semi_clicked(spark, sf):
    from ..session import written_stage
    p = written_stage(spark, "prepared", lambda: prepared(spark, sf, staged=True))      # read by the features and by the semi join
    return finish(A.keep_requests_with_event(FE.base_features(p), p))


@register("prj_dynamic", duck_with(["search_request"],
                                   "SELECT * EXCLUDE (checkin, checkout, inserted_at), countryid * 100 + cityid AS geo_key FROM search_request"))
def q_prj_dynamic(spark, sf):
    df = view(spark, sf, "search_request")
    drop = {"checkin", "checkout", "inserted_at"}
    cols = [F.col(c) for c in df.columns if c not in drop] + [(F.col("countryid") * 100 + F.col("cityid")).alias("geo_key")]
    return finish(df.select(*cols))


MEAN_COLS = ["fprice", "rating", "distance", "rcount"]


@register("agg_request_means", duck_with(["search_response"], "SELECT requestid, " + ", ".join(
    f"avg({c}) AS avg_{c}" for c in MEAN_COLS) + " FROM search_response GROUP BY requestid"))
def q_request_means(spark, sf):
    return finish(FE.request_means(view(spark, sf, "search_response"), MEAN_COLS))


@register("join_request_mean", duck_with(["search_response"], "SELECT requestid, itemid, " + ", ".join(
    f"CASE WHEN avg({c}) OVER (PARTITION BY requestid) = 0 THEN NULL ELSE {c} / avg({c}) OVER (PARTITION BY requestid) END AS {c}_ratio"
    for c in MEAN_COLS) + " FROM search_response"))
def q_request_mean(spark, sf):
    df = view(spark, sf, "search_response").select("requestid", "itemid", *MEAN_COLS)
    return finish(FE.request_ratios(df, MEAN_COLS).select("requestid", "itemid", *[f"{c}_ratio" for c in MEAN_COLS]))


STAT_COLS = ["fprice", "rating", "distance", "rcount", "searchtime"]


@register("agg_column_means", duck_with(["search_response"], "SELECT " + ", ".join(
    f"avg({c}) AS {c}" for c in STAT_COLS) + " FROM search_response"))
def q_column_means(spark, sf):
    from ..operators.encode import column_means
    return finish(column_means(view(spark, sf, "search_response"), STAT_COLS))


@register("agg_column_stddevs", duck_with(["search_response"], "SELECT " + ", ".join(
    f"stddev_samp({c}) AS {c}" for c in STAT_COLS) + " FROM search_response"))
def q_column_stddevs(spark, sf):
    from ..operators.encode import column_stddevs
    return finish(column_stddevs(view(spark, sf, "search_response"), STAT_COLS))


@register("agg_vocab", duck_with(["timed_event"], """SELECT DISTINCT 'item' AS kind, itemid AS value, cityid FROM timed_event
UNION ALL SELECT DISTINCT 'type', item_type, cityid FROM timed_event
UNION ALL SELECT DISTINCT 'city', cityid, cityid FROM timed_event"""))
def q_vocab(spark, sf):
    te = view(spark, sf, "timed_event")
    a = te.select(F.lit("item").alias("kind"), F.col("itemid").alias("value"), "cityid").distinct()
    b = te.select(F.lit("type").alias("kind"), F.col("item_type").alias("value"), "cityid").distinct()
    c = te.select(F.lit("city").alias("kind"), F.col("cityid").alias("value"), "cityid").distinct()
    return finish(a.unionByName(b).unionByName(c))


@register("features_full")
def q_features_full(spark, sf):
    """The whole training table; every stage has its own oracle besides."""
    return finish(training(spark, sf))


def training(spark, sf):
    from . import pipeline as P
    # the assembled table joins distinct inputs and keeps all their columns: a set already
    return P.training_table(lambda: CA.assembled(spark, sf, staged=True), view(spark, sf, "request_place"), view(spark, sf, "place"),
                            view(spark, sf, "item_geo"), dedup=False)


def model_rows(spark, sf):
    """The columns of the training table that the 42 model inputs need, written: the statistics and the inputs both read them."""
    from ..operators import encode as EN
    from ..session import written_stage
    cols = ["requestid", "itemid", *EN.NUMERIC_FEATURES, *EN.FLAG_FEATURES, "platform"]
    return written_stage(spark, "model_rows", lambda: training(spark, sf).select(*cols))


@register("enc_model_input")
def q_model_input(spark, sf):
    """The 42 model inputs of the training table (z-scored with its own statistics)."""
    from ..operators import encode as EN
    df = model_rows(spark, sf)
    df = EN.model_input(df, EN.column_stats(df, EN.NUMERIC_FEATURES))
    return finish(df.select("requestid", "itemid", *EN.model_input_columns()))
