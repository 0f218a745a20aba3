"""Checked queries: click histories, list statistics, booking filters, known-id filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import duck_with, view
from ..operators import assemble as A
from ..operators import history as H
from .registry import finish, register

FIELDS = ("itemid", "item_type", "fprice", "distance", "rating")
ORDER = ("ts", "event_id")
CLICK_KINDS = ("hotel_details_page", "booking")


def clicks(spark, sf):
    te = view(spark, sf, "timed_event")
    return te.where(F.col("event").isin(*CLICK_KINDS))


def per_click(spark, sf):
    return H.click_history(clicks(spark, sf), "userid", ORDER, "requestid", FIELDS, 20, 10)


def per_request(spark, sf):
    return H.history_per_request(per_click(spark, sf), "requestid", ORDER)


# DuckDB side: the same three steps as window / list expressions
D_CLICKS = """clicks AS (SELECT * FROM timed_event WHERE event IN ('hotel_details_page', 'booking')),
prev AS (SELECT event_id, userid, requestid, ts,
                COALESCE(list({'r': requestid, 'itemid': itemid, 'item_type': item_type, 'fprice': fprice,
                               'distance': distance, 'rating': rating})
                         OVER (PARTITION BY userid ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), []) AS p
           FROM clicks),
other AS (SELECT *, list_filter(p, lambda x: x.r IS DISTINCT FROM requestid) AS o FROM prev),
hist AS (SELECT event_id, userid, requestid, ts, list_slice(o, greatest(len(o) - 9, 1), len(o)) AS h FROM other),
req AS (SELECT requestid, h FROM (SELECT *, row_number() OVER (PARTITION BY requestid ORDER BY ts, event_id) AS rn
                                   FROM hist) WHERE rn = 1)"""


def _d(body: str) -> str:
    return duck_with(["timed_event"], f", {D_CLICKS}\n{body}")


@register("win_click_history", _d("""SELECT event_id, userid, requestid,
       list_transform(p, lambda x: x.itemid) AS prev_itemids, list_transform(p, lambda x: x.fprice) AS prev_fprice FROM prev"""))
def q_click_history(spark, sf):
    df = H.preceding_lists(clicks(spark, sf), "userid", list(ORDER), ["requestid", *FIELDS], 20)
    return finish(df.select("event_id", "userid", "requestid", F.col("_prev")["itemid"].alias("prev_itemids"),
                            F.col("_prev")["fprice"].alias("prev_fprice")))


@register("win_history_last_n", _d("""SELECT event_id, userid, requestid,
       list_transform(h, lambda x: x.itemid) AS hist_itemids, list_transform(h, lambda x: x.fprice) AS hist_fprice FROM hist"""))
def q_history_last_n(spark, sf):
    df = per_click(spark, sf)
    return finish(df.select("event_id", "userid", "requestid", F.col("history")["itemid"].alias("hist_itemids"),
                            F.col("history")["fprice"].alias("hist_fprice")))


@register("win_history_per_request", _d("""SELECT requestid, list_transform(h, lambda x: x.itemid) AS hist_itemids,
       list_transform(h, lambda x: x.item_type) AS hist_types, list_transform(h, lambda x: x.rating) AS hist_rating FROM req"""))
def q_history_per_request(spark, sf):
    df = per_request(spark, sf)
    return finish(df.select("requestid", F.col("history")["itemid"].alias("hist_itemids"),
                            F.col("history")["item_type"].alias("hist_types"),
                            F.col("history")["rating"].alias("hist_rating")))


@register("prj_array_columns", _d("SELECT requestid, " + ", ".join(
    f"h[{i}].itemid AS clicked_itemid_{i}" for i in range(1, 11)) + " FROM req"))
def q_array_columns(spark, sf):
    df = per_request(spark, sf).withColumn("ids", F.col("history")["itemid"])
    return finish(H.positional_columns(df, "ids", "clicked_itemid").drop("history", "ids"))


def _list_stats_sql(kind: str) -> str:
    m = {f: f"list_transform(h, lambda x: x.{f})" for f in FIELDS}
    if kind == "share":
        sel = (f"CASE WHEN len(h) IS NULL THEN NULL ELSE len(list_filter({m['itemid']}, lambda x: x = itemid)) / (len(h) + 1e-8) END AS item_clicked_rate, "
               f"len(list_filter({m['item_type']}, lambda x: x = item_type)) / (len(h) + 1e-8) AS cat_clicked_rate")
        return _d(f"SELECT t.event_id, t.requestid, t.itemid, {sel} FROM timed_event t JOIN req USING (requestid)")
    cols = []
    for f in ("fprice", "distance", "rating"):
        lst = m[f]
        mean = (f"CASE WHEN list_count({lst}) < len({lst}) THEN NULL "
                f"ELSE COALESCE(list_sum({lst}), 0) / (len({lst}) + 1e-8) END")
        if kind == "mean":
            cols.append(f"{mean} AS clicked_{f}_list_10")
        else:
            cols.append(f"sqrt(COALESCE(list_sum(list_transform({lst}, lambda x: (x - ({mean})) * (x - ({mean})))), 0) "
                        f"/ (len({lst}) + 1e-8)) AS clicked_{f}_list_10_std")
            cols[-1] = f"CASE WHEN ({mean}) IS NULL THEN NULL ELSE {cols[-1].rsplit(' AS ', 1)[0]} END AS clicked_{f}_list_10_std"
    return _d(f"SELECT requestid, {', '.join(cols)} FROM req")


def _list_stats(spark, sf):
    req = per_request(spark, sf)
    req = H.history_columns(req, "history", FIELDS)
    return req


@register("fn_list_share", _list_stats_sql("share"))
def q_list_share(spark, sf):
    te = view(spark, sf, "timed_event").select("event_id", "requestid", "itemid", "item_type")
    df = te.join(_list_stats(spark, sf), "requestid")
    df = H.list_features(df)
    return finish(df.select("event_id", "requestid", "itemid", "item_clicked_rate", "cat_clicked_rate"))


@register("fn_list_mean", _list_stats_sql("mean"))
def q_list_mean(spark, sf):
    df = H.list_features(_list_stats(spark, sf).withColumns({"itemid": F.lit(0), "item_type": F.lit(0)}))
    return finish(df.select("requestid", *[f"clicked_{f}_list_10" for f in ("fprice", "distance", "rating")]))


@register("fn_list_std", _list_stats_sql("std"))
def q_list_std(spark, sf):
    df = H.list_features(_list_stats(spark, sf).withColumns({"itemid": F.lit(0), "item_type": F.lit(0)}))
    return finish(df.select("requestid", *[f"clicked_{f}_list_10_std" for f in ("fprice", "distance", "rating")]))


@register("agg_distinct_bookings", duck_with(["timed_event"], """SELECT requestid, COUNT(DISTINCT bookingid) AS booking_flag_count
  FROM timed_event GROUP BY requestid"""))
def q_distinct_bookings(spark, sf):
    te = view(spark, sf, "timed_event")
    return finish(te.groupBy("requestid").agg(F.countDistinct("bookingid").alias("booking_flag_count")))


@register("join_single_booking", duck_with(["timed_event"], """SELECT * FROM timed_event WHERE requestid IN (
  SELECT requestid FROM timed_event GROUP BY requestid HAVING COUNT(DISTINCT bookingid) < 2)"""))
def q_single_booking(spark, sf):
    return finish(H.keep_single_booking(view(spark, sf, "timed_event")))


EVENT_RANK = "CASE event WHEN 'booking' THEN 1 WHEN 'hotel_details_page' THEN 2 ELSE 3 END"


@register("join_history", _d(f"""SELECT requestid, itemid, event_id, event, len(h) AS hist_len FROM (
  SELECT t.*, req.h, row_number() OVER (PARTITION BY t.itemid, t.requestid ORDER BY {EVENT_RANK}, t.event_id) AS rn
    FROM timed_event t JOIN req ON t.requestid = req.requestid) WHERE rn = 1"""))
def q_join_history(spark, sf):
    te = view(spark, sf, "timed_event").select("requestid", "itemid", "event_id", "event")
    df = te.join(per_request(spark, sf), "requestid", "inner")
    er = F.when(F.col("event") == "booking", 1).when(F.col("event") == "hotel_details_page", 2).otherwise(3)
    df = A.dedup_key(df.withColumn("_er", er), ["itemid", "requestid"], ["_er", "event_id"])
    return finish(df.select("requestid", "itemid", "event_id", "event", F.size("history").alias("hist_len")))


def _known_sql(by_city: bool) -> str:
    vocab = "SELECT DISTINCT itemid AS v, cityid AS c FROM timed_event" if by_city else \
        "SELECT DISTINCT itemid AS v FROM timed_event"
    cond = "e.v = k.v AND e.cityid = k.c" if by_city else "e.v = k.v"
    return _d(f""", rows AS (SELECT t.event_id, t.cityid, list_transform(req.h, lambda x: x.itemid) AS ids
              FROM timed_event t JOIN req USING (requestid)),
ex AS (SELECT event_id, cityid, unnest(ids) AS v, generate_subscripts(ids, 1) AS pos FROM rows),
k AS ({vocab}),
kept AS (SELECT e.event_id, list(CASE WHEN k.v IS NOT NULL THEN e.v ELSE 0 END ORDER BY e.pos) AS known
           FROM ex e LEFT JOIN k ON {cond} GROUP BY e.event_id)
SELECT rows.event_id, COALESCE(kept.known, []) AS known_itemids FROM rows LEFT JOIN kept USING (event_id)""".lstrip(", ")
              .replace("rows AS", ", rows AS", 1))


def _known(spark, sf, by_city: bool):
    te = view(spark, sf, "timed_event")
    rows = te.select("event_id", "requestid", "cityid").join(per_request(spark, sf), "requestid") \
             .withColumn("ids", F.col("history")["itemid"])
    vocab = te.select("itemid", "cityid")
    out = H.keep_known(rows, "ids", vocab, "itemid", "cityid" if by_city else None, request="event_id")
    return finish(out.select("event_id", F.col("ids_known").alias("known_itemids")))


register("join_history_same_city", _known_sql(True))(lambda spark, sf: _known(spark, sf, True))
register("join_history_any_city", _known_sql(False))(lambda spark, sf: _known(spark, sf, False))
