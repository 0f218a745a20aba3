"""Checked queries: source scans, filters, dedup, the assembly joins, pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import duck_with, view
from ..operators import assemble as A
from ..sources import logs as L
from .registry import finish, register

# pull window of the checks (3 months; every log but the requests has rows outside it) and all countries
START, END = "2019110100", "2020020100"
COUNTRIES = [0, 1, 2, 3, 4]
BOOK_START, BOOK_END = "1998-01-01", "2001-01-01"
WINDOW = f"inserted_at >= '{START}' AND inserted_at < '{END}'"

SQL = {
    "requests": f"""SELECT DISTINCT requestid, userid, checkin, checkout, platform, placeid, cityid, countryid,
       nearbysearch, inserted_at FROM search_request
 WHERE {WINDOW} AND countryid IN ({', '.join(map(str, COUNTRIES))})
   AND requestid IS NOT NULL AND userid IS NOT NULL""",
    "responses": f"""SELECT DISTINCT requestid, itemid, slasherprice, item_rank AS rank, item_type, user_abp
  FROM ranked_response WHERE {WINDOW} AND sortby = 'popularity' AND requestid IS NOT NULL AND itemid IS NOT NULL""",
    "clicked": f"""SELECT requestid, min(dmodel) AS dmodel FROM device_event
 WHERE {WINDOW} AND event = 'hotel_details_page' GROUP BY requestid""",
    "flags": f"""SELECT DISTINCT itemid, requestid, bookingid, event FROM device_event
 WHERE {WINDOW} AND event IN ('booking', 'hotel_details_page') AND requestid <> '-'""",
    "search": f"""SELECT DISTINCT requestid, itemid, distance, fprice, rating,
       CASE WHEN distance IS NULL THEN 1 ELSE 0 END AS iscitysearch, CAST(rcount AS DOUBLE) AS rcount,
       searchtime, display_category FROM search_response WHERE {WINDOW}""",
    "realised": f"""SELECT bookingid FROM booking_base WHERE status IN (1, 2)
   AND created_at >= TIMESTAMP '{BOOK_START}' AND created_at < TIMESTAMP '{BOOK_END}'""",
    "user_counts": f"""SELECT DISTINCT requestid, itemid, impressioncount, detailcount, bookingcount,
       userimpressioncount, userdetailcount, userbookingcount FROM user_item_counts WHERE {WINDOW} AND requestid <> '-'""",
    "item_city": "SELECT DISTINCT itemid, cityid AS cityid_item FROM item_geo",
    "event_counts": f"""SELECT itemid, event, COUNT(event) AS eventCount FROM device_event
 WHERE {WINDOW} AND event IN ('hotel_details_page', 'booking', 'hotel_impression') AND requestid <> '-'
 GROUP BY itemid, event""",
}
SQL["item_totals"] = f"""SELECT itemid,
       SUM(CASE WHEN event = 'hotel_details_page' THEN eventCount END) AS details_count,
       SUM(CASE WHEN event = 'booking' THEN eventCount END) AS booking_count,
       SUM(CASE WHEN event = 'hotel_impression' THEN eventCount END) AS impression_count
  FROM ({SQL['event_counts']}) GROUP BY itemid"""

VIEWS = ["search_request", "ranked_response", "device_event", "search_response", "booking_base",
         "user_item_counts"]


def sources(spark, sf):
    v = {n: view(spark, sf, n) for n in VIEWS}
    return {
        "requests": L.read_requests(v["search_request"], START, END, COUNTRIES),
        "responses": L.read_responses(v["ranked_response"], start=START, end=END),
        "clicked": L.read_clicked(v["device_event"], start=START, end=END),
        "flags": L.read_event_flags(v["device_event"], start=START, end=END),
        "search": L.read_search_response(v["search_response"], START, END),
        "realised": L.read_realised(v["booking_base"], BOOK_START, BOOK_END),
        "user_counts": L.read_user_counts(v["user_item_counts"], START, END),
        "item_totals": A.item_event_totals(A.event_counts(v["device_event"], start=START, end=END)),
    }


def _src(name):
    return lambda spark, sf: finish(sources(spark, sf)[name])


for key, name in [("src_requests", "requests"), ("src_responses", "responses"),
                  ("src_clicked", "clicked"), ("src_event_flags", "flags"),
                  ("src_search_response", "search"), ("src_realised", "realised"),
                  ("src_user_counts", "user_counts")]:
    register(key, duck_with(VIEWS, SQL[name]))(_src(name))

register("src_item_city", duck_with(["item_geo"], SQL["item_city"]))(
    lambda spark, sf: finish(L.read_item_city(view(spark, sf, "item_geo"))))
register("agg_event_counts", duck_with(VIEWS, SQL["event_counts"]))(
    lambda spark, sf: finish(A.event_counts(view(spark, sf, "device_event"), start=START, end=END)))
register("agg_pivot_events", duck_with(VIEWS, SQL["item_totals"]))(_src("item_totals"))


# ---- the assembly chain: each key adds one join to the previous one ----------

CHAIN = [
    ("join_request_clicked", "clicked", ["requestid"], "inner"),
    ("join_candidates", "responses", ["requestid"], "inner"),
    ("join_event_flags", "flags", ["requestid", "itemid"], "left"),
    ("join_search_response", "search", ["requestid", "itemid"], "left"),
    ("join_realised_flag", "realised", ["bookingid"], "left"),
    ("join_item_totals", "item_totals", ["itemid"], "left"),
    ("join_user_counts", "user_counts", ["requestid", "itemid"], "left"),
]


def chain_spark(spark, sf, upto: int):
    """The chain's rows: the realised flag meets the narrow event rows, and the item totals come last, so the wide
    table moves to (request, item) and to the item, however long the chain is."""
    s = sources(spark, sf)
    steps = CHAIN[:upto + 1]
    if any(name == "realised" for _, name, _, _ in steps):
        s["flags"] = A.realised_flags(s["flags"], s["realised"])
    df = s["requests"]
    for _, name, on, how in sorted(steps, key=lambda step: step[1] == "item_totals"):
        if name != "realised":
            df = df.join(s[name], on=on, how=how)
    return df


def chain_ctes(upto: int, where: str = "", out: str = "chain") -> str:
    """CTE text (without WITH) ending in ``name`` = the joined chain."""
    ctes = [f"requests AS ({SQL['requests']})"]
    frm = "requests"
    for i, (_, name, on, how) in enumerate(CHAIN[:upto + 1]):
        if name == "realised":
            ctes.append(f"realised AS (SELECT DISTINCT bookingid, 1 AS realised_flag FROM ({SQL['realised']}))")
        else:
            ctes.append(f"{name} AS ({SQL[name]})")
        frm = f"{frm} {'JOIN' if how == 'inner' else 'LEFT JOIN'} {name} USING ({', '.join(on)})"
    ctes.append(f"{out} AS (SELECT * FROM {frm} {where})")
    return ",\n".join(ctes)


def chain_sql(upto: int, where: str = "") -> str:
    return duck_with(VIEWS, f", {chain_ctes(upto, where)}\nSELECT * FROM chain")


for i, (key, *_rest) in enumerate(CHAIN):
    register(key, chain_sql(i))(lambda spark, sf, i=i: finish(chain_spark(spark, sf, i)))


def assembled(spark, sf, staged=False):
    s = sources(spark, sf)
    return A.assemble_impressions(s["requests"], s["clicked"], s["responses"], s["flags"],
                                  s["search"], s["realised"], s["item_totals"], s["user_counts"], staged)


ASSEMBLED_SQL_WHERE = "WHERE fprice IS NOT NULL AND slasherprice IS NOT NULL"
register("assemble_impressions", chain_sql(len(CHAIN) - 1, ASSEMBLED_SQL_WHERE))(
    lambda spark, sf: finish(assembled(spark, sf)))
register("flt_priced", duck_with(VIEWS, f", r AS ({SQL['responses']}), s AS ({SQL['search']})\n"
                                 "SELECT * FROM r JOIN s USING (requestid, itemid) "
                                 "WHERE fprice IS NOT NULL AND slasherprice IS NOT NULL"))(
    lambda spark, sf: finish(sources(spark, sf)["responses"].join(sources(spark, sf)["search"],
                                                                  ["requestid", "itemid"])
                             .where(F.col("fprice").isNotNull() & F.col("slasherprice").isNotNull())))
