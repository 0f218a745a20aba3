"""Checked queries: radius join, best place per item, backfill, same city."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import duck_with, view
from ..operators import geo as G
from ..sources import logs as L
from .registry import finish, register

PAIRS = """pairs AS (SELECT i.itemid, p.placeid, p.conversion,
       6371 * 2 * atan2(sqrt(a), sqrt(1 - a)) AS dist
  FROM (SELECT i.itemid, p.placeid,
               sin(radians(i.lat - p.lat) / 2) * sin(radians(i.lat - p.lat) / 2)
               + cos(radians(i.lat)) * cos(radians(p.lat)) * sin(radians(i.lng - p.lng) / 2) * sin(radians(i.lng - p.lng) / 2) AS a
          FROM item_geo i CROSS JOIN place p) x
  JOIN item_geo i USING (itemid) JOIN place p USING (placeid))"""

BEST = PAIRS + """,
flagged AS (SELECT *, max(CASE WHEN dist <= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY itemid) AS anyw FROM pairs),
best AS (SELECT itemid, dist AS distance_backfill FROM (
  SELECT *, row_number() OVER (PARTITION BY itemid ORDER BY
           CASE WHEN anyw = 1 AND dist > 5 THEN 1 ELSE 0 END,
           CASE WHEN anyw = 1 THEN conversion END DESC NULLS LAST, dist, placeid) AS rn FROM flagged) WHERE rn = 1)"""


@register("join_geo_radius", duck_with(["item_geo", "place"], f", {PAIRS}\nSELECT itemid, placeid, dist FROM pairs WHERE dist <= 5"))
def q_radius(spark, sf):
    return finish(G.radius_pairs(view(spark, sf, "item_geo"), view(spark, sf, "place"), 5.0))


@register("top_place_per_item", duck_with(["item_geo", "place"], f", {BEST}\nSELECT * FROM best"))
def q_top_place(spark, sf):
    return finish(G.place_distance(view(spark, sf, "item_geo"), view(spark, sf, "place"), 5.0))


@register("join_distance_backfill", duck_with(["item_geo", "place", "search_response"], f""", {BEST}
SELECT s.requestid, s.itemid, CASE WHEN s.distance IS NULL THEN b.distance_backfill ELSE s.distance END AS distance
  FROM search_response s LEFT JOIN best b USING (itemid)"""))
def q_backfill(spark, sf):
    s = view(spark, sf, "search_response").select(
        "requestid", "itemid", "distance", F.when(F.col("distance").isNull(), 1).otherwise(0).alias("iscitysearch"))
    bf = G.place_distance(view(spark, sf, "item_geo"), view(spark, sf, "place"), 5.0)
    return finish(G.backfill_distance(s, bf).select("requestid", "itemid", "distance"))


@register("join_same_city", duck_with(["search_response", "search_request", "item_geo"], """SELECT s.requestid, s.itemid, r.cityid, i.cityid AS cityid_item
  FROM search_response s JOIN search_request r USING (requestid) JOIN item_geo i ON i.itemid = s.itemid AND i.cityid = r.cityid"""))
def q_same_city(spark, sf):
    s = view(spark, sf, "search_response").select("requestid", "itemid")
    r = view(spark, sf, "search_request").select("requestid", "cityid")
    df = G.same_city(s.join(r, "requestid"), L.read_item_city(view(spark, sf, "item_geo")))
    return finish(df.select("requestid", "itemid", "cityid", "cityid_item"))
