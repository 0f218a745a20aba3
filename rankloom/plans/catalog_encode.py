"""Checked queries: vocabularies, lookups, z-scores, one-hot, crossed buckets,
embeddings, quantile buckets, labels, vector parsing, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import duck_with, view
from ..functions.flags import label, target
from ..functions.vectors import parse_vector
from ..operators import encode as E
from ..operators import rank as RK
from ..session import materialize
from . import catalog_assembly as CA
from .catalog_history import _d, per_request
from .registry import by_position, finish, register, sql_by_position

Z_COLS = ["fprice", "distance", "rating"]
HASH_SQL = "('0x' || substr(md5({s}), 1, 15))::BIGINT % {n}"


def te(spark, sf):
    return view(spark, sf, "timed_event")


def item_vocab(spark, sf):
    return E.vocabulary(view(spark, sf, "item_embedding"), "itemid")


D_VOCAB = """iv AS (SELECT itemid, row_number() OVER (ORDER BY itemid) AS index
         FROM (SELECT DISTINCT itemid FROM item_embedding WHERE itemid IS NOT NULL)),
tv AS (SELECT item_type, row_number() OVER (ORDER BY item_type) AS index FROM (SELECT DISTINCT item_type FROM timed_event)),
cv AS (SELECT cityid, row_number() OVER (ORDER BY cityid) AS index FROM (SELECT DISTINCT cityid FROM timed_event))"""

EMB_VIEWS = ["timed_event", "item_embedding"]


@register("enc_vocab", duck_with(EMB_VIEWS, f", {D_VOCAB}\nSELECT * FROM iv"))
def q_vocab(spark, sf):
    return finish(item_vocab(spark, sf))


@register("enc_lookup", duck_with(EMB_VIEWS, f""", {D_VOCAB}
SELECT t.event_id, COALESCE(iv.index, 0) AS itemid_idx, COALESCE(tv.index, 0) AS item_type_idx,
       COALESCE(cv.index, 0) AS cityid_idx
  FROM timed_event t LEFT JOIN iv USING (itemid) LEFT JOIN tv USING (item_type) LEFT JOIN cv USING (cityid)"""))
def q_lookup(spark, sf):
    t = te(spark, sf)
    df = E.lookup(t.select("event_id", "itemid", "item_type", "cityid"), "itemid", item_vocab(spark, sf))
    df = E.lookup(df, "item_type", E.vocabulary(t, "item_type"))
    df = E.lookup(df, "cityid", E.vocabulary(t, "cityid"))
    return finish(df.select("event_id", "itemid_idx", "item_type_idx", "cityid_idx"))


@register("enc_zscore", duck_with(["timed_event"], "SELECT event_id, " + ", ".join(
    f"COALESCE(CASE WHEN stddev_samp({c}) OVER () = 0 THEN NULL "
    f"WHEN abs({c} - avg({c}) OVER ()) <= {E.NEAR_MEAN} * abs(avg({c}) OVER ()) THEN 0 "
    f"ELSE ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () END, 0) AS {c}"
    for c in Z_COLS) + " FROM timed_event"))
def q_zscore(spark, sf):
    t = te(spark, sf)
    return finish(E.zscore(t, E.column_stats(t, Z_COLS), Z_COLS).select("event_id", *Z_COLS))


@register("enc_onehot_platform", duck_with(["search_request"], """SELECT requestid, platform,
       CASE WHEN platform = 'android_app' THEN 1 ELSE 0 END AS android_app,
       CASE WHEN platform = 'website' THEN 1 ELSE 0 END AS website,
       CASE WHEN platform = 'ios_app' THEN 1 ELSE 0 END AS ios_app FROM search_request"""))
def q_onehot(spark, sf):
    df = view(spark, sf, "search_request").select("requestid", "platform")
    return finish(E.one_hot(df, "platform"))


@register("enc_onehot_city", duck_with(EMB_VIEWS, f""", {D_VOCAB}
SELECT t.event_id, list_transform(range(m.n), lambda i: CASE WHEN i = COALESCE(cv.index, 0) THEN 1e0 ELSE 0e0 END)
       AS city_onehot
  FROM timed_event t LEFT JOIN cv USING (cityid) CROSS JOIN (SELECT max(index) + 1 AS n FROM cv) m"""))
def q_onehot_city(spark, sf):
    """Spark ML one-hot of the city index (size = largest index + 1, 0 = unknown)."""
    from pyspark.ml.feature import OneHotEncoder
    from pyspark.ml.functions import vector_to_array
    t = te(spark, sf).select("event_id", "cityid")
    df = E.lookup(t, "cityid", E.vocabulary(t, "cityid"))
    enc = OneHotEncoder(inputCols=["cityid_idx"], outputCols=["city_vec"], dropLast=False).fit(df)
    return finish(enc.transform(df).select("event_id", vector_to_array("city_vec").alias("city_onehot")))


BKT_SQL = """vals AS (SELECT distance AS x FROM search_response WHERE distance IS NOT NULL AND NOT isnan(distance)),
cnt AS (SELECT count(*) AS n FROM vals),
ranked AS (SELECT x, row_number() OVER (ORDER BY x) AS rn FROM vals),
qs AS (SELECT DISTINCT x AS q FROM ranked, cnt WHERE rn IN (""" + ", ".join(
    f"ceil({i / 10} * n)" for i in range(1, 10)) + """)),
bk AS (SELECT requestid, itemid, distance, distance IS NULL AS isnull_d,
              CAST(CASE WHEN distance IS NULL THEN NULL ELSE (SELECT count(*) FROM qs WHERE q <= distance) END AS DOUBLE)
              AS distance_buckets, CASE WHEN distance IS NULL THEN 1 ELSE 0 END AS iscitysearch
         FROM search_response)"""


def buckets(spark, sf):
    df = view(spark, sf, "search_response").select(
        "requestid", "itemid", "distance", F.when(F.col("distance").isNull(), 1).otherwise(0).alias("iscitysearch"))
    return E.quantile_buckets(df, "distance", "distance_buckets", 10)


@register("bkt_distance", duck_with(["search_response"], f", {BKT_SQL}\nSELECT requestid, itemid, distance, distance_buckets FROM bk"))
def q_buckets(spark, sf):
    return finish(buckets(spark, sf).select("requestid", "itemid", "distance", "distance_buckets"))


@register("bkt_ml_rank_error", "SELECT unnest(range(1, 10)) AS k, 1 AS within")
def q_buckets_ml_error(spark, sf):
    """Whether each split of the approximate discretizer lies within 0.001 of the rows of its exact rank."""
    df = view(spark, sf, "search_response").select("distance")
    splits = E.discretizer_splits(df, "distance", 10, 0.001)
    return finish(E.rank_errors(df, "distance", splits, 10).select("k", (F.col("rank_error") <= 0.001).alias("within")))


@register("bkt_distance_ml")
def q_buckets_ml(spark, sf):
    """Spark ML QuantileDiscretizer path (approximate, rows-only check)."""
    df = view(spark, sf, "search_response").select("requestid", "itemid", "distance")
    return finish(E.quantile_discretizer(df, "distance", "distance_buckets", 10, 0.001))


@register("enc_cross_distance_city", duck_with(["search_response"], f""", {BKT_SQL}
SELECT requestid, itemid, {HASH_SQL.format(s="concat_ws('_', CAST(CAST(distance_buckets AS BIGINT) AS VARCHAR), CAST(iscitysearch AS VARCHAR))", n=20)} AS distance_city_bucket FROM bk"""))
def q_cross_distance(spark, sf):
    df = buckets(spark, sf).withColumn("db", F.col("distance_buckets").cast("bigint"))
    return finish(E.cross_bucket(df, "db", "iscitysearch", 20, "distance_city_bucket")
                  .select("requestid", "itemid", "distance_city_bucket"))


def _hist_rows(spark, sf):
    t = te(spark, sf).select("event_id", "requestid", "itemid", "item_type")
    return t.join(per_request(spark, sf), "requestid")


@register("enc_cross_type_history", _d(f""", rows AS (SELECT t.event_id,
       list_sort(list_transform(req.h, lambda x: {HASH_SQL.format(s="concat_ws('_', CAST(t.item_type AS VARCHAR), CAST(x.item_type AS VARCHAR))", n=196)})) AS b
  FROM timed_event t JOIN req USING (requestid))
SELECT event_id, list_distinct(b) AS d, b FROM rows""".lstrip(", ").replace("rows AS", ", rows AS", 1)
    .replace("SELECT event_id, list_distinct(b) AS d, b FROM rows", """SELECT event_id, list_sort(list_distinct(b)) AS type_cross_idx,
       list_transform(list_sort(list_distinct(b)), lambda d: CAST(len(list_filter(b, lambda x: x = d)) AS BIGINT)) AS type_cross_cnt
  FROM rows""")))
def q_cross_type(spark, sf):
    df = _hist_rows(spark, sf).withColumn("ht", F.col("history")["item_type"])
    return finish(E.cross_with_list(df, "item_type", "ht", 196, "type_cross")
                  .select("event_id", "type_cross_idx", "type_cross_cnt"))


D_EMB = """mv AS (SELECT list(m ORDER BY d) AS v FROM (
         SELECT d, avg(CAST(e AS DOUBLE)) AS m FROM (
           SELECT unnest(embedding) AS e, generate_subscripts(embedding, 1) AS d FROM item_embedding) GROUP BY d)),
tab AS (SELECT iv.index, CAST(e.embedding AS DOUBLE[]) AS v FROM item_embedding e JOIN iv USING (itemid)
        UNION ALL SELECT 0, v FROM mv)"""


def emb_table(spark, sf):
    """The vectors by index, written: the planner knows their size, and broadcasts them where they are small, so
    that no vector is shuffled with the rows that look it up."""
    return materialize(E.embedding_table(view(spark, sf, "item_embedding"), item_vocab(spark, sf)), "vectors")


@register("agg_mean_vector", sql_by_position(duck_with(
    ["item_embedding"], f", {D_EMB.split(',' + chr(10) + 'tab AS')[0]}\nSELECT v FROM mv"), "v"))
def q_mean_vector(spark, sf):
    return by_position(E.mean_vector(view(spark, sf, "item_embedding")), "mean_vector")


@register("enc_embedding_lookup", sql_by_position(duck_with(EMB_VIEWS, f""", {D_VOCAB}, {D_EMB}
SELECT t.event_id, tab.v FROM timed_event t LEFT JOIN iv USING (itemid) JOIN tab ON tab.index = COALESCE(iv.index, 0)"""),
    "v", "event_id"))
def q_emb_lookup(spark, sf):
    t = E.lookup(te(spark, sf).select("event_id", "itemid"), "itemid", item_vocab(spark, sf))
    tab = emb_table(spark, sf)
    return by_position(t.join(tab.drop("itemid"), t["itemid_idx"] == tab["index"]), "vector", "event_id")


D_POOL = """hidx AS (SELECT r.requestid, list_transform(r.h, lambda x: x.itemid) AS ids FROM req r),
hx AS (SELECT requestid, unnest(ids) AS itemid, generate_subscripts(ids, 1) AS p FROM hidx),
hi AS (SELECT h.requestid, list(COALESCE(iv.index, 0) ORDER BY h.p) AS idx FROM hx h LEFT JOIN iv USING (itemid) GROUP BY h.requestid),
hall AS (SELECT r.requestid, COALESCE(hi.idx, []) AS idx FROM hidx r LEFT JOIN hi USING (requestid)),
padded AS (SELECT requestid, list_concat(idx, list_transform(range(greatest(10 - len(idx), 0)), lambda q: 0)) AS idx FROM hall),
px AS (SELECT requestid, unnest(idx) AS index FROM padded),
pv AS (SELECT px.requestid, unnest(tab.v) AS e, generate_subscripts(tab.v, 1) AS d FROM px JOIN tab USING (index)),
pooled AS (SELECT requestid, list(m ORDER BY d) AS pooled FROM (SELECT requestid, d, avg(e) AS m FROM pv GROUP BY requestid, d)
           GROUP BY requestid)"""


def pooled(spark, sf, tab):
    req = per_request(spark, sf).withColumn("ids", F.coalesce(F.col("history")["itemid"], F.array().cast("array<bigint>")))
    return E.pool_history(req.select("requestid", "ids"), "ids", tab, "pooled", by="itemid").select("requestid", "pooled")


def _pool_sql(body: str) -> str:
    return duck_with(EMB_VIEWS, f""", {D_VOCAB}, {D_EMB},
clicks AS (SELECT * FROM timed_event WHERE event IN ('hotel_details_page', 'booking')),
prev AS (SELECT event_id, userid, requestid, ts,
                COALESCE(list({{'r': requestid, 'itemid': itemid}})
                         OVER (PARTITION BY userid ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), []) AS p
           FROM clicks),
other AS (SELECT *, list_filter(p, lambda x: x.r IS DISTINCT FROM requestid) AS o FROM prev),
hist AS (SELECT event_id, requestid, ts, list_slice(o, greatest(len(o) - 9, 1), len(o)) AS h FROM other),
req AS (SELECT requestid, h FROM (SELECT *, row_number() OVER (PARTITION BY requestid ORDER BY ts, event_id) AS rn
                                   FROM hist) WHERE rn = 1),
{D_POOL}
{body}""")


@register("enc_history_pool", sql_by_position(_pool_sql("SELECT requestid, pooled FROM pooled"), "pooled", "requestid"))
def q_pool(spark, sf):
    return by_position(pooled(spark, sf, emb_table(spark, sf)), "pooled", "requestid")


@register("enc_embedding_dot", _pool_sql("""SELECT t.event_id, list_dot_product(tab.v, p.pooled) AS history_affinity
  FROM timed_event t LEFT JOIN iv USING (itemid) JOIN tab ON tab.index = COALESCE(iv.index, 0)
  JOIN pooled p ON p.requestid = t.requestid"""))
def q_dot(spark, sf):
    t = E.lookup(te(spark, sf).select("event_id", "requestid", "itemid"), "itemid", item_vocab(spark, sf))
    tab = emb_table(spark, sf)
    # by request first: the item's vector is not yet in the rows that move
    t = t.join(pooled(spark, sf, tab), "requestid")
    t = t.join(tab.drop("itemid"), t["itemid_idx"] == tab["index"])
    return finish(t.select("event_id", E.embedding_dot("vector", "pooled").alias("history_affinity")))


def _vector_text(col):
    """'[i i i ...\\n i ...]' from round(x * 1000), a newline after every 8th value."""
    toks = F.transform(col, lambda x, i: F.concat(F.round(x * 1000).cast("bigint").cast("string"),
                                                  F.when(i % 8 == 7, F.lit("\n")).otherwise(F.lit(" "))))
    return F.concat(F.lit("["), F.rtrim(F.array_join(toks, "")), F.lit("]"))


@register("fn_parse_vector", duck_with(["item_embedding"], """, txt AS (
  SELECT itemid, '[' || rtrim(array_to_string(list_transform(embedding, lambda x, i:
           CAST(CAST(round(x * 1000) AS BIGINT) AS VARCHAR) || CASE WHEN i % 8 = 0 THEN chr(10) ELSE ' ' END), ''), ' ' || chr(10)) || ']' AS t
    FROM item_embedding)
SELECT itemid, list_transform(list_filter(string_split(replace(regexp_replace(t, '^\\[|\\]$', '', 'g'), chr(10), ' '), ' '),
                              lambda s: s <> ''), lambda s: CAST(s AS FLOAT)) AS vec FROM txt"""))
def q_parse_vector(spark, sf):
    df = view(spark, sf, "item_embedding").select("itemid", _vector_text(F.col("embedding")).alias("t"))
    return finish(df.select("itemid", parse_vector("t").alias("vec")))


@register("fn_label", f"SELECT requestid, itemid, target, CASE WHEN target IN ('realised', 'booking') THEN 1 ELSE 0 END AS label FROM (SELECT requestid, itemid, COALESCE(CASE WHEN realised_flag IS NOT NULL THEN 'realised' END, event) AS target FROM ({CA.chain_sql(4)}))")
def q_label(spark, sf):
    df = CA.chain_spark(spark, sf, 4).select("requestid", "itemid", target().alias("target"))
    return finish(df.withColumn("label", label("target")))


@register("win_current_rank", duck_with(["ranked_response"], """SELECT requestid, itemid, item_rank,
       row_number() OVER (PARTITION BY requestid ORDER BY item_rank, itemid, slasherprice, item_type, user_abp, sortby, suppkey, quantity) AS current_rank
  FROM ranked_response"""))
def q_current_rank(spark, sf):
    df = view(spark, sf, "ranked_response")
    out = RK.rank_within(df, "requestid", ["item_rank", "itemid", "slasherprice", "item_type", "user_abp", "sortby",
                                           "suppkey", "quantity"], "current_rank", skew_safe=True)
    return finish(out.select("requestid", "itemid", "item_rank", "current_rank"))


@register("win_new_rank", duck_with(["search_response"], """SELECT requestid, itemid, fprice,
       row_number() OVER (PARTITION BY requestid ORDER BY fprice DESC NULLS LAST, itemid, distance, rating, rcount, display_category, searchtime) AS new_rank
  FROM search_response"""))
def q_new_rank(spark, sf):
    df = view(spark, sf, "search_response")
    out = RK.rank_within(df, "requestid", [F.col("fprice").desc_nulls_last(), "itemid", "distance", "rating", "rcount",
                                           "display_category", "searchtime"], "new_rank", skew_safe=True)
    return finish(out.select("requestid", "itemid", "fprice", "new_rank"))
