"""Checked queries: sinks read back, CSV round trip, streaming scoring, the assembled input."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixtures import duck_with, view
from ..operators import assemble as A
from ..operators import encode as E
from ..operators import model as M
from ..session import scratch_path
from ..sources import logs as L
from ..sources import sinks as S
from ..streaming.scoring import score_files
from .registry import by_position, finish, register

PLACE_SCHEMA = T.StructType([T.StructField("placeid", T.LongType()), T.StructField("lat", T.DoubleType()),
                             T.StructField("lng", T.DoubleType()), T.StructField("popularity", T.LongType()),
                             T.StructField("conversion", T.DoubleType())])


@register("snk_parquet", duck_with(["search_request"], "SELECT * FROM search_request"))
def q_snk_parquet(spark, sf):
    d = scratch_path(spark, "snk_parquet")
    S.write_parquet(view(spark, sf, "search_request"), d, partition_by=["countryid"], cluster_by=["requestid"])
    return finish(spark.read.parquet(d))


@register("snk_bucketed", duck_with(["search_request", "search_response"], """SELECT r.requestid, r.cityid, s.itemid, s.fprice
  FROM search_request r JOIN search_response s USING (requestid)"""))
def q_snk_bucketed(spark, sf):
    """Both sides written bucketed by request and read back: the join moves neither."""
    return finish(bucketed_join(spark, sf))


def bucketed_join(spark, sf, buckets: int = 8):
    sides = []
    for name in ("search_request", "search_response"):
        path = scratch_path(spark, f"bucketed_{name}")
        table = path.rsplit("/", 1)[1].replace("-", "_")
        S.write_bucketed(view(spark, sf, name), table, path, ["requestid"], buckets)
        sides.append(spark.table(table))
    r, s = sides
    return r.select("requestid", "cityid").hint("merge").join(s.select("requestid", "itemid", "fprice"), "requestid").select(
        "requestid", "cityid", "itemid", "fprice")


@register("src_refresh", duck_with(["place"], "SELECT * FROM place"))
def q_src_refresh(spark, sf):
    """A catalogued table that is rewritten behind a cached read: after the refresh its old rows are gone."""
    path = scratch_path(spark, "refreshed")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    places = view(spark, sf, "place")
    places.withColumn("popularity", F.col("popularity") + 1).write.option("path", path).saveAsTable(table)
    old = spark.table(table).cache()
    old.count()
    places.write.mode("overwrite").parquet(path)
    L.refresh(spark, [table])
    old.unpersist()
    return finish(spark.table(table))


STATS = ["fprice", "rating", "distance", "rcount"]


@register("snk_csv", duck_with(["search_response"], "SELECT " + ", ".join(
    f"avg({c}) AS {c}__mean, stddev_samp({c}) AS {c}__std" for c in STATS) + " FROM search_response"))
def q_snk_csv(spark, sf):
    d = scratch_path(spark, "snk_csv")
    S.write_csv(E.column_stats(view(spark, sf, "search_response"), STATS), d)
    schema = T.StructType([T.StructField(f"{c}__{k}", T.DoubleType()) for c in STATS for k in ("mean", "std")])
    return finish(L.read_csv(spark, d, schema))


@register("src_csv_roundtrip", duck_with(["place"], "SELECT * FROM place"))
def q_csv_roundtrip(spark, sf):
    d = scratch_path(spark, "src_csv")
    S.write_csv(view(spark, sf, "place"), d)
    return finish(L.read_csv(spark, d, PLACE_SCHEMA))


@register("src_csv_names", duck_with(["place"], "SELECT * FROM place"))
def q_csv_names(spark, sf):
    """A file without a header line takes its names from the schema."""
    d = scratch_path(spark, "src_csv_names")
    S.write_csv(view(spark, sf, "place"), d, header=False)
    return finish(L.read_csv(spark, d, PLACE_SCHEMA, header=False))


@register("snk_vocab", duck_with(["timed_event"], """SELECT itemid, row_number() OVER (ORDER BY itemid) AS index
  FROM (SELECT DISTINCT itemid FROM timed_event WHERE itemid IS NOT NULL)"""))
def q_snk_vocab(spark, sf):
    """A vocabulary saved for scoring jobs and read back."""
    d = scratch_path(spark, "snk_vocab")
    S.save_vocabulary(E.vocabulary(view(spark, sf, "timed_event"), "itemid"), d)
    return finish(L.read_parquet(spark, d))


@register("ded_first", duck_with(["timed_event"], """SELECT itemid, event_id, cityid, fprice FROM (
  SELECT *, row_number() OVER (PARTITION BY itemid ORDER BY event_id) AS rn FROM timed_event) WHERE rn = 1"""))
def q_ded_first(spark, sf):
    """The first row of each item by an explicit input order."""
    df = view(spark, sf, "timed_event").select("itemid", "event_id", "cityid", "fprice")
    return finish(A.dedup_first_by_order(df, ["itemid"], "event_id"))


@register("smp_shuffle", duck_with(["timed_event"], """SELECT event_id, requestid, itemid, fprice,
       row_number() OVER (ORDER BY md5('42_' || event_id) || '_42_' || event_id) AS position FROM timed_event"""))
def q_shuffle(spark, sf):
    """Seeded order before a learner: every row's place in it."""
    df = view(spark, sf, "timed_event").select("event_id", "requestid", "itemid", "fprice")
    return finish(M.shuffle_positions(df, ["event_id"]))


# ---- streaming: score newly arrived files, rank per request -------------------

STREAM_SCORE = "2 * rating - COALESCE(distance, 0) / 10"


def _stream_scorer(df):
    return df.withColumn("score", F.expr(STREAM_SCORE))


@register("stream_score_files", duck_with(["timed_event"], f"""SELECT requestid, event_id, itemid, score,
       row_number() OVER (PARTITION BY requestid ORDER BY score DESC NULLS LAST, event_id) AS new_rank,
       row_number() OVER (PARTITION BY requestid ORDER BY event_id) AS current_rank
  FROM (SELECT *, {STREAM_SCORE} AS score FROM timed_event)"""))
def q_stream(spark, sf):
    src = view(spark, sf, "timed_event").select("event_id", "requestid", "itemid", "rating", "distance")
    in_dir, out_dir = scratch_path(spark, "stream_in"), scratch_path(spark, "stream_out")
    # three files, each holding whole requests
    src.repartition(3, "requestid").write.parquet(in_dir)
    score_files(spark, in_dir, out_dir, scratch_path(spark, "stream_ckpt"), src.schema, _stream_scorer,
                new_order=[F.col("score").desc_nulls_last(), F.col("event_id")],
                current_order=[F.col("event_id")])
    out = spark.read.parquet(out_dir)
    return finish(out.select("requestid", "event_id", "itemid", "score", "new_rank", "current_rank"))


@register("enc_assemble")
def q_assemble(spark, sf):
    """The 42 model inputs of the training table as one Spark ML vector
    (numerics and flags by name, then the platform one-hots)."""
    from pyspark.ml.functions import vector_to_array

    from .catalog_features import model_rows
    df = model_rows(spark, sf)
    df = E.assemble_input(E.model_input(df, E.column_stats(df, E.NUMERIC_FEATURES)))
    return by_position(df.select("requestid", "itemid", vector_to_array("features").alias("features")), "features",
                       "requestid", "itemid")
