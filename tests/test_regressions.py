"""Answers that were once wrong without an error."""

import pytest
from pyspark.sql import functions as F

from rankloom import session
from rankloom.functions.lists import list_share
from rankloom.operators import assemble, encode, geo, history, model, rank


def test_skew_safe_rank_keeps_null_groups(spark):
    rows = [(None, 1), (None, 2), ("a", 1), ("a", 5)]
    df = spark.createDataFrame(rows, "g string, x long")
    want = sorted(map(tuple, rank.rank_within(df, "g", ["x"], "n").collect()), key=str)
    assert sorted(map(tuple, rank.rank_within(df, "g", ["x"], "n", skew_safe=True).collect()), key=str) == want
    assert len(want) == 4


def test_duplicate_place_keeps_its_highest_conversion(spark):
    items = spark.createDataFrame([(1, 0.0, 0.0)], "itemid long, lat double, lng double")
    places = spark.createDataFrame([(7, 0.0, 0.01, None), (7, 0.0, 0.02, 0.3)],
                                   "placeid long, lat double, lng double, conversion double")
    assert abs(geo.place_distance(items, places).first().distance_backfill - 2.22) < 0.01


def test_large_and_string_ids_stay_apart(spark):
    df = spark.createDataFrame([([9007199254740993], 9007199254740992, ["a-1", "b"], "b")],
                               "ids array<long>, id long, names array<string>, name string")
    got = df.select(list_share("ids", "id").alias("a"), list_share("names", "name").alias("b")).first()
    assert got.a == 0 and abs(got.b - 0.5) < 1e-6


def test_known_ids_by_the_row_s_own_city(spark):
    df = spark.createDataFrame([("r", 1, [5, 6]), ("r", 2, [5, 6]), ("s", None, [5])], "requestid string, city long, h array<long>")
    vocab = spark.createDataFrame([(5, 1), (6, 2)], "itemid long, city long")
    got = {(r.requestid, r.city): r.h_known for r in history.keep_known(df, "h", vocab, "itemid", "city").collect()}
    assert got == {("r", 1): [5, 0], ("r", 2): [0, 6], ("s", None): [0]}


def test_pool_adds_padding_without_joining_it(spark):
    table = spark.createDataFrame([(0, [1.0, 1.0]), (1, [4.0, 0.0]), (2, [0.0, 8.0])], "index int, vector array<double>")
    df = spark.createDataFrame([("a", [1, 2, 1]), ("b", []), ("c", [0, 2])], "requestid string, idx array<int>")
    got = {r.requestid: r.v for r in encode.pool_history(df, "idx", table, "v", n=4).collect()}
    assert got == {"a": [9 / 4, 9 / 4], "b": [1.0, 1.0], "c": [3 / 4, 11 / 4]}
    means = encode.mean_vector(table.select(F.col("vector").alias("embedding"))).first().mean_vector
    assert means == [5 / 3, 3.0]


def test_ranges_do_not_rest_on_a_cache(spark):
    df = spark.range(1000).selectExpr("id", "CAST(id % 3 AS STRING) AS g")
    ranked = rank.rank_within(df, "g", ["id"], "n", skew_safe=True, partitions=5)
    vocab = encode.dense_index(df, "id", partitions=7)
    spark.catalog.clearCache()
    assert all(r.n == r.id // 3 + 1 for r in ranked.collect())
    assert all(r["index"] == r.id + 1 for r in vocab.collect())


def test_shuffle_is_seeded_and_whatever_the_arrival(spark):
    df = spark.range(500)
    places = lambda rows, **more: {r.id: r.position for r in model.shuffle_positions(rows, ["id"], **more).collect()}
    a, b, c = places(df), places(df.orderBy(F.desc("id")).repartition(7)), places(df, seed=1)
    assert a == b and sorted(a.values()) == list(range(1, 501)) and a != c and a != {k: k + 1 for k in range(500)}


def test_requests_without_a_place_do_not_meet_on_one_key(spark):
    from rankloom.plans import pipeline
    raw = spark.createDataFrame([(f"r{k}", "u", 0, "2020", 1_580_000_000_000, 3) for k in range(64)],
                                "requestid string, userid string, nearbysearch int, inserted_at string, searchtime long, placeid long")
    places = spark.createDataFrame([(7, 0.1, 100)], "placeid long, conversion double, popularity long")
    which = spark.createDataFrame([(f"r{k}", 7 if k % 2 else None) for k in range(64)], "requestid string, placeid long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = pipeline.prepare(raw, which, places)
        assert "_key" in out._jdf.queryExecution().executedPlan().toString()
        got = {r.requestid: (r.placeid, r.place_popularity_score is None) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {f"r{k}": ((7, False) if k % 2 else (None, True)) for k in range(64)}


def test_realised_flag_keeps_events_without_a_booking(spark):
    flags = spark.createDataFrame([(1, "a", 10, "booking"), (1, "a", None, "hotel_details_page"), (2, "b", 11, "booking")],
                                  "itemid long, requestid string, bookingid long, event string")
    realised = spark.createDataFrame([(10,), (10,), (None,)], "bookingid long")
    got = sorted((r.itemid, r.event, r.realised_flag) for r in assemble.realised_flags(flags, realised).collect())
    assert got == [(1, "booking", 1), (1, "hotel_details_page", None), (2, "booking", None)]


def test_a_cluster_needs_a_shared_checkpoint_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


def test_distinct_by_holds_no_hash_maps(spark):
    """Equal rows, null ones too, meet in a sort, which spills; a plain distinct kept a partition in two hash maps."""
    from rankloom.sources.logs import distinct_by
    rows = [("a", 1, 2.0), ("a", 1, 2.0), ("a", 1, None), ("a", 1, None), (None, None, None), (None, None, None), ("b", 1, 0.0), ("b", 1, -0.0)]
    df = spark.createDataFrame(rows, "requestid string, itemid int, x double")
    out = distinct_by(df, ["requestid", "itemid"])
    key = lambda r: str(tuple(abs(v) if isinstance(v, float) else v for v in r))
    assert out.columns == df.columns and sorted(map(key, out.collect())) == sorted(map(key, df.distinct().collect()))
    assert "HashAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_chain_flags_events_before_the_wide_joins(spark, small_dir, monkeypatch):
    from rankloom.operators import assemble as A
    from rankloom.plans import catalog_assembly as CA
    seen, real = [], A.with_realised_flag
    monkeypatch.setattr(A, "with_realised_flag", lambda df, r: seen.append(set(df.columns)) or real(df, r))
    CA.chain_spark(spark, small_dir, len(CA.CHAIN) - 1)
    assert seen == [{"itemid", "requestid", "bookingid", "event"}]


def test_semi_join_assembles_once(spark, small_dir):
    from rankloom.plans import catalog_features as CF
    assert not [f for f in CF.q_semi_clicked(spark, small_dir).inputFiles() if "lineitem" in f]


def test_city_filter_comes_before_the_rates(spark, monkeypatch):
    """The training table's rate joins get the candidates of the searched city only; the rows are those of a filter at the end."""
    from rankloom.operators import features as FE
    from rankloom.operators import geo as G
    from rankloom.plans import pipeline as P
    ids = F.col("id")
    own = {"requestid": (ids % 9).cast("string"), "itemid": ids % 13, "userid": (ids % 4).cast("string"), "placeid": ids % 5,
           "cityid": F.when(ids % 7 > 0, ids % 3), "searchdate": F.date_add(F.lit("2019-11-01").cast("date"), (ids % 6).cast("int")),
           "event": F.when(ids % 3 == 0, "hotel_details_page").when(ids % 3 == 1, "booking"), "realised_flag": F.lit(None).cast("int"),
           "checkin": F.lit("2019-11-20").cast("date"), "checkout": F.lit("2019-11-22").cast("date"), "nearbysearch": F.lit(0), "iscitysearch": F.lit(0)}
    numbers = ["slasherprice", *[f"{u}{c}count" for u in ("", "user") for c in ("booking", "impression", "detail")],
               *[f"{c}_count" for c in ("booking", "impression", "details")], *[c for c in FE.PASS_THROUGH if c not in own]]
    prepared = spark.range(200).select(*[e.alias(c) for c, e in own.items()], *[(ids % 11 + k).cast("double").alias(c) for k, c in enumerate(numbers)]).cache()
    city = spark.createDataFrame([(k, k % 3) for k in range(12)] + [(4, 2), (4, 2), (5, None)], "itemid long, cityid_item long")
    got, rates = [], P.with_rates
    monkeypatch.setattr(P, "with_rates", lambda df, *a: got.append(df) or rates(df, *a))
    early = P.base_table(prepared, item_city=city)
    late = G.same_city(P.base_table(prepared), city)
    assert sorted(map(repr, early.select(*late.columns).collect())) == sorted(map(repr, late.collect()))
    assert 0 < got[0].count() == late.count() < got[1].count()
    prepared.unpersist()


def test_history_vectors_are_not_shuffled(spark, small_dir):
    """A small vector table is broadcast from the start: the vectors of a request meet where its history is."""
    from rankloom.plans.catalog_encode import q_dot
    p = q_dot(spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_key" not in p and "hashpartitioning(_id" not in p and "hashpartitioning(itemid_idx" not in p


def test_pool_of_lists_longer_and_shorter_than_n(spark):
    table = spark.createDataFrame([(0, None, [1.0, -2.0]), (1, 7, [0.5, 3.0]), (2, 8, [4.0, 0.25])], "index int, itemid long, vector array<double>")
    df = spark.createDataFrame([("a", [7, 99, 8]), ("b", []), ("c", None), ("d", [8, 8, 7, 0])], "requestid string, ids array<long>")
    got = {r.requestid: r.p for r in encode.pool_history(df, "ids", table, "p", n=3, by="itemid").collect()}
    assert got == {"a": [5.5 / 3, 1.25 / 3], "b": [1.0, -2.0], "c": [1.0, -2.0], "d": [9.5 / 4, 1.5 / 4]}


def _shuffle_files(spark):
    import os
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_") and f.endswith(".data")}


def test_a_written_stage_leaves_only_itself(spark):
    """The disk holds one stage at a time: no shuffle file, no folder and no persisted table of its making stays."""
    import os

    counted = lambda n: spark.range(1000).select((F.col("id") % n).alias("k")).groupBy("k").count()
    kept = session.materialize(spark.range(3).withColumnRenamed("id", "k"), "kept")
    folders, base = set(session._SCRATCH[spark.sparkContext.applicationId]), session.checkpoint_dir(spark)
    persisted = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    df = session.written_stage(spark, "outer", lambda: session.hold(session.materialize(counted(10), "inner").repartition(3, "k")).join(kept, "k"))
    left = set(session._SCRATCH[spark.sparkContext.applicationId]) - folders
    assert len(left) == 1 and "/outer-" in next(iter(left)) and df.count() == 3 == kept.count()
    assert not [d for d in os.listdir(base) if d.startswith("inner-")]
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == persisted
    before = _shuffle_files(spark)
    session.materialize(counted(7), "counts")
    assert _shuffle_files(spark) <= before


def test_the_semi_join_keeps_its_prepared_table_only(spark, small_dir):
    """What the assembly writes on the way is deleted, and the staged assembly gives the rows of the plain one."""
    from rankloom.plans import catalog_assembly as CA
    from rankloom.plans import catalog_features as CF
    folders = set(session._SCRATCH.get(spark.sparkContext.applicationId, []))
    CF.q_semi_clicked(spark, small_dir)
    left = set(session._SCRATCH[spark.sparkContext.applicationId]) - folders
    assert len(left) == 1 and "/prepared-" in next(iter(left))
    plain, staged = (CA.assembled(spark, small_dir, staged=k) for k in (False, True))
    assert staged.columns == plain.columns and sorted(map(repr, staged.collect())) == sorted(map(repr, plain.collect()))
