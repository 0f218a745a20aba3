"""Plan checks: no Python UDF evaluation, filters reach the scan, invariance."""

import pytest

import __spark_entry__ as E
from rankloom.fixtures import view
from rankloom.plans import catalog_assembly as CA
from rankloom.operators import assemble as A
from rankloom.sources import logs as L

PLAN_KEYS = ["assemble_impressions", "win_rates_item", "win_history_per_request", "top_place_per_item",
             "join_history_same_city", "enc_history_pool", "prj_base_features", "join_rates"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", PLAN_KEYS)
def test_no_python_udf(spark, small_dir, key):
    p = plan(E.queries()[key](spark, small_dir))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_request_filter_pushed_to_scan(spark, small_dir, tmp_path):
    # a parquet copy of the request log, read back: the range and the IN-list reach the scan
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    d = str(tmp_path / "req")
    view(spark, small_dir, "search_request").write.parquet(d)
    df = L.read_requests(spark.read.parquet(d), CA.START, CA.END, CA.COUNTRIES)
    p = df._jdf.queryExecution().executedPlan().toString()
    pushed = p[p.index("PushedFilters"):]
    assert "GreaterThanOrEqual(inserted_at,2019110100)" in pushed
    assert "LessThan(inserted_at,2020020100)" in pushed
    assert "In(countryid" in pushed


@pytest.mark.parametrize("name,read", [
    ("ranked_response", L.read_responses), ("device_event", L.read_clicked), ("device_event", L.read_event_flags),
    ("device_event", A.event_counts), ("search_response", L.read_search_response), ("user_item_counts", L.read_user_counts)])
def test_window_pushed_to_each_log(spark, small_dir, tmp_path, name, read):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    d = str(tmp_path / name)
    view(spark, small_dir, name).write.parquet(d)
    raw = spark.read.parquet(d)
    df = read(raw, start=CA.START, end=CA.END)
    p = plan(df)
    pushed = p[p.index("PushedFilters"):]
    assert f"GreaterThanOrEqual(inserted_at,{CA.START})" in pushed and f"LessThan(inserted_at,{CA.END})" in pushed
    assert raw.where(f"inserted_at < '{CA.START}'").count() and raw.where(f"inserted_at >= '{CA.END}'").count()


def test_assembly_moves_the_joined_table_twice(spark, small_dir):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(CA.assembled(spark, small_dir)).splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # joins from the top: totals, counters, search, events, candidates. The joined table is the
    # left child, whose lines directly below a join show whether it moves before it
    joins = [i for i, x in enumerate(lines) if "SortMergeJoin" in x]

    def moves(i):  # whether the left child of a join is reached through an exchange
        depth = len(lines[i]) - len(lines[i].lstrip(" :+-"))
        for x in lines[i + 1:]:
            d = len(x) - len(x.lstrip(" :+-"))
            if d <= depth or "SortMergeJoin" in x:
                return False
            if "Exchange" in x:
                return True
            depth = d
        return False

    assert sum(moves(i) for i in joins[:4]) == 2 and moves(joins[0]) and not moves(joins[1]) and not moves(joins[2])


def test_training_table_releases_its_intermediates(spark, small_dir):
    from rankloom.plans.catalog_features import training
    spark.catalog.clearCache()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    training(spark, small_dir).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_no_cartesian_in_assembly_and_geo(spark, small_dir):
    for key in ("assemble_impressions", "top_place_per_item", "join_geo_radius"):
        assert "CartesianProduct" not in plan(E.queries()[key](spark, small_dir))


@pytest.mark.parametrize("key", ["win_rates_item_place", "win_history_last_n", "join_history", "ded_key"])
def test_invariant_to_input_order(spark, small_dir, key):
    a = E.queries()[key](spark, small_dir)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        b = E.queries()[key](spark, small_dir)
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_skew_safe_rank_equals_window(spark):
    import random

    from pyspark.sql import functions as F

    from rankloom.operators.rank import rank_within
    rnd = random.Random(9)
    rows = [("hot" if rnd.random() < 0.4 else f"r{rnd.randrange(30)}", i, rnd.choice([None, rnd.random()]))
            for i in range(2000)]
    df = spark.createDataFrame(rows, "requestid string, itemid long, score double")
    order = [F.col("score").desc_nulls_last(), F.col("itemid")]
    a = {r.itemid: r.rk for r in rank_within(df, "requestid", order, "rk").collect()}
    b = {r.itemid: r.rk for r in rank_within(df, "requestid", order, "rk", skew_safe=True, partitions=9).collect()}
    assert a == b


def test_model_inputs_run_the_feature_plan_once(spark, monkeypatch):
    """The statistics and the inputs read one written table: no join of the training table is left in their plan."""
    from pyspark.sql import functions as F

    from rankloom.operators import encode as EN
    from rankloom.plans import catalog_features as CF
    from rankloom.plans import catalog_io as CI
    ids = spark.range(20)
    rows = ids.select(F.col("id").cast("string").alias("requestid"), F.col("id").alias("itemid"), F.lit("website").alias("platform"),
                      *[(F.col("id") + k).cast("double").alias(c) for k, c in enumerate(EN.NUMERIC_FEATURES)],
                      *[F.lit(1).alias(c) for c in EN.FLAG_FEATURES])
    joined = rows.join(ids.hint("merge"), rows["itemid"] == ids["id"]).drop("id")
    monkeypatch.setattr(CF, "training", lambda spark, sf: joined)
    for query, n in ((CF.q_model_input, 20), (CI.q_assemble, 20 * 42)):
        df = query(spark, "")
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == n


def test_training_table_keeps_one_stage_on_disk(spark, small_dir):
    """The pull, the click ranges and the place lists end when the feature stage is written."""
    from rankloom import session
    from rankloom.plans.catalog_features import training
    before = set(session._SCRATCH.get(spark.sparkContext.applicationId, []))
    df = training(spark, small_dir)
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(session._SCRATCH[spark.sparkContext.applicationId]) - before}
    assert "features_stage" in left and not left & {"raw_pull", "candidates", "priced", "click_ranges", "place_points", "place_lists"}
    assert df.count() > 0
