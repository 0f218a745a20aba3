"""Click histories: hand cases and equality with a plain per-user window."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.functions.lists import list_mean, list_share, list_std
from rankloom.operators import history as H

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "userid long, ts timestamp_ntz, event_id long, requestid string, itemid long, fprice double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def hist(df):
    return H.click_history(df, "userid", ("ts", "event_id"), "requestid", ("itemid", "fprice"), 20, 10)


def test_same_request_clicks_are_dropped(spark):
    rows = [(1, T0 + dt.timedelta(minutes=i), i, "r1", i, 1.0) for i in range(25)]
    out = hist(frame(spark, rows)).collect()
    assert all(r.history == [] for r in out)


def test_last_ten_of_other_requests(spark):
    rows = [(1, T0 + dt.timedelta(minutes=i), i, f"r{i // 5}", i, float(i)) for i in range(25)]
    out = {r.event_id: r.history for r in hist(frame(spark, rows)).collect()}
    # click 24 (request r4) sees clicks 4..23 in its 20-frame; r4 = 20..24 removed -> 4..19, last 10 = 10..19
    assert [h.itemid for h in out[24]] == list(range(10, 20))
    # exactly ten earlier clicks of other requests
    assert [h.itemid for h in out[10]] == list(range(0, 10))
    assert out[0] == []


def test_buckets_equal_single_window(spark):
    """A heavy user spread over many days: bucketed result = one per-user window."""
    rnd = random.Random(3)
    rows = []
    eid = 0
    for u, n in [(1, 400), (2, 30), (3, 1)]:
        for _ in range(n):
            rows.append((u, T0 + dt.timedelta(minutes=rnd.randrange(60 * 24 * 20)), eid, f"q{rnd.randrange(60)}",
                         rnd.randrange(50), rnd.choice([1.0, None, 2.5])))
            eid += 1
    df = frame(spark, rows)
    got = {r.event_id: [tuple(h) for h in r.history] for r in hist(df).collect()}
    w = Window.partitionBy("userid").orderBy("ts", "event_id").rowsBetween(-20, -1)
    plain = df.withColumn("_p", F.collect_list(F.struct("requestid", "itemid", "fprice")).over(w))
    plain = plain.withColumn("_o", F.filter("_p", lambda x: x["requestid"] != F.col("requestid")))
    plain = plain.withColumn("_h", F.slice("_o", F.greatest(F.size("_o") - 9, F.lit(1)), 10))
    want = {r.event_id: [(h.itemid, h.fprice) for h in r._h] for r in plain.collect()}
    assert got == want


def test_one_hot_hour_is_spread(spark):
    """A user-hour with 40 % of the clicks: cut into ranges of even size, equal to the plain window."""
    rnd = random.Random(8)
    rows = [(1, T0 + dt.timedelta(seconds=rnd.randrange(3600)), k, f"q{rnd.randrange(400)}", rnd.randrange(50), 1.0) for k in range(2000)]
    rows += [(rnd.randrange(2, 300), T0 + dt.timedelta(minutes=rnd.randrange(60 * 24 * 9)), k, f"z{rnd.randrange(900)}", rnd.randrange(50), 2.0)
             for k in range(2000, 5000)]
    rnd.shuffle(rows)
    df = frame(spark, rows)
    got = {r.event_id: [h.itemid for h in r._prev] for r in
           H.preceding_lists(df, "userid", ["ts", "event_id"], ["itemid"], 20, partitions=16).collect()}
    w = Window.partitionBy("userid").orderBy("ts", "event_id").rowsBetween(-20, -1)
    want = {r.event_id: list(r.p) for r in df.withColumn("p", F.collect_list("itemid").over(w)).collect()}
    assert got == want
    sizes = df.repartitionByRange(16, "userid", "ts", "event_id").groupBy(F.spark_partition_id()).count().collect()
    sizes = sorted(r["count"] for r in sizes)
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_list_statistics(spark):
    df = spark.createDataFrame([([],), ([1.0],), ([1.0, None],), (None,), ([1.0, 3.0],)], "a array<double>")
    out = df.select(list_mean("a").alias("m"), list_std("a").alias("s"),
                    list_share("a", F.lit(1.0)).alias("r")).collect()
    assert out[0].m == 0.0 and out[0].s == 0.0 and out[0].r == 0.0
    assert abs(out[1].m - 1.0) < 1e-7 and abs(out[1].r - 1.0) < 1e-7
    assert out[2].m is None and out[2].s is None
    assert out[3].m is None and out[3].r is None
    assert abs(out[4].s - 1.0) < 1e-7


def test_keep_known_per_city(spark):
    rows = spark.createDataFrame([(1, 7, [5, 6, 9]), (2, 8, [5]), (3, 7, [])],
                                 "rid long, cityid long, ids array<long>")
    vocab = spark.createDataFrame([(5, 7), (6, 8), (9, 7)], "itemid long, cityid long")
    out = {r.rid: r.ids_known for r in H.keep_known(rows, "ids", vocab, "itemid", "cityid", request="rid").collect()}
    assert out == {1: [5, 0, 9], 2: [0], 3: []}


def test_keep_known_equals_per_position_joins(spark):
    """One explode-join-regroup = the reference's one left join per history position."""
    rnd = random.Random(5)
    rows = [(r, rnd.randrange(3), [rnd.randrange(12) for _ in range(rnd.randrange(11))]) for r in range(80)]
    df = spark.createDataFrame(rows, "rid long, cityid long, ids array<long>")
    vocab_rows = {(rnd.randrange(12), rnd.randrange(3)) for _ in range(15)}
    vocab = spark.createDataFrame(sorted(vocab_rows), "itemid long, cityid long")
    got = {r.rid: r.ids_known for r in H.keep_known(df, "ids", vocab, "itemid", "cityid", request="rid").collect()}
    want = {rid: [v if (v, c) in vocab_rows else 0 for v in ids] for rid, c, ids in rows}
    assert got == want
