"""Scalar functions: epoch days independent of the session zone, ratios, flags."""

import datetime as dt

from pyspark.sql import functions as F

from rankloom.functions import dates as D
from rankloom.functions.flags import label, place_score, target
from rankloom.functions.ratios import guarded_ratio, safe_ratio


def test_epoch_day_ignores_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([(1572566400123,), (1572566399999,)], "ms long")
        got = [r.d for r in df.select(D.epoch_ms_to_date("ms").alias("d")).collect()]
        assert got == [dt.date(2019, 11, 1), dt.date(2019, 10, 31)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_dates(spark):
    df = spark.createDataFrame([(dt.date(2019, 11, 1), dt.date(2019, 11, 4), "2019110312")],
                               "checkin date, checkout date, k string")
    (r,) = df.select(D.clamped_days("checkout", "checkin").alias("stay"),
                     D.clamped_days("checkin", "checkout").alias("neg"),
                     D.is_weekend("checkin").alias("wk"), D.day_of_week("checkin").alias("dow"),
                     D.hour_key_to_date("k").alias("d")).collect()
    assert (r.stay, r.neg, r.wk, r.dow, r.d) == (3, 0, 1, 6, dt.date(2019, 11, 3))   # 2019-11-01 is a Friday


def test_ratios_and_flags(spark):
    df = spark.createDataFrame([(1, 0, None, "booking", 0.0), (2, 4, 1, None, None)],
                               "n long, d long, r int, e string, c double")
    out = df.select(guarded_ratio("n", "d").alias("g"), safe_ratio("n", "d").alias("s"),
                    target("r", "e").alias("t"), label(target("r", "e")).alias("l"),
                    place_score("c", F.lit(100)).alias("p")).collect()
    assert (out[0].g, out[0].s, out[0].t, out[0].l, out[0].p) == (0.0, None, "booking", 1, 0.0)
    assert (out[1].g, out[1].s, out[1].t, out[1].l) == (0.5, 0.5, "realised", 1)
    assert abs(out[1].p - 200 * 0.0049 * 10) < 1e-12
