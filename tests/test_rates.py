"""Rolling weighted rates: hand cases and brute force on the dense definition."""

import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from rankloom.operators import rates as R

D0 = dt.date(2024, 1, 1)


def dense_reference(series: dict, n_dates: int, days=7, z=1.282):
    """Direct transcription of the definition on a dense 0-filled series."""
    out = {}
    for key, vals in series.items():
        v = np.array([vals.get(i, 0.0) for i in range(n_dates)])
        for j in range(n_dates):
            w = np.array([days - (j - i) if 0 <= j - i <= days - 1 else 0 for i in range(n_dates)], dtype=float)
            s = sum(days - d for d in range(min(j, days - 1) + 1))
            a = float((w * v).sum() / s)
            sd = math.sqrt(float((w * (v != 0) * (v - a) ** 2).sum())) / s
            out[(key, j)] = a - z * sd
    return out


def events(spark, rows):
    return spark.createDataFrame(rows, "searchdate date, itemid long, event string, fprice double")


def test_weight_totals(spark):
    df = spark.range(10).select(R.weight_total(F.col("id"), 7).alias("s"))
    assert [r.s for r in df.collect()] == [7, 13, 18, 22, 25, 27, 28, 28, 28, 28]


def test_hand_cases(spark):
    rows = []
    for d in range(9):
        day = D0 + dt.timedelta(days=d)
        rows.append((day, 1, None, 1.0))                      # key 1: shown, never clicked
        rows.append((day, 3, "hotel_details_page", 1.0))      # key 3: clicked every day
        rows.append((day, None, "hotel_details_page", 1.0))   # null key: ignored
    rows.append((D0 + dt.timedelta(days=4), 2, "hotel_details_page", 1.0))  # key 2: one day only
    out = {(r.itemid, r.searchdate): r for r in R.weighted_rates(events(spark, rows), ["itemid"], prefix="i").collect()}
    assert all(out[(1, D0 + dt.timedelta(days=d))].i_ctr == 0.0 for d in range(9))
    # a constant non-zero series has no spread: the bound is the weighted mean
    # over the frame (absent days before the first count as 0 only in S)
    assert abs(out[(3, D0 + dt.timedelta(days=8))].i_ctr - 1.0) < 1e-12
    assert abs(out[(3, D0)].i_ctr - 1.0) < 1e-12
    # key 2 is seen on day 4 only: one row, today's weight 7 over S_4 = 25
    assert [k for k in out if k[0] == 2] == [(2, D0 + dt.timedelta(days=4))]
    a = 7 / 25
    want = a - 1.282 * math.sqrt(7 * (1 - a) ** 2) / 25
    assert abs(out[(2, D0 + dt.timedelta(days=4))].i_ctr - want) < 1e-12
    assert not any(k[0] is None for k in out)


def test_against_dense_definition(spark):
    rnd = random.Random(7)
    rows = []
    for _ in range(600):
        d = rnd.randrange(14)
        if d == 5:      # an unobserved calendar day: indices skip it
            continue
        rows.append((D0 + dt.timedelta(days=d), rnd.randrange(6),
                     rnd.choice(["hotel_details_page", "booking", None]), rnd.choice([1.0, None])))
    df = events(spark, rows)
    got = {(r.itemid, r.searchdate): r.i_ctr for r in R.weighted_rates(df, ["itemid"], prefix="i").collect()}
    dates = sorted({r[0] for r in rows})
    idx = {d: i for i, d in enumerate(dates)}
    series = {}
    for (d, k, e, p) in rows:
        series.setdefault(k, {}).setdefault(idx[d], [0, 0])
        c = series[k][idx[d]]
        c[0] += e == "hotel_details_page"
        c[1] += p is not None
    dense = {k: {i: (c[0] / c[1] if c[1] else 0.0) for i, c in v.items()} for k, v in series.items()}
    want = dense_reference(dense, len(dates))
    assert got
    for (k, d), v in got.items():
        assert abs(v - want[(k, idx[d])]) < 1e-9


def test_lag_excludes_today(spark):
    rows = [(D0 + dt.timedelta(days=d), 1, "hotel_details_page" if d == 3 else None, 1.0) for d in range(5)]
    out = {r.searchdate: r.i_ctr for r in R.weighted_rates(events(spark, rows), ["itemid"], prefix="i",
                                                              lag_days=1).collect()}
    assert out[D0] is None          # nothing before the first day
    assert out[D0 + dt.timedelta(days=3)] == 0.0   # the click of day 3 is not seen on day 3
    assert out[D0 + dt.timedelta(days=4)] > 0.0
