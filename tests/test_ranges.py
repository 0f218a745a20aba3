"""Exact order statistics, running sums and the exact AUC over range partitions."""

import math
import random

from pyspark.sql import functions as F

from rankloom.operators import encode as E
from rankloom.operators import ranges as R


def test_exact_splits_of_many_distinct_values(spark):
    n = 100_003
    df = spark.range(n).select((((F.col("id") * 7919) % n) / 7.0).alias("x"))
    (row,) = E.quantile_splits(df, "x").collect()
    assert row.splits[1:-1] == [(math.ceil(k * n / 10) - 1) / 7.0 for k in range(1, 10)]
    assert E.quantile_buckets(df, "x", "b").groupBy("b").count().count() == 10


def test_splits_of_odd_columns(spark):
    empty = spark.createDataFrame([], "x double")
    assert [list(r.splits) for r in E.quantile_splits(empty, "x").collect()] == [[-math.inf, math.inf]]
    odd = spark.createDataFrame([(None,), (float("nan"),), (3.0,), (3.0,)], "x double")
    assert list(E.quantile_splits(odd, "x").first().splits) == [-math.inf, 3.0, math.inf]
    whole = spark.createDataFrame([(k,) for k in range(10)], "x int")
    assert [r.value for r in R.quantile_values(whole, "x", 5).orderBy("k").collect()] == [1, 3, 5, 7]


def test_discretizer_splits_are_within_their_error(spark):
    df = spark.range(50_000).select((F.sin("id") * 1000).alias("x"))
    errors = E.rank_errors(df, "x", E.discretizer_splits(df, "x", 10, 0.001), 10).collect()
    assert len(errors) == 9 and all(r.rank_error <= 0.001 for r in errors)
    shifted = [r.value + 0 for r in R.quantile_values(df, "x", 10).orderBy("k").collect()][1:] + [df.agg(F.max("x")).first()[0]]
    assert all(r.rank_error > 0.05 for r in E.rank_errors(df, "x", shifted, 10).collect())


def test_auc_equals_counting_pairs(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(2), rnd.choice([0.1, 0.2, 0.2, 0.5, rnd.random()])) for _ in range(400)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "label int, score double")
    assert abs(R.auc(df).first().auc - want) < 1e-12
    assert R.auc(df.where("label = 1")).first().auc is None


def test_running_sums(spark):
    df = spark.range(1000).select(F.col("id").alias("v"), (F.col("id") % 7).alias("n")).repartition(5)
    got = {r.v: r.before_n for r in R.running(df, "v", ["n"], 6).collect()}
    assert got == {k: sum(j % 7 for j in range(k)) for k in range(1000)}
