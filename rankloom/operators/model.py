"""Class weights, layers, seeded order and the quality report of the click/booking classifiers.

The reference trains one joint wide-and-deep network on a single machine; here the
two halves are separate distributed learners over the input of ``learner``: a
weighted logistic regression (the wide part, class weights 1 : 175, L2 0.01) and a
multilayer perceptron 64-32-16-8 (the deep tower), which takes no weight column, so
its rows are repeated as often as their class weighs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import auc, running

CLASS_WEIGHTS = {0: 1.0, 1: 175.0}   # fixed values: weight of no-action vs booked candidates
L2 = 0.01
DEEP_LAYERS = [64, 32, 16, 8]


def shuffle_positions(df: DataFrame, keys: list[str], seed: int = 42, out: str = "position") -> DataFrame:
    """Rows with their place (from 1) in a seeded random order that does not depend on how they arrive:
    the order of a hash of the ``keys``, which name a row, then of the keys. Sort by it before a learner that needs it."""
    text = F.concat_ws("_", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    df = df.withColumns({"_order": F.concat_ws("_", F.md5(text), text), "_one": F.lit(1)})
    df = running(df, "_order", ["_one"])
    return df.withColumn(out, F.col("before__one") + 1).drop("_order", "_one", "before__one")


def report(pred: DataFrame, label: str = "label", score_col: str = "score",
           prediction: str = "prediction") -> DataFrame:
    """Confusion counts per (label, prediction) with precision / recall / F1
    of the positive class and the exact AUC alongside (one small aggregate each)."""
    area = auc(pred, label, score_col)
    counts = pred.groupBy(label, prediction).count()
    hits = lambda y, p: F.sum(F.when((F.col(label) == y) & (F.col(prediction) == p), F.col("count")).otherwise(0))
    m = counts.agg(hits(1, 1).alias("tp"), hits(0, 1).alias("fp"), hits(1, 0).alias("fn"))
    m = m.select(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                 F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    m = m.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return counts.crossJoin(F.broadcast(m)).crossJoin(F.broadcast(area))     # one row each
