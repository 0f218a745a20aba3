"""Running sums and order statistics over range partitions.

Nothing here sorts a table in one task: rows are range-partitioned and written,
each range sums what it holds (one row a range), and the sums of the earlier
ranges become its offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def running(df: DataFrame, order: str, cols: list[str], partitions: int | None = None) -> DataFrame:
    """Adds ``before_<c>``: the sum of ``c`` over the rows with a smaller ``order`` (distinct values)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, order).withColumn("_pid", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy("_pid").agg(*[F.sum(c).alias(f"_{c}") for c in cols])
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    parts = parts.select("_pid", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in cols])
    inside = Window.partitionBy("_pid").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(parts), "_pid")
    return out.withColumns({f"before_{c}": F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in cols}
                           ).drop("_pid", *[f"_{c}" for c in cols])


def value_ranks(df: DataFrame, col: str) -> DataFrame:
    """(col, n, before_n): how often each value occurs, and how many rows lie below it. Null and NaN are left out."""
    values = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    return running(values.groupBy(col).agg(F.count(F.lit(1)).alias("n")), col, ["n"])


def quantile_values(df: DataFrame, col: str, n: int) -> DataFrame:
    """(k, value) for k = 1 .. n - 1: the row of exact rank ceil(k * rows / n); no rows for an empty column."""
    ranked = value_ranks(df, col)
    total = ranked.agg(F.sum("n").alias("_all"))
    rank = F.expr(f"(k * _all + {n - 1}) div {n}")
    wanted = df.sparkSession.range(1, n).withColumnRenamed("id", "k").crossJoin(F.broadcast(total)).withColumn("_rank", rank)
    return ranked.join(F.broadcast(wanted), (F.col("before_n") < F.col("_rank")) & (F.col("_rank") <= F.col("before_n") + F.col("n"))
                       ).select(F.col("k").cast("int").alias("k"), F.col(col).alias("value"))


def auc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: the area under the ROC curve as the exact rank sum, equal scores taking their mean rank.

    Null where a class has no rows."""
    counts = pred.groupBy(F.col(score).alias("_s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
                                                        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    below = running(counts, "_s", ["neg"])
    won = F.sum(F.col("pos") * (2 * F.col("before_neg") + F.col("neg")).cast("decimal(38,0)"))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return below.agg(F.try_divide(won.cast("double") / 2, pairs).alias("auc"))
