"""Ranking of candidates inside a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rank_within(df: DataFrame, group: str, order: list, name: str, skew_safe: bool = False,
                partitions: int | None = None) -> DataFrame:
    """1..n inside each group by ``order`` (give a total order: ties are
    broken by the listed columns, never by input position).

    Default: a window per group, for groups bounded by a result page.
    ``skew_safe=True`` never puts a group into one task: rows are
    range-partitioned on (group, order) so a huge group spans many ranges;
    each (range, group) counts its rows, the counts of the earlier ranges of
    the same group give an offset (a window over at most #ranges rows per
    group), and rank = offset + position inside the range.
    """
    if not skew_safe:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group).asc_nulls_first(), *[_col(o) for o in order]]
    ranged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                .withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()})
                .withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)))
    ranged = materialize(ranged, "ranged")  # both branches must see the same ranges
    parts = ranged.groupBy("_pid", group).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    parts = parts.withColumn("_off", F.sum("_n").over(Window.partitionBy(group).orderBy("_pid")) - F.col("_n"))
    # a null group is a group like any other
    parts = parts.withColumnsRenamed({"_pid": "_pid2", group: "_group2"})
    out = ranged.join(parts, (F.col("_pid") == F.col("_pid2")) & F.col(group).eqNullSafe(F.col("_group2")))
    out = out.withColumn(name, (F.col("_off") + F.col("_pos") - F.col("_first") + 1).cast("int"))
    return out.drop("_pid", "_mid", "_pos", "_first", "_n", "_off", "_pid2", "_group2")


def rank_by_score(df: DataFrame, group: str = "requestid", score: str = "score",
                  current: str = "rank", item: str = "itemid", skew_safe: bool = False) -> DataFrame:
    """new_rank: descending score; current_rank: ascending logged rank; ties by item id."""
    df = rank_within(df, group, [F.col(score).desc_nulls_last(), F.col(item)], "new_rank", skew_safe)
    return rank_within(df, group, [F.col(current).asc_nulls_last(), F.col(item)], "current_rank", skew_safe)
