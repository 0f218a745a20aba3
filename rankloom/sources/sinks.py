"""Writers. Nothing is collected to the driver; every sink is a distributed write."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists",
                  partition_by: list[str] | None = None, cluster_by: list[str] | None = None,
                  num_files: int | None = None) -> None:
    """Parquet write. ``cluster_by`` co-locates rows of a key in the same files
    (hash repartition) so a later reader grouping by that key reads each key
    from few files; ``partition_by`` writes one folder per value (pruning)."""
    if cluster_by:
        df = df.repartition(num_files, *cluster_by) if num_files else df.repartition(*cluster_by)
    elif num_files:
        df = df.repartition(num_files)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, keys: list[str], buckets: int,
                   sort: list[str] | None = None, mode: str = "errorifexists") -> None:
    """A catalogued table at ``path`` bucketed (and sorted) by ``keys``: tables with the same keys and
    number of buckets are joined and grouped by these keys without moving either."""
    w = df.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*(sort or keys))
    w.option("path", path).saveAsTable(table)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", header: bool = True) -> None:
    """CSV write (one file per task; statistics tables are one row anyway)."""
    df.write.mode(mode).option("header", str(header).lower()).csv(path)


def save_vocabulary(vocab: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist an id -> index table for scoring jobs (parquet, small)."""
    vocab.write.mode(mode).parquet(path)
