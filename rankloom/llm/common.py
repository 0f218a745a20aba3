"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# Word separators of the corpus contracts: space and the controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"


BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """What Python workers need of the session.

    They import this package from where the driver has it, if they have it
    nowhere else, and get Arrow batches of at most ``BATCH_BYTES``, which
    bounds the memory of both sides when texts are long.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark (any path Spark can open)."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts the lineage with files every executor can read again after a loss.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, text: int | None = None,
           size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into short ones: at most ``rows`` rows and, with the index of a
    ``text`` column, about ``size`` bytes of it (one row at least), so that what is
    worked out for each byte of a slice stays small."""
    for batch in batches:
        if text is None:
            starts = np.arange(0, batch.num_rows, rows)
        else:
            lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            block = np.cumsum(lengths) // size
            new = np.flatnonzero(np.diff(block)) + 1
            starts = np.unique(np.concatenate([new, np.arange(0, batch.num_rows, rows)]))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def word_count(text) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE + "+")), F.lit(0)).cast("long")


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Copy segments (start, length) of ``pool`` one after another; returns bytes and their offsets."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    out = np.empty(offsets[-1], dtype=np.uint8)
    step = 1 << 20  # bounds the index: 8 bytes for each byte written
    first = 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + step, "right")) - 1)
        a, b = offsets[first], offsets[last]
        index = np.repeat(starts[first:last] - offsets[first:last], lengths[first:last])
        index += np.arange(a, b)
        np.take(pool, index, out=out[a:b])
        first = last
    return out, offsets
