"""Score newly arrived feature files and rank the candidates per request.

Structured Streaming over a folder of parquet files: each micro-batch is
scored (a fitted model or any DataFrame -> DataFrame scorer), ranked inside
its requests and written under ``batch=<id>`` with overwrite, so a re-run of
a batch after a failure replaces its own output (idempotent). Contract: one
file holds whole requests (write the files partitioned by request id), so a
request is never ranked in parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.rank import rank_within


def score_and_rank(df: DataFrame, scorer: Callable[[DataFrame], DataFrame], group: str = "requestid",
                   new_order: list | None = None, current_order: list | None = None) -> DataFrame:
    from pyspark.sql import functions as F
    scored = scorer(df)
    new_order = new_order or [F.col("score").desc_nulls_last(), F.col("itemid")]
    current_order = current_order or [F.col("rank").asc_nulls_last(), F.col("itemid")]
    out = rank_within(scored, group, new_order, "new_rank")
    return rank_within(out, group, current_order, "current_rank")


def score_files(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema: StructType,
                scorer: Callable[[DataFrame], DataFrame], files_per_batch: int | None = None,
                available_now: bool = True, **rank_args):
    """Run the stream, with all waiting files in a batch unless ``files_per_batch`` limits them; with ``available_now`` it processes what is there and stops."""
    def batch(df: DataFrame, batch_id: int) -> None:
        score_and_rank(df, scorer, **rank_args).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    r = spark.readStream.schema(schema)
    if files_per_batch is not None:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    w = (r.parquet(in_dir).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q
