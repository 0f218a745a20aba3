"""Sinks, metadata refresh, vocabulary save, bucketed joins, streaming = batch, scratch folders."""

import pyspark.sql.functions as F

from rankloom.fixtures import view
from rankloom.operators import encode as E
from rankloom.plans import catalog_io as IO
from rankloom.sources import logs as L
from rankloom.sources import sinks as S
from rankloom.streaming.scoring import score_and_rank, score_files


def test_refresh_saved_table(spark, small_dir):
    import uuid
    name = f"place_{uuid.uuid4().hex[:8]}"
    view(spark, small_dir, "place").write.saveAsTable(name)
    L.refresh(spark, [name])
    assert spark.table(name).count() == view(spark, small_dir, "place").count()


def test_vocabulary_save(spark, small_dir, tmp_path):
    voc = E.vocabulary(view(spark, small_dir, "timed_event"), "itemid")
    S.save_vocabulary(voc, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == voc.count()


def test_stream_equals_batch(spark, small_dir, tmp_path):
    src = view(spark, small_dir, "timed_event").select("event_id", "requestid", "itemid", "rating", "distance")
    src.repartition(3, "requestid").write.parquet(str(tmp_path / "in"))
    order = dict(new_order=[F.col("score").desc(), F.col("event_id")], current_order=[F.col("event_id")])
    score_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), src.schema,
                IO._stream_scorer, **order)
    streamed = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    batch = score_and_rank(src, IO._stream_scorer, **order)
    cols = sorted(batch.columns)
    assert sorted(map(repr, streamed.select(cols).collect())) == sorted(map(repr, batch.select(cols).collect()))


def test_stream_rerun_is_idempotent(spark, small_dir, tmp_path):
    src = view(spark, small_dir, "timed_event").select("event_id", "requestid", "itemid", "rating", "distance")
    src.repartition(2, "requestid").write.parquet(str(tmp_path / "in"))
    order = dict(new_order=[F.col("score").desc(), F.col("event_id")], current_order=[F.col("event_id")])
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), src.schema, IO._stream_scorer)
    score_files(*args, **order)
    first = spark.read.parquet(str(tmp_path / "out")).count()
    score_files(*args, **order)          # same checkpoint: nothing new, nothing duplicated
    assert spark.read.parquet(str(tmp_path / "out")).count() == first == src.count()


def test_bucketed_join_moves_nothing(spark, small_dir):
    plan = IO.bucketed_join(spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


PLAIN = """
import os, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from rankloom import session as S
assert spark.conf.get("spark.checkpoint.dir", None) is None
first = S.materialize(spark.range(5).toDF("x"), "a")
assert first.count() == 5 and S.checkpoint_dir(spark) == S.checkpoint_dir(spark)
spark.range(3).checkpoint().count()
folder = S.checkpoint_dir(spark)
kept = [d for d in os.listdir(folder) if d.startswith("a-")]
assert len(kept) == 1 and S.drop_scratch(spark) == 1 and not [d for d in os.listdir(folder) if d.startswith("a-")]
print("fine")
"""


def test_a_session_without_a_checkpoint_folder(tmp_path):
    """On a plain machine, with no Spark settings at all, the folder is made and removed."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k not in ("SPARK_CONF_DIR", "PYSPARK_SUBMIT_ARGS")}
    env |= {"SPARK_CONF_DIR": str(tmp_path), "RANKLOOM_SCRATCH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", PLAIN, root], env=env, capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert "fine" in out.stdout, out.stderr[-2000:]
    assert not [d for d in os.listdir(tmp_path) if d.startswith("rankloom-ckpt-")]
