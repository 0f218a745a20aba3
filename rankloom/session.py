"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings every job of the library expects. ANSI stays on (Spark 4 default):
# operators use try_divide / F.get / try_cast where the reference relied on
# nulls from bad arithmetic.
BASE_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "rankloom", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's settings.

    On a cluster, pass master=None and let spark-submit decide; the shuffle
    partition count should then be sized to the data (AQE coalesces small ones).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    conf["spark.ui.enabled"] = "false"
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf.setdefault("spark.driver.memory", os.environ.get("RANKLOOM_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k, v in conf.items():
        if not k.startswith("spark.ui") and not k.startswith("spark.driver"):
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf of an already running session
                pass
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN_DIR: dict[str, str] = {}     # by application: the scratch folder of a local session without a setting


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in spark.checkpoint.dir.

    Only when it is unset and the session is local (tests, a plain machine) a fresh
    scratch folder is made, registered with the context and removed at exit. The setting itself can't
    be changed in a running session, so the folder is kept here. Lineage is cut with
    DataFrame.checkpoint() (never the executor-local variant) or with a written table in this folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = _OWN_DIR.get(sc.applicationId)
    if not d:
        d = _OWN_DIR[sc.applicationId] = tempfile.mkdtemp(prefix="rankloom-ckpt-", dir=os.environ.get("RANKLOOM_SCRATCH", "/tmp"))
        atexit.register(shutil.rmtree, d, ignore_errors=True)
    sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder (never a
    machine-local temp dir on a cluster)."""
    import uuid
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_SCRATCH: dict[str, list[str]] = {}


def drop_scratch(spark: SparkSession) -> int:
    """Delete every scratch folder this application has made so far; returns how many.

    For the end of a job: DataFrames that read such a folder can't be used afterwards."""
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the cluster's checkpoint folder and read back: a stage boundary
    and a lineage cut (a lost executor re-reads the files, and every branch
    over the result sees the same rows in the same partitions' numbering). The
    shuffle files of the job are deleted when it has ended: nothing reads them
    again, and Spark's cleaner waits until the driver collects its garbage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if was is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    made = _SCRATCH.get(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        if p in made:
            made.remove(p)


_HELD: list[DataFrame] = []


def hold(df: DataFrame) -> DataFrame:
    """Persist an intermediate (memory, spilling to disk) until ``releasing`` ends."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _HELD.append(df)
    return df


@contextmanager
def releasing():
    """Unpersist what was held inside; for blocks that end in a written table."""
    mark = len(_HELD)
    try:
        yield
    finally:
        for df in _HELD[mark:]:
            df.unpersist()
        del _HELD[mark:]


@contextmanager
def one_stage(spark: SparkSession):
    """For a block that ends in a written table: ends with it what was made on the way, what was held and the scratch
    folders but the last. The disk then holds one stage at a time, not their sum."""
    before = set(_SCRATCH.get(spark.sparkContext.applicationId, []))
    with releasing():
        yield
    made = [p for p in _SCRATCH.get(spark.sparkContext.applicationId, []) if p not in before]
    _delete(spark, made[:-1])


def written_stage(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``materialize`` what ``build`` returns, as ``one_stage``."""
    with one_stage(spark):
        return materialize(build(), name)
