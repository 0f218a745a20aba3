"""A scoring bundle: everything a scoring job needs of a training run, saved as one version.

``<root>/versions/<version>/<part>`` holds the parts (tables, and the deep model in
Spark ML's own format); ``<root>/manifests/<version>`` is written last. A reader
takes the manifest with the highest number, so a publication that failed half-way
is never seen, and the version a job has loaded stays as it is while a newer one is
published. Writers of one root are expected to publish one after another.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import learner as LN

PARTS = ("stats", "items", "types", "cities", "splits", "vectors", "coefficients")
MAX_SLOTS = 1 << 20      # the coefficients travel as one array of at most 8 MB
_MANIFEST = "number long, version string, n_cities long, parts array<string>, deep boolean"


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(_MANIFEST).json(f"{root}/manifests/*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _MANIFEST)


def publish(root: str, tables: dict[str, DataFrame], deep=None) -> str:
    """Save the ``PARTS`` (and a fitted perceptron) as the newest version; returns its name."""
    missing = [p for p in PARTS if p not in tables]
    if missing:
        raise ValueError(f"a bundle needs {missing}")
    spark = tables["stats"].sparkSession
    n_cities = tables["cities"].count()
    if LN.Layout(n_cities).size > MAX_SLOTS:
        raise ValueError(f"more than {MAX_SLOTS} slots")
    version = uuid.uuid4().hex
    for p in PARTS:
        tables[p].write.parquet(f"{root}/versions/{version}/{p}")
    if deep is not None:
        deep.save(f"{root}/versions/{version}/deep")
    number = (_manifests(spark, root).agg(F.max("number")).first()[0] or 0) + 1
    row = spark.createDataFrame([(number, version, n_cities, list(PARTS), deep is not None)], _MANIFEST)
    row.coalesce(1).write.json(f"{root}/manifests/{version}")
    return version


class Bundle:
    """A published version, read back."""

    def __init__(self, spark: SparkSession, root: str, version: str | None = None):
        found = _manifests(spark, root)
        if version is not None:
            found = found.where(F.col("version") == version)
        self.manifest = found.orderBy(F.desc("number")).first()
        if self.manifest is None:
            raise FileNotFoundError(f"no published bundle {version or ''} in {root}")
        self.path = f"{root}/versions/{self.manifest.version}"
        self.tables = {p: spark.read.parquet(f"{self.path}/{p}") for p in self.manifest.parts}
        self.layout = LN.Layout(self.manifest.n_cities)

    def deep(self):
        from pyspark.ml.classification import MultilayerPerceptronClassificationModel
        return MultilayerPerceptronClassificationModel.load(f"{self.path}/deep")

    def encode(self, rows: DataFrame, keep: tuple = ()) -> DataFrame:
        return LN.encode_rows(rows, self.tables, self.layout, keep)

    def score(self, rows: DataFrame, keep: tuple = (), out: str = "score") -> DataFrame:
        """Feature rows -> key, ``keep``, label and the wide model's probability; also inside a micro-batch."""
        return with_score(self.encode(rows, keep), self.tables["coefficients"], out)


def with_score(encoded: DataFrame, coefficients: DataFrame, out: str = "score") -> DataFrame:
    """``encoded`` rows without their inputs, with the linear model's probability."""
    slots = F.filter(F.array_sort(F.collect_list(F.struct("slot", "coefficient"))), lambda x: x["slot"] >= 0)
    one = coefficients.agg(F.transform(slots, lambda x: x["coefficient"]).alias("_c"),
                           F.max(F.when(F.col("slot") < 0, F.col("coefficient"))).alias("_b"))
    scored = encoded.join(F.broadcast(one))         # one row, at most MAX_SLOTS numbers
    return scored.withColumn(out, LN.probability(LN.margin("entries", "_c", "_b"))).drop("_c", "_b")
