"""The learners' input: every training-table row as sparse (slot, value) entries.

Slots, in this order: the 42 dense inputs, the history affinity, the city one-hot,
the type-history counts (196) and the distance x city-search indicator (20). A row
holds at most 42 + 1 + 1 + 10 + 1 entries, however many slots there are, and no
dense array of the slots is ever built: the entries are arrays, and the Spark ML
vector comes from the count vectorizer, the one-hot encoder and the assembler.

Fitted tables (statistics, vocabularies, splits, vectors) go in as DataFrames, so
training and scoring share this one path; ``Bundle`` saves and loads them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import encode as E

TYPE_CROSS, DISTANCE_CROSS = 196, 20      # fixed values: hash buckets of the two crosses
N_HISTORY = 10
KEY = ("requestid", "itemid")


def n_dense() -> int:
    return len(E.model_input_columns()) + 1   # the affinity comes last


class Layout:
    """Where each block of slots starts, for ``n_cities`` known cities."""

    def __init__(self, n_cities: int):
        self.n_cities = n_cities
        self.city = n_dense()
        self.types = self.city + n_cities + 1          # city 0 is the unknown one
        self.distance = self.types + TYPE_CROSS
        self.size = self.distance + DISTANCE_CROSS

    def names(self) -> list[str]:
        return [*E.model_input_columns(), "history_affinity", *[f"city_{k}" for k in range(self.n_cities + 1)],
                *[f"type_cross_{k}" for k in range(TYPE_CROSS)], *[f"distance_cross_{k}" for k in range(DISTANCE_CROSS)]]


def counts_of(buckets: Column) -> Column:
    """A list of bucket numbers as (slot, value) entries: each bucket once, ascending, with its count."""
    return F.transform(F.array_sort(F.array_distinct(buckets)), lambda b: F.struct(
        b.cast("int").alias("slot"), F.size(F.filter(buckets, lambda x: x == b)).cast("double").alias("value")))


def fit_tables(df: DataFrame, embeddings: DataFrame) -> dict[str, DataFrame]:
    """Statistics, the three vocabularies, the distance splits and the item vectors of a training table."""
    items = E.vocabulary(embeddings, "itemid")
    return {"stats": E.column_stats(df, E.NUMERIC_FEATURES), "items": items, "types": E.vocabulary(df, "item_type"),
            "cities": E.vocabulary(df, "cityid"), "splits": E.quantile_splits(df, "distance"),
            "vectors": E.embedding_table(embeddings, items)}


def _history(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``df`` with its type-history indices and pooled history vector.

    Both depend on (request, city) alone, so each distinct pair is encoded once. 0
    in a history column is padding and stays 0.
    """
    ids = F.array(*[F.col(f"clicked_itemid_{k}").cast("bigint") for k in range(1, N_HISTORY + 1)])
    types = F.array(*[F.col(f"clicked_item_type_{k}").cast("int") for k in range(1, N_HISTORY + 1)])
    pair = F.struct("requestid", "cityid")
    req = df.select(pair.alias("_pair"), ids.alias("_ids"), types.alias("_types")).dropDuplicates(["_pair"])
    vectors = tables["vectors"].where(F.coalesce(F.col("itemid"), F.lit(-1)) != 0)
    req = E.pool_history(req, "_ids", vectors, "_pooled", "_pair", N_HISTORY, by="itemid")
    known = tables["types"].where(F.col("item_type") != 0)
    req = E.lookup_array(req, "_types", known, "_type_idx", "_pair").select("_pair", "_type_idx", "_pooled")
    return df.withColumn("_row_pair", pair).join(req, F.col("_row_pair").eqNullSafe(F.col("_pair"))).drop("_pair", "_row_pair")


def encode_rows(df: DataFrame, tables: dict[str, DataFrame], layout: Layout, keep: tuple = ()) -> DataFrame:
    """KEY, ``keep``, label, the dense inputs, ``history_affinity``, ``cityid_idx``, the two crosses as
    (slot, value) arrays inside their block, and ``entries`` over all slots."""
    df = _history(df, tables)
    df = E.bucket_by(df.drop("distance_buckets"), "distance", tables["splits"], "distance_buckets")
    df = E.lookup(df, "item_type", tables["types"])
    df = E.lookup(df, "cityid", tables["cities"])
    v = tables["vectors"]
    zero = v.where(F.col("index") == 0).select(F.col("vector").alias("_zero"))
    own = v.where(F.col("index") != 0).select(F.col("itemid").alias("_own"), F.col("vector").alias("_vector"))
    df = df.join(own, df["itemid"] == own["_own"], "left").join(F.broadcast(zero))     # one row
    df = df.withColumn("history_affinity", E.embedding_dot(F.coalesce("_vector", "_zero"), "_pooled")).drop("_own", "_vector", "_zero", "_pooled")
    type_buckets = F.transform("_type_idx", lambda t: E.hash_bucket(F.col("item_type_idx"), t, n=TYPE_CROSS).cast("int"))
    bucket = E.hash_bucket(F.col("distance_buckets").cast("bigint"), F.coalesce("is_city_search", F.lit(0)), n=DISTANCE_CROSS)
    df = df.withColumns({"_tb": type_buckets, "_db": F.array(bucket.cast("int"))})
    df = E.model_input(df.withColumns({"type_cross": counts_of(F.col("_tb")), "distance_cross": counts_of(F.col("_db"))}), tables["stats"])
    dense = [*E.model_input_columns(), "history_affinity"]
    shifted = lambda c, by: F.transform(c, lambda e: F.struct((e["slot"] + by).alias("slot"), e["value"].alias("value")))
    fixed = F.array(*[F.struct(F.lit(k).alias("slot"), F.col(c).cast("double").alias("value")) for k, c in enumerate(dense)],
                    F.struct((F.col("cityid_idx") + layout.city).alias("slot"), F.lit(1.0).alias("value")))
    entries = F.concat(fixed, shifted("type_cross", layout.types), shifted("distance_cross", layout.distance))
    label = F.when(F.col("target").isin("realised", "booking"), 1).otherwise(0) if "target" in df.columns else F.lit(None).cast("int")
    return df.select(*KEY, *keep, label.alias("label"), *[F.col(c).cast("double").alias(c) for c in dense], "cityid_idx",
                     "type_cross", "distance_cross", entries.alias("entries"))


def as_vectors(df: DataFrame, layout: Layout, crosses: bool = True, out: str = "features") -> DataFrame:
    """``df`` with the Spark ML vector of its slots, assembled from sparse parts in the JVM."""
    from pyspark.ml.feature import CountVectorizerModel, OneHotEncoder, VectorAssembler
    spark = df.sparkSession
    cities = OneHotEncoder(inputCol="cityid_idx", outputCol="_city", dropLast=False)
    df = cities.fit(spark.range(layout.n_cities + 1).select(F.col("id").cast("int").alias("cityid_idx"))).transform(df)
    parts = [*E.model_input_columns(), "history_affinity", "_city"]
    if crosses:
        for name, n in (("type_cross", TYPE_CROSS), ("distance_cross", DISTANCE_CROSS)):
            words = F.flatten(F.transform(name, lambda e: F.array_repeat(e["slot"].cast("string"), e["value"].cast("int"))))
            model = CountVectorizerModel.from_vocabulary([str(k) for k in range(n)], f"_w_{name}", f"_v_{name}")
            df = model.transform(df.withColumn(f"_w_{name}", words)).drop(f"_w_{name}")
            parts.append(f"_v_{name}")
    made = VectorAssembler(inputCols=parts, outputCol=out).transform(df)
    return made.drop("_city", "_v_type_cross", "_v_distance_cross")


def margin(entries: str, coefficients: str, intercept: str) -> Column:
    """The linear score of a row's entries; ``coefficients`` is an array by slot."""
    return F.aggregate(entries, F.col(intercept).cast("double"),
                       lambda a, e: a + e["value"] * F.element_at(F.col(coefficients), e["slot"] + 1))


def probability(m: Column) -> Column:
    return 1 / (1 + F.exp(-m))


def gradients(df: DataFrame, coefficients: DataFrame, reg: float, weights: dict[int, float],
              label: str = "label", p: str = "score") -> DataFrame:
    """(slot, gradient) of the weighted log loss plus ``reg`` / 2 times the squared coefficients.

    ``df`` holds label, the probability ``p`` at the ``coefficients`` (slot, coefficient) and the
    entries. One aggregate over the entries; the intercept is slot -1 and carries no penalty.
    """
    w = F.when(F.col(label) == 1, float(weights[1])).otherwise(float(weights[0]))
    bias = F.array(F.struct(F.lit(-1).alias("slot"), F.lit(1.0).alias("value")))
    rows = df.select(w.alias("_w"), (F.col(p) - F.col(label)).alias("_r"), F.explode_outer(F.concat(bias, "entries")).alias("_e"))
    sums = rows.groupBy(F.col("_e.slot").alias("slot")).agg(F.sum(F.col("_w") * F.col("_r") * F.col("_e.value")).alias("_g"))
    total = df.agg(F.sum(w).alias("_all"))
    out = coefficients.join(sums, "slot", "left").crossJoin(F.broadcast(total))    # one row
    penalty = F.when(F.col("slot") >= 0, reg * F.col("coefficient")).otherwise(0.0)
    return out.select("slot", (F.coalesce("_g", F.lit(0.0)) / F.col("_all") + penalty).alias("gradient"))


def fit_wide(df: DataFrame, layout: Layout, reg: float, weights: dict[int, float], max_iter: int = 300, tol: float = 1e-10):
    """Weighted logistic regression on the sparse vectors (distributed L-BFGS)."""
    from pyspark.ml.classification import LogisticRegression
    w = F.when(F.col("label") == 1, float(weights[1])).otherwise(float(weights[0]))
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=reg, maxIter=max_iter, tol=tol,
                            standardization=False)
    return lr.fit(as_vectors(df, layout).select("features", "label", w.alias("weight")))


def coefficient_table(spark, values, intercept: float) -> DataFrame:
    """(slot, coefficient), the intercept as slot -1."""
    rows = [(-1, float(intercept)), *[(k, float(v)) for k, v in enumerate(values)]]
    return spark.createDataFrame(rows, "slot int, coefficient double")


def weighted_copies(df: DataFrame, weights: dict[int, float], label: str = "label") -> DataFrame:
    """Class weights for a learner without a weight column: each row as often as its class weighs.

    Whole-number weights, every row kept; the copies are made where the rows are (no shuffle), and a
    rare class multiplied by its weight adds about as many rows as the common one has.
    """
    for w in weights.values():
        if w != int(w) or w < 1:
            raise ValueError("class weights must be whole numbers from 1")
    n = F.when(F.col(label) == 1, int(weights[1])).otherwise(int(weights[0]))
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), n))).drop("_copy")


def dense_blocks(df: DataFrame, layout: Layout, weights: dict[int, float]) -> DataFrame:
    """The rows' dense inputs, labels and class weights, packed by batch and written: the fit's passes read nothing else."""
    from pyspark.ml.functions import vector_to_array

    from ..session import materialize
    w = F.when(F.col("label") == 1, float(weights[1])).otherwise(float(weights[0]))
    rows = as_vectors(df, layout, crosses=False).select(
        vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), w.alias("w"))

    def pack(batches):
        import pyarrow as pa
        for b in batches:
            flat = [b.column(0).flatten(), b.column(1), b.column(2)]
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in flat],
                                             ["x", "y", "w"])

    return materialize(rows.mapInArrow(pack, "x binary, y binary, w binary"), "learner_blocks")


def weighted_slope(blocks: DataFrame, sizes: list[int], flat) -> tuple[float, np.ndarray]:
    """Mean weighted cross-entropy of a perceptron (sigmoid units, softmax of two) at the ``flat`` weights, and its gradient.

    Each task works out its blocks' sums; what comes to the driver has the network's size, whatever the rows."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        layers, at = [], 0
        for n, m in zip(sizes, sizes[1:]):
            layers.append((flat[at:at + n * m].reshape(n, m), flat[at + n * m:at + (n + 1) * m]))
            at += (n + 1) * m
        loss = total = 0.0
        slope = np.zeros(len(flat))
        for batch in batches:
            for x, y, w in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                x, y, w = (np.frombuffer(v) for v in (x, y, w))
                acts = [x.reshape(len(y), sizes[0])]
                for matrix, bias in layers[:-1]:
                    acts.append(0.5 * (1 + np.tanh(0.5 * (acts[-1] @ matrix + bias))))     # the sigmoid, without overflow
                out = acts[-1] @ layers[-1][0] + layers[-1][1]
                out -= out.max(axis=1, keepdims=True)
                log_all = np.log(np.exp(out).sum(axis=1))
                side = y.astype(int)
                line = np.arange(len(y))
                loss += float((w * (log_all - out[line, side])).sum())
                total += float(w.sum())
                delta = np.exp(out - log_all[:, None])
                delta[line, side] -= 1
                delta *= w[:, None]
                parts = []
                for k in range(len(layers) - 1, -1, -1):
                    parts.append(np.concatenate([(acts[k].T @ delta).ravel(), delta.sum(axis=0)]))
                    if k:
                        delta = (delta @ layers[k][0].T) * acts[k] * (1 - acts[k])
                slope += np.concatenate(parts[::-1])
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([total]), pa.array([slope.tobytes()], pa.binary())],
                                         ["loss", "total", "slope"])

    rows = blocks.mapInArrow(run, "loss double, total double, slope binary").toArrow().to_pylist()
    total = sum(r["total"] for r in rows)
    return sum(r["loss"] for r in rows) / total, sum(np.frombuffer(r["slope"]) for r in rows) / total


def descend(slope_at, start: np.ndarray, max_iter: int, tol: float = 1e-6, memory: int = 10) -> np.ndarray:
    """The L-BFGS minimum of a function that returns (value, gradient): steps are halved until the value falls enough."""
    x, (value, g) = start, slope_at(start)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for n in range(max_iter):
        d, back = -g, []
        for s, y in reversed(steps):
            back.append(s @ d / (s @ y))
            d = d - back[-1] * y
        if steps:
            s, y = steps[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(back)):
            d = d + s * (a - y @ d / (s @ y))
        size = 1.0 if steps else min(1.0, 1.0 / max(np.linalg.norm(g), 1e-300))
        for _ in range(20):
            new, (new_value, new_g) = x + size * d, slope_at(x + size * d)
            if new_value <= value + 1e-4 * size * (g @ d):
                break
            size /= 2
        else:
            return x
        if (new - x) @ (new_g - g) > 1e-12:      # keeps the curvature positive
            steps = [*steps, (new - x, new_g - g)][-memory:]
        done = abs(value - new_value) <= tol * max(abs(value), abs(new_value))
        x, value, g = new, new_value, new_g
        if done:
            return x
    return x


def fit_deep(df: DataFrame, layout: Layout, hidden: list[int], weights: dict[int, float], seed: int = 42, max_iter: int = 100):
    """Multilayer perceptron on the dense inputs, the affinity and the city one-hot, on the class-weighted loss.

    Spark's perceptron takes no weight column, and copies of the rows cost their class weight in time. The loss over
    ``weighted_copies`` is worked out from each row once, with its weight, by every task over its rows; L-BFGS descends
    it from Spark's own seeded start. The result is Spark's model with the weights found."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.linalg import Vectors
    sizes = [layout.types, *hidden, 2]
    mlp = MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=sizes, seed=seed, maxIter=0)
    blank = df.sparkSession.createDataFrame([(Vectors.dense([0.0] * sizes[0]), 0.0)], ["features", "label"])     # holds the shape
    blocks = dense_blocks(df, layout, weights)
    found = descend(lambda flat: weighted_slope(blocks, sizes, flat), mlp.fit(blank).weights.toArray(), max_iter)
    return mlp.setInitialWeights(Vectors.dense(found)).fit(blank)


def layers_of(sizes: list[int], weights) -> list[dict]:
    """A perceptron's flat weights as one {matrix (inputs x units), bias} for each layer, the matrix by input."""
    out, at = [], 0
    for n, m in zip(sizes, sizes[1:]):
        flat = [float(x) for x in weights[at:at + n * m]]        # units run fastest
        at += n * m
        out.append({"matrix": [flat[i * m:(i + 1) * m] for i in range(n)], "bias": [float(x) for x in weights[at:at + m]]})
        at += m
    return out


def layer_table(spark, layers: list[dict]) -> DataFrame:
    """One row with the layers' matrices and biases: columns m0, b0, m1, b1, ..."""
    cols = {f"{k[0]}{n}": v for n, layer in enumerate(layers) for k, v in layer.items()}
    kinds = ", ".join(f"{c} {'array<array<double>>' if c[0] == 'm' else 'array<double>'}" for c in cols)
    return spark.createDataFrame([tuple(cols.values())], kinds)


def forward(df: DataFrame, layers: DataFrame, n_layers: int, out: str = "score") -> DataFrame:
    """The perceptron's probability of class 1, from its saved layers and the entries below the crosses."""
    df = df.join(F.broadcast(layers))        # one row, of the network's fixed shape
    plus = lambda acc, row, x: F.zip_with(acc, row, lambda a, w: a + w * x)
    n_in = F.size("m0")
    inputs = F.filter("entries", lambda e: e["slot"] < n_in)
    df = df.withColumn("_h", F.aggregate(inputs, F.col("b0"), lambda a, e: plus(a, F.element_at("m0", e["slot"] + 1), e["value"])))
    for k in range(1, n_layers):
        df = df.withColumn("_a", F.transform("_h", lambda x: 1 / (1 + F.exp(-x))))
        df = df.withColumn("_h", F.aggregate(F.arrays_zip("_a", f"m{k}"), F.col(f"b{k}"), lambda a, e: plus(a, e[f"m{k}"], e["_a"])))
    df = df.withColumn(out, 1 / (1 + F.exp(F.element_at("_h", 1) - F.element_at("_h", 2))))      # softmax of two
    return df.drop("_h", "_a", *layers.columns)
