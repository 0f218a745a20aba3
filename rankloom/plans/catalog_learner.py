"""Checked queries of the learners: input slots, gradients, fits, the scoring bundle, ranks, report, stream.

Fitted numbers can't be known to an SQL text. So every step is checked at
coefficients that follow a rule by slot (``RULE``), where SQL works out the same
values, and the two fits are checked by what makes them right: ``ml_wide_fit``
returns, for each slot, whether the gradient of the weighted, penalised loss is
within ``GRADIENT_BOUND`` at the fitted coefficients, and ``ml_deep_fit``, for each
row, whether the saved layers' forward pass gives the fitted model's probability.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import duck_view, view
from ..operators import bundle as B
from ..operators import encode as E
from ..operators import learner as LN
from ..operators import model as M
from ..operators import rank as RK
from ..session import materialize, one_stage, scratch_path
from ..streaming.scoring import score_files
from .catalog_encode import HASH_SQL
from .catalog_features import training
from .catalog_full import full_sql, z_columns
from .registry import LAZY_ORACLES, finish, register

GRADIENT_BOUND = 1e-3
RULE = "((slot * 37) % 101 - 50) / CAST(1000 AS DOUBLE)"
RULE_MATRIX, RULE_BIAS = (lambda n, i, j: ((i * 31 + j * 17 + n * 7) % 23 - 11) / 40.0), (lambda n, j: ((j * 13 + n * 5) % 11 - 5) / 20.0)

_KEPT: dict = {}
_ENTRIES: dict = {}


def trained(spark, sf):
    """(training table, fitted tables, layout), written once a session and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _KEPT:
        with one_stage(spark):
            train = materialize(training(spark, sf), "learner_rows")
        tables = {k: materialize(t, f"learner_{k}") for k, t in LN.fit_tables(train, view(spark, sf, "item_embedding")).items()}
        _KEPT[key] = train, tables, LN.Layout(tables["cities"].count())
    return _KEPT[key]


def frame(spark, sf):
    """``trained`` and the encoded rows, written once too; what scores through a bundle encodes its rows itself."""
    key = (spark.sparkContext.applicationId, sf)
    train, tables, layout = trained(spark, sf)
    if key not in _ENTRIES:
        with one_stage(spark):
            _ENTRIES[key] = materialize(LN.encode_rows(train, tables, layout), "learner_entries")
    return train, tables, layout, _ENTRIES[key]


def rule_coefficients(spark, layout):
    slots = spark.range(-1, layout.size).select(F.col("id").cast("int").alias("slot"))
    return slots.select("slot", F.when(F.col("slot") < 0, F.lit(0.0)).otherwise(F.expr(RULE)).alias("coefficient"))


def rule_layers(layout):
    sizes = [layout.types, *M.DEEP_LAYERS, 2]
    return [{"matrix": [[RULE_MATRIX(n, i, j) for j in range(m)] for i in range(k)], "bias": [RULE_BIAS(n, j) for j in range(m)]}
            for n, (k, m) in enumerate(zip(sizes, sizes[1:]))]


# ---- the same slots in SQL -----------------------------------------------------

def entries_ctes(sample_dir: str) -> str:
    dense = ", ".join(f"CAST({c} AS DOUBLE)" for c in E.model_input_columns())
    n = LN.n_dense()
    ids = ", ".join(f"clicked_itemid_{k}" for k in range(1, 11))
    types = ", ".join(f"clicked_item_type_{k}" for k in range(1, 11))
    cross = HASH_SQL.format(s="concat_ws('_', COALESCE(own.i, 0), CASE WHEN x.t = 0 THEN 0 ELSE COALESCE(seen.i, 0) END)", n=LN.TYPE_CROSS)
    place = HASH_SQL.format(s="concat_ws('_', CAST(CAST(distance_buckets AS BIGINT) AS VARCHAR), CAST(COALESCE(is_city_search, 0) AS VARCHAR))",
                            n=LN.DISTANCE_CROSS)
    numbered = "(SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS i FROM (SELECT DISTINCT {c} FROM f WHERE {c} IS NOT NULL))"
    return f"""WITH f AS MATERIALIZED ({full_sql(sample_dir)}),
emb AS (SELECT itemid, CAST(embedding AS DOUBLE[]) AS v FROM ({duck_view('item_embedding')})),
mv AS (SELECT list(m ORDER BY d) AS v FROM (SELECT d, avg(e) AS m FROM (
         SELECT unnest(v) AS e, generate_subscripts(v, 1) AS d FROM emb) GROUP BY d)),
tv AS {numbered.format(c='item_type')}, cv AS {numbered.format(c='cityid')}, nc AS (SELECT count(*) AS n FROM cv),
z AS (SELECT requestid, itemid, {z_columns()} FROM f),
dense AS (SELECT requestid, itemid, generate_subscripts([{dense}], 1) - 1 AS slot, unnest([{dense}]) AS value FROM z),
vecs AS (SELECT x.requestid, x.itemid, COALESCE(emb.v, mv.v) AS v
           FROM (SELECT requestid, itemid, unnest([{ids}]) AS id FROM f) x LEFT JOIN emb ON emb.itemid = x.id AND x.id <> 0 CROSS JOIN mv),
pool AS (SELECT requestid, itemid, list(m ORDER BY d) AS p FROM (SELECT requestid, itemid, d, avg(e) AS m FROM (
           SELECT requestid, itemid, unnest(v) AS e, generate_subscripts(v, 1) AS d FROM vecs) GROUP BY ALL) GROUP BY ALL),
crossed AS (SELECT x.requestid, x.itemid, {cross} AS b
              FROM (SELECT requestid, itemid, item_type, unnest([{types}]) AS t FROM f) x
              LEFT JOIN tv own ON own.v = x.item_type LEFT JOIN tv seen ON seen.v = x.t),
entries AS MATERIALIZED (SELECT requestid, itemid, CAST(slot AS INT) AS slot, value FROM (
  SELECT * FROM dense
  UNION ALL SELECT f.requestid, f.itemid, {n - 1}, list_dot_product(COALESCE(emb.v, mv.v), p)
              FROM f LEFT JOIN emb USING (itemid) CROSS JOIN mv JOIN pool USING (requestid, itemid)
  UNION ALL SELECT requestid, itemid, {n} + COALESCE(cv.i, 0), 1 FROM f LEFT JOIN cv ON cv.v = f.cityid
  UNION ALL SELECT requestid, itemid, {n + 1} + nc.n + b, count(*) FROM crossed, nc GROUP BY ALL
  UNION ALL SELECT requestid, itemid, {n + 1 + LN.TYPE_CROSS} + nc.n + {place}, 1 FROM f, nc)),
labels AS (SELECT requestid, itemid, rank, CASE WHEN target IN ('realised', 'booking') THEN 1 ELSE 0 END AS label FROM f),
scored AS MATERIALIZED (SELECT requestid, itemid, label, rank, 1 / (1 + exp(-m)) AS score FROM labels JOIN (
  SELECT requestid, itemid, sum(value * ({RULE})) AS m FROM entries GROUP BY ALL) USING (requestid, itemid))"""


def checked(name: str, sql: str):
    """Register with an oracle that selects from the entries' CTEs."""
    LAZY_ORACLES[name] = lambda sample_dir: entries_ctes(sample_dir) + "\n" + sql
    return register(name)


@checked("enc_learner_entries", "SELECT requestid, itemid, slot, value FROM entries")
def q_entries(spark, sf):
    """All slots of the learners' input, the dense ones included."""
    rows = frame(spark, sf)[3]
    return finish(rows.select("requestid", "itemid", F.explode_outer("entries").alias("e")).select("requestid", "itemid", "e.*"))


@checked("enc_cross_indicators", f"SELECT requestid, itemid, slot, value FROM entries WHERE slot >= {LN.n_dense()}")
def q_indicators(spark, sf):
    """What the assembled Spark ML vector holds of the city one-hot and the two crosses."""
    from pyspark.ml.functions import vector_to_array
    _, _, layout, rows = frame(spark, sf)
    cells = LN.as_vectors(rows, layout).select("requestid", "itemid", F.posexplode(vector_to_array("features")).alias("slot", "value"))
    return finish(cells.where((F.col("slot") >= layout.city) & (F.col("value") != 0)))


WEIGHT = f"CASE WHEN label = 1 THEN {M.CLASS_WEIGHTS[1]} ELSE {M.CLASS_WEIGHTS[0]} END"


@checked("ml_wide_gradient", f""", slots AS (SELECT CAST(unnest(range(-1, (SELECT {LN.n_dense() + 1 + LN.TYPE_CROSS + LN.DISTANCE_CROSS} + n FROM nc))) AS INT) AS slot),
g AS (SELECT slot, sum(({WEIGHT}) * (score - label) * value) AS g FROM (SELECT * FROM entries UNION ALL
      SELECT requestid, itemid, -1, 1 FROM labels) JOIN scored USING (requestid, itemid) GROUP BY slot)
SELECT slot, COALESCE(g, 0) / (SELECT sum({WEIGHT}) FROM labels) + CASE WHEN slot >= 0 THEN {M.L2} * ({RULE}) ELSE 0 END AS gradient
  FROM slots LEFT JOIN g USING (slot)""")
def q_gradient(spark, sf):
    """Gradient of the weighted, penalised loss at the rule's coefficients, by slot."""
    _, _, layout, rows = frame(spark, sf)
    c = rule_coefficients(spark, layout)
    return finish(LN.gradients(B.with_score(rows, c), c, M.L2, M.CLASS_WEIGHTS))


def _fitted(spark, sf):
    _, _, layout, rows = frame(spark, sf)
    model = LN.fit_wide(rows, layout, M.L2, M.CLASS_WEIGHTS)
    return rows, layout, LN.coefficient_table(spark, model.coefficients, model.intercept)


@checked("ml_wide_fit", f"""SELECT CAST(unnest(range(-1, (SELECT {LN.n_dense() + 1 + LN.TYPE_CROSS + LN.DISTANCE_CROSS} + n FROM nc))) AS INT) AS slot,
       1 AS optimal""")
def q_wide_fit(spark, sf):
    """The weighted fit on the sparse vectors: whether each slot's gradient vanishes there."""
    rows, _, c = _fitted(spark, sf)
    g = LN.gradients(B.with_score(rows, c), c, M.L2, M.CLASS_WEIGHTS)
    return finish(g.select("slot", (F.abs("gradient") <= GRADIENT_BOUND).alias("optimal")))


def _forward_sql(n: int) -> str:
    """The rule's perceptron, a layer a CTE."""
    sizes = [None, *M.DEEP_LAYERS, 2]
    out = [f", x0 AS (SELECT requestid, itemid, slot AS i, value AS a FROM entries, nc WHERE slot < {n + 1} + nc.n)"]
    for k in range(len(sizes) - 1):
        units = sizes[k + 1]
        total = f"sum(a * (((i * 31 + j * 17 + {k * 7}) % 23 - 11) / CAST(40 AS DOUBLE))) + ((j * 13 + {k * 5}) % 11 - 5) / CAST(20 AS DOUBLE)"
        act = total if k == len(sizes) - 2 else f"1 / (1 + exp(-({total})))"
        out.append(f"x{k + 1} AS MATERIALIZED (SELECT requestid, itemid, j AS i, {act} AS a FROM x{k}, (SELECT unnest(range({units})) AS j) "
                   f"GROUP BY requestid, itemid, j)")
    k = len(sizes) - 1
    return ", \n".join(out).lstrip() + f"""
SELECT requestid, itemid, 1 / (1 + exp(max(CASE WHEN i = 0 THEN a END) - max(CASE WHEN i = 1 THEN a END))) AS score
  FROM x{k} GROUP BY requestid, itemid"""


@checked("ml_deep_forward", _forward_sql(LN.n_dense()))
def q_deep_forward(spark, sf):
    """The tower's forward pass from saved layers, at weights that follow a rule."""
    _, _, layout, rows = frame(spark, sf)
    layers = rule_layers(layout)
    return finish(LN.forward(rows, LN.layer_table(spark, layers), len(layers)).select("requestid", "itemid", "score"))


@checked("ml_deep_fit", "SELECT requestid, itemid, label, 1 AS agrees FROM labels")
def q_deep_fit(spark, sf):
    """The fitted tower: whether its saved layers, read back, give its probability for each row."""
    from pyspark.ml.functions import vector_to_array
    _, _, layout, rows = frame(spark, sf)
    model = LN.fit_deep(rows, layout, M.DEEP_LAYERS, M.CLASS_WEIGHTS, max_iter=40)
    saved = scratch_path(spark, "layers")
    layers = LN.layers_of([layout.types, *M.DEEP_LAYERS, 2], model.weights)
    LN.layer_table(spark, layers).write.parquet(saved)
    want = model.transform(LN.as_vectors(rows, layout, crosses=False)).withColumn("_want", vector_to_array("probability")[1])
    out = LN.forward(want.drop("features", "rawPrediction", "probability", "prediction"), spark.read.parquet(saved), len(layers))
    return finish(out.select("requestid", "itemid", "label", (F.abs(F.col("score") - F.col("_want")) < 1e-9).alias("agrees")))


def rule_bundle(spark, sf) -> B.Bundle:
    """The training run's tables with the rule's coefficients, published and read back."""
    _, tables, layout = trained(spark, sf)
    root = scratch_path(spark, "bundle")
    B.publish(root, tables | {"coefficients": rule_coefficients(spark, layout)})
    return B.Bundle(spark, root)


@checked("ml_score", "SELECT requestid, itemid, label, score FROM scored")
def q_score(spark, sf):
    """Batch scoring of the training table through a published bundle."""
    return finish(rule_bundle(spark, sf).score(trained(spark, sf)[0]).select("requestid", "itemid", "label", "score"))


# equal up to rounding counts as equal, so that the order does not hang on the last bit of a sum
RANKED = """SELECT requestid, itemid, score, row_number() OVER (PARTITION BY requestid ORDER BY round(score, 9) DESC, itemid) AS new_rank,
       row_number() OVER (PARTITION BY requestid ORDER BY rank NULLS LAST, itemid) AS current_rank FROM scored"""


@checked("ml_rank", RANKED)
def q_rank(spark, sf):
    """Ranks inside each request by the bundle's score, the logged rank beside them."""
    s = rule_bundle(spark, sf).score(trained(spark, sf)[0], keep=("rank",)).withColumn("_order", F.round("score", 9))
    return finish(RK.rank_by_score(s, "requestid", "_order", "rank", "itemid")
                  .select("requestid", "itemid", "score", "new_rank", "current_rank"))


@checked("ml_report", """, p AS (SELECT label, round(score, 9) AS s, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS prediction FROM scored),
c AS (SELECT label, prediction, count(*) AS count FROM p GROUP BY ALL),
t AS (SELECT sum(CASE WHEN label = 1 AND prediction = 1 THEN count ELSE 0 END) AS tp,
             sum(CASE WHEN label = 0 AND prediction = 1 THEN count ELSE 0 END) AS fp,
             sum(CASE WHEN label = 1 AND prediction = 0 THEN count ELSE 0 END) AS fn FROM c),
q AS (SELECT tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM t),
r AS (SELECT label, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM p),
a AS (SELECT (sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * sum(1 - label), 0) AS auc FROM r)
SELECT label, prediction, count, precision, recall, 2 * precision * recall / nullif(precision + recall, 0) AS f1, auc FROM c, q, a""")
def q_report(spark, sf):
    """Counts by label and prediction, precision, recall, F1 and the exact AUC of the bundle's scores."""
    pred = rule_bundle(spark, sf).score(trained(spark, sf)[0])
    pred = pred.select("label", F.round("score", 9).alias("score"), F.when(F.col("score") > 0.5, 1).otherwise(0).alias("prediction"))
    return finish(M.report(pred))


@checked("stream_score_bundle", RANKED)
def q_stream_bundle(spark, sf):
    """Newly arrived feature files scored by the bundle inside each micro-batch, and ranked by request."""
    train, bundle = trained(spark, sf)[0], rule_bundle(spark, sf)
    in_dir, out_dir = scratch_path(spark, "bundle_in"), scratch_path(spark, "bundle_out")
    train.repartition(3, "requestid").write.parquet(in_dir)      # a file holds whole requests
    score_files(spark, in_dir, out_dir, scratch_path(spark, "bundle_ckpt"), train.schema,
                lambda batch: bundle.score(batch, keep=("rank",)).drop("entries", "type_cross", "distance_cross"),
                new_order=[F.round("score", 9).desc(), F.col("itemid")])
    return finish(spark.read.parquet(out_dir).select("requestid", "itemid", "score", "new_rank", "current_rank"))
