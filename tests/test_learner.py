"""The learners' input, their optimality, and the scoring bundle."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rankloom.operators import bundle as B
from rankloom.operators import learner as LN
from rankloom.operators import model as M
from rankloom.plans import catalog_learner as CL


@pytest.fixture(scope="module")
def parts(spark, small_dir):
    return CL.frame(spark, small_dir)


def test_vectors_hold_the_entries(spark, parts):
    _, _, layout, rows = parts
    v = LN.as_vectors(rows, layout)
    sizes = v.select(vector_to_array("features").alias("a"), "entries").collect()
    assert sizes
    for r in sizes:
        assert len(r.a) == layout.size == len(layout.names())
        want = {e.slot: e.value for e in r.entries}
        assert len(want) == len(r.entries) and all(abs(x - want.get(k, 0.0)) < 1e-12 for k, x in enumerate(r.a))
        assert sum(x for x in r.a[layout.types:layout.distance]) == 10 and sum(r.a[layout.distance:]) == 1
        assert sum(r.a[layout.city:layout.types]) == 1
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_unseen_values_fall_on_slot_zero(spark, parts):
    train, tables, layout, _ = parts
    new = train.limit(1).withColumns({"cityid": F.lit(10 ** 6), "item_type": F.lit(10 ** 6), "itemid": F.lit(-5).cast("bigint"),
                                      "clicked_itemid_1": F.lit(-7).cast("bigint"), "distance": F.lit(None).cast("double")})
    (r,) = LN.encode_rows(new, tables, layout).collect()
    assert {e.slot: e.value for e in r.entries}[layout.city] == 1.0 and r.history_affinity is not None


def test_gradient_is_the_slope_of_the_loss(spark, parts):
    """Central differences of the weighted, penalised loss at a few slots."""
    _, _, layout, rows = parts
    c = {r.slot: r.coefficient for r in CL.rule_coefficients(spark, layout).collect()}
    weights, reg = M.CLASS_WEIGHTS, M.L2

    def loss(shift):
        import math
        total = weight = 0.0
        for r in data:
            m = c[-1] + shift.get(-1, 0) + sum(e.value * (c[e.slot] + shift.get(e.slot, 0)) for e in r.entries)
            w = weights[r.label]
            weight += w
            total += w * (math.log1p(math.exp(-m)) if r.label else math.log1p(math.exp(m)))
        return total / weight + reg / 2 * sum((v + shift.get(k, 0)) ** 2 for k, v in c.items() if k >= 0)

    data = rows.select("label", "entries").collect()
    table = CL.rule_coefficients(spark, layout)
    g = {r.slot: r.gradient for r in LN.gradients(B.with_score(rows, table), table, reg, weights).collect()}
    for slot in (-1, 0, 7, layout.city + 3, layout.types + 5, layout.size - 1):
        h = 1e-5
        assert abs((loss({slot: h}) - loss({slot: -h})) / (2 * h) - g[slot]) < 1e-6, slot


def test_copies_weigh_like_weights(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (0, 3.0)], "label int, x double")
    out = LN.weighted_copies(df, {0: 2.0, 1: 5.0}).groupBy("x").count().collect()
    assert {r.x: r["count"] for r in out} == {1.0: 2, 2.0: 5, 3.0: 2}
    with pytest.raises(ValueError):
        LN.weighted_copies(df, {0: 1.0, 1: 0.5})


def test_bundle_reloads_in_another_session(spark, parts, tmp_path):
    train, tables, layout, rows = parts
    model = LN.fit_wide(rows, layout, M.L2, M.CLASS_WEIGHTS, max_iter=10)
    deep = LN.fit_deep(rows, layout, [4], {0: 1, 1: 2}, max_iter=5)
    p = lambda m, crosses: {(r.requestid, r.itemid): r.p for r in m.transform(LN.as_vectors(rows, layout, crosses)).select(
        "requestid", "itemid", vector_to_array("probability")[1].alias("p")).collect()}
    want, want_deep = p(model, True), p(deep, False)
    root = str(tmp_path / "bundle")
    c = LN.coefficient_table(spark, model.coefficients, model.intercept)
    first = B.publish(root, tables | {"coefficients": c}, deep)

    other = spark.newSession()
    loaded = B.Bundle(other, root)
    assert loaded.manifest.version == first and loaded.manifest.number == 1
    again = other.read.schema(train.schema).parquet(*train.inputFiles())
    got = {(r.requestid, r.itemid): r.score for r in loaded.score(again).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    encoded = loaded.encode(again)
    far = loaded.deep().transform(LN.as_vectors(encoded, loaded.layout, crosses=False))
    for r in far.select("requestid", "itemid", vector_to_array("probability")[1].alias("p")).collect():
        assert abs(r.p - want_deep[(r.requestid, r.itemid)]) < 1e-12

    # a publication that stops before its manifest is not seen; a finished one is, and versions stay readable
    with pytest.raises(ValueError):
        B.publish(root, {k: v for k, v in tables.items() if k != "types"})
    tables["stats"].write.parquet(f"{root}/versions/broken/stats")
    assert B.Bundle(other, root).manifest.version == first
    second = B.publish(root, tables | {"coefficients": CL.rule_coefficients(spark, layout)})
    assert B.Bundle(other, root).manifest.version == second and B.Bundle(other, root, first).manifest.number == 1
    with pytest.raises(FileNotFoundError):
        B.Bundle(other, str(tmp_path / "nothing"))


def test_deep_fit_weighs_rows_without_copies(spark, parts, monkeypatch):
    """The weighted loss and its slope are those of the copied rows; the fit lowers it and makes no copies."""
    import numpy as np
    _, _, layout, rows = parts
    weights, sizes = {0: 1.0, 1: 5.0}, [layout.types, 4, 2]
    flat = np.random.Generator(np.random.PCG64(3)).normal(size=sum((n + 1) * m for n, m in zip(sizes, sizes[1:]))) / 4
    blocks = LN.dense_blocks(rows, layout, weights)
    value, slope = LN.weighted_slope(blocks, sizes, flat)
    copied = LN.dense_blocks(LN.weighted_copies(rows, weights), layout, {0: 1.0, 1: 1.0})
    same, same_slope = LN.weighted_slope(copied, sizes, flat)
    assert abs(value - same) < 1e-9 and np.allclose(slope, same_slope, atol=1e-9)
    for k in (0, 17, len(flat) - 1):
        step = np.zeros(len(flat))
        step[k] = 1e-5
        up, down = (LN.weighted_slope(blocks, sizes, flat + s)[0] for s in (step, -step))
        assert abs((up - down) / 2e-5 - slope[k]) < 1e-6
    monkeypatch.setattr(LN, "weighted_copies", lambda *a: pytest.fail("copied"))
    model = LN.fit_deep(rows, layout, [4], weights, max_iter=10)
    start = LN.fit_deep(rows, layout, [4], weights, max_iter=0)
    after, before = (LN.weighted_slope(blocks, sizes, m.weights.toArray())[0] for m in (model, start))
    assert after < before


def test_scoring_does_not_encode_the_training_table_first(spark, small_dir, monkeypatch):
    made, real = [], CL.materialize
    monkeypatch.setattr(CL, "_KEPT", {})
    monkeypatch.setattr(CL, "_ENTRIES", {}, raising=False)
    train, tables, layout, _ = CL.frame(spark, small_dir)
    monkeypatch.setattr(CL, "training", lambda *a: train)
    monkeypatch.setattr(CL, "materialize", lambda df, name: made.append(name) or real(df, name))
    CL._KEPT.clear()
    CL._ENTRIES.clear()
    assert CL.q_score(spark, small_dir).count() == train.count()
    assert "learner_rows" in made and "learner_entries" not in made
