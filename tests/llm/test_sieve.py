import numpy as np
import pyarrow as pa

from rankloom.llm import minhash
from rankloom.llm.sieve import Sieve, without


def test_no_id_is_lost_and_few_others_pass(spark):
    ids = spark.range(-3000, 60_000, 3).withColumnRenamed("id", "node")
    sieve = Sieve(ids.unionByName(ids.limit(5)).unionByName(spark.createDataFrame([(None,)], "node long")))
    assert all(sieve.passes(pa.array(np.arange(-3000, 60_000, 3))).to_pylist())
    assert sum(sieve.passes(pa.array(np.arange(100_000, 200_000))).to_pylist()) < 2000
    assert sieve.passes(pa.array([None, 0, None], pa.int64())).to_pylist() == [False, True, False]
    empty = Sieve(ids.limit(0))
    assert not any(empty.passes(pa.array([0, 1, None, -3000])).to_pylist())


def test_without_is_an_anti_join(spark):
    rows = spark.createDataFrame([(k % 50 if k % 7 else None, f"t{k}") for k in range(400)], "doc_id long, text string")
    for ids in (spark.range(0, 50, 4), spark.range(0)):
        ids = ids.withColumnRenamed("id", "doc_id")
        assert sorted(map(str, without(rows, ids).collect())) == sorted(map(str, rows.join(ids, "doc_id", "left_anti").collect()))


def test_texts_of_full_sets_are_not_shuffled(spark):
    """With a node list beyond the broadcast limit every text was shuffled."""
    docs = spark.createDataFrame([(k, f"a b c d e f {k}") for k in range(60)], "_id long, _text string").repartition(3)
    nodes = spark.range(0, 60, 2).withColumnRenamed("id", "node")
    sets = minhash.full_sets(docs, nodes)
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    got = {r.node for r in sets.collect()}
    assert set(range(0, 60, 2)) <= got
