import math
import random
import zlib

import numpy as np

from rankloom.llm import toxicity
from rankloom.llm.common import table


def test_nearest_as_by_all_cosines():
    rnd = random.Random(3)
    vectors = [{t: rnd.randint(1, 4) for t in rnd.sample(range(30), rnd.randint(1, 5))} for _ in range(500)]
    idf = np.array([1 + rnd.random() for _ in range(30)])
    index = toxicity.Index.build(vectors, idf, np.zeros(500), np.ones(500), np.arange(500))

    def unit(v):
        w = {t: n * idf[t] for t, n in v.items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    units = [unit(v) for v in vectors]
    for q in vectors[:40]:
        u = unit(q)
        want = sorted(((sum(u[t] * v.get(t, 0) for t in u), n) for n, v in enumerate(units)), key=lambda x: (-x[0], x[1]))
        last = want[toxicity.NEAREST - 1][0]
        got = [(int(index.ids[n]), s) for n, s in index.nearest(q)]
        assert {n for n, _ in got} == {n for s, n in want if s >= last - 1e-9 and s > 0}
        assert all(abs(s - dict((n, s) for s, n in want)[n]) < 1e-9 for n, s in got)


def test_closed_blocks_hold_no_neighbour(monkeypatch):
    monkeypatch.setattr(toxicity, "HEAVY", 8)
    rnd = random.Random(4)
    topics = [[rnd.randint(0, 299) for _ in range(12)] for _ in range(20)]
    vectors = [{t: rnd.randint(1, 6) for t in rnd.sample(sorted(set(rnd.choice(topics))), 6)} | {n % 8: 3} for n in range(900)]
    idf = np.array([1 + 4 * rnd.random() for _ in range(300)])
    index = toxicity.Index.build(vectors, idf, np.zeros(900), np.ones(900), np.arange(900))
    queries = [toxicity.packed(v) for v in [vectors[int(k)] for k in index.ids]]
    for without in (None, list(range(900))):
        some, every = index.cosines(queries, without=without), index.cosines(queries, None, without)
        assert (some < every - 1e-9).any() and (some <= every + 1e-12).all()  # some blocks stayed closed
        for a, b in zip(some, every):
            assert index.closest(a) == index.closest(b)
    assert not index.cosines(queries, without=list(range(900))).diagonal().any()


def test_held_out_rows_are_found(spark, small_dir):
    sf = small_dir.replace("0.001", "0.1")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(docs, labels)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in toxicity.score_texts(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.doc_id in toxic]
    hits = sum(r.predicted and toxic[r.doc_id] for r in held)
    assert hits / sum(toxic[r.doc_id] for r in held) > 0.8 and hits / sum(r.predicted for r in held) > 0.9
    assert np.mean([(r.score - toxic[r.doc_id]) ** 2 for r in held]) < 0.02
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and left.count() < docs.count()


def test_held_out_labels_are_not_read(spark, small_dir):
    docs, labels = table(spark, small_dir, "documents"), table(spark, small_dir, "labels")
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")),
                                                         1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = (sorted(map(str, toxicity.score_texts(docs, toxicity.fit(docs, x)).collect())) for x in (labels, flipped))
    assert a == b


def test_monotone_fit():
    x, y = toxicity.monotone(np.array([0.1, 0.2, 0.3, 0.9]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert x.tolist() == [0.1, 0.1, 0.2, 0.3, 0.9, 0.9] and all(np.diff(y) >= 0) and all((y > 0) & (y < 1))


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (3, 0), (20, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        got = toxicity.score_texts(odd_docs, toxicity.fit(odd_docs, some)).collect()
        assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_texts(no_docs, toxicity.fit(no_docs, labels)).count() == 0


def test_repeated_ids_give_one_example(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    texts = spark.createDataFrame([(k, t) for k in range(40) for t in ("same words here", f"other words {k} again", None)], "doc_id long, text string")
    ids = toxicity.fit(texts, labels).index.ids.tolist()
    assert sorted(ids) == [k for k in range(40) if zlib.crc32(str(k).encode()) % 3 != 1]


def test_every_example_is_indexed(spark):
    rnd = random.Random(5)
    rows = [(k, " ".join(rnd.sample([f"{n}word" for n in range(200)], 12) + ["vile"] * (k % 10 == 0)), int(k % 10 == 0)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.drop("text"))
    learnt = [k for k, *_ in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    assert sorted(model.index.ids.tolist()) == learnt
    assert set(model.terms) == {w for k, t, _ in rows if k in learnt for w in toxicity.term_counts(t)}
    for r in toxicity.score_texts(df, model).collect():
        assert r.evidence and (r.doc_id not in learnt or (r.evidence[0].id, round(r.evidence[0].cosine, 9)) == (r.doc_id, 1.0))
