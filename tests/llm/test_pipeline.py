import corpus_pipeline as C
from rankloom.llm import pii
from rankloom.llm.common import materialise


def through(spark, docs, sf_dir):
    out = []
    for name, stage in C.STAGES:
        after = stage(spark, docs, sf_dir)
        out.append((name, docs, after := materialise(after, "stage")))
        docs = after
    return out


def test_stages(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    steps = through(spark, docs, small_dir)
    assert [n for n, *_ in steps] == ["toxicity", "near_duplicates", "personal_data", "mixing", "token_ids"]
    for _, before, after in steps[:-1]:
        assert after.dtypes == docs.dtypes
    assert steps[1][2].count() == steps[1][2].select("doc_id").distinct().count() < steps[1][1].count()
    assert not [r for r in steps[2][2].collect() if pii.base_spans(r.text)]
    assert steps[4][2].count() == steps[4][1].count()
    assert sorted(map(str, C.run(spark, small_dir).collect())) == sorted(map(str, steps[4][2].collect()))


def test_odd_and_empty_tables(spark, odd_docs, no_docs, small_dir):
    for docs in (odd_docs, no_docs):
        for _, _, after in through(spark, docs, small_dir):
            after.count()
