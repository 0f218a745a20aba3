import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankloom.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k=20):
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        ranked = []
        for i, c, n in held:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in terms(text) if t in c)
            if score > 0:
                ranked.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(ranked)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, row int")
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, term int")
    return sorted((tuple(r) for r in L.search(d, q, **more).collect()), key=str)


def test_random_texts(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 200)
    monkeypatch.setattr(L, "BLOCK", 2)
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice(["the", "a", "of", "x1", "Zug", "é", "b", "c", "d", "e", "f"]) for _ in range(n))
    docs = [(k, text(rng.randint(0, 30))) for k in range(150)]
    docs += [(200 + k, docs[3][1] + " only here") for k in range(60)]    # one bag, many members: other words differ not at all
    docs += [(400 + k, docs[5][1].upper()) for k in range(30)]
    items = [(k, text(rng.randint(1, 9))) for k in range(5)] + [(9, "the the THE zug"), (10, "nowhere"), (11, None), (12, "?!")]
    assert found(spark, docs, items) == brute(docs, items)


def test_ties_repeats_and_odd_texts(spark):
    docs = [(5, "same bag"), (3, "bag same"), (4, "same, bag!"), (4, "same, bag!"), (None, "same bag"), (7, None), (8, ""), (9, "w" * 30_000),
            (10, "wort " * 20_000), (11, "other words"), (12, "[\\]^_ @ `{|}~")]
    items = [(1, "same bag bag"), (1, "same bag bag"), (2, "wort " + "w" * 30_000), (None, "words"), (4, "")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, k=3) == brute(docs, items, 3)


def test_shared_hashes_are_found(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(75).cast("long").alias("m"),
                                    F.array((F.col("id") % 40).cast("int")).alias("bag"))
    marked, classes = L.classes(rows, bits=6)      # 4,096 pairs of hashes for 40 bags: some seeds share one
    assert classes.count() == 40 and marked.select("a", "b").distinct().count() == 40
    with pytest.raises(ValueError):
        L.classes(rows, bits=1)


def test_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one two words text")], "item_id long, text string")
    assert L.search(no_docs, items).count() == 0
    assert L.search(odd_docs, items.limit(0)).count() == 0
    got = L.search(odd_docs, items).collect()
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted((tuple(r) for r in got), key=str) == brute(texts, [(1, "one two words text")])
