import random
import re

import pytest

from rankloom.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, window=10):
    held = {}
    for item, text in items:
        w = words(text)
        t = min(len(w), window)
        for k in range(len(w) - t + 1 if w else 0):
            held.setdefault(tuple(w[k:k + t]), set()).add("null" if item is None else str(item))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for t in {len(g) for g in held}:
            for k in range(len(w) - t + 1):
                if (names := held.get(tuple(w[k:k + t]))):
                    hit |= set(range(k, k + t))
                    found |= names
        out.append((len(w), len(hit), sorted(found), bool(hit)))
    return out


def judged(spark, texts, items, window=10):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.decontaminate(docs, bench, window=window).orderBy("doc_id").collect()
    return [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows]


ITEMS = [(1, "a b c d e f g h i j k l m"), (2, "Short ONE"), (3, "x"), (None, "p q r s t u v w y z"), (5, None), (6, " ,; "),
         (7, "same word " * 12), (8, "a b c d e f g h i j k l m"), (9, "été ÉTÉ 12 été 日本 é f g h i j k")]


def test_edges(spark):
    base = "a b c d e f g h i j k l m".split()
    texts = [None, "", ".,", " ".join(base[:9]), " ".join(base[:10]), " ".join(base[3:]), "0 " + " ".join(base) + " 0 " + " ".join(base[1:11]),
             "short. (one) short", "y x, X", "P-Q-R-S-T-U-V-W-Y-Z", "same word " * 300, "word same " * 5, "word same " * 6,
             "ÉTÉ 12 été 日本 é f g h i j k", "w" * 30_000, "Wort " * 20_000 + "x", "a b c d e f g h i J\x00k"]
    assert judged(spark, texts, ITEMS) == brute(texts, ITEMS)


@pytest.mark.parametrize("seed, window", [(1, 10), (2, 10), (3, 4)])
def test_random_spans(spark, seed, window):
    rng = random.Random(seed)
    word = lambda: rng.choice("aabbcdefgh")  # noqa: E731  few words: spans are shared at many lengths
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 25)))) for k in range(12)]
    texts = []
    for _ in range(60):
        w = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < .7:
            span = rng.choice(items)[1].split()
            a = rng.randint(0, len(span))
            w[rng.randint(0, len(w)):0] = span[a:a + rng.randint(1, 14)]
        texts.append(" ".join(w))
    assert judged(spark, texts, items, window) == brute(texts, items, window)


def test_kept_grams_meet(spark):
    """Every span of the guaranteed length keeps a gram inside it, whatever surrounds it."""
    rng = random.Random(5)
    w = [rng.choice("abc") for _ in range(400)]
    got = D.winnow(spark.createDataFrame([(w,)], "w array<string>"), "w", [10]).first().prints
    k = D.gram_words(10)
    assert all(any(s <= p["at"] <= s + 10 - k for p in got) for s in range(391))
    assert len(got) < 0.6 * len(w)


def test_odd_rows_and_native_plan(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = D.decontaminate(odd_docs, items)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    texts = [r.text for r in odd_docs.collect()]
    got = sorted((r.n_words, r.n_hit, r["items"], r.contaminated) for r in out.collect())
    assert got == sorted(brute(texts, ITEMS))
    assert D.decontaminate(no_docs, items).count() == 0
    clean = D.decontaminate(odd_docs, items.limit(0)).collect()
    assert len(clean) == len(texts) and not any(r.contaminated for r in clean)
