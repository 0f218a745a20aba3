import random
import re

import numpy as np
import pyarrow as pa

from rankloom.llm import minhash
from rankloom.llm.components import connected_components
from rankloom.llm.shingles import shingle_sets


def brute(rows, percent):
    word, lower = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = word.findall((t or "").translate(lower))
        sets.append((i, frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def texts(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(25):
        base = rnd.choices(vocabulary, k=rnd.choice([3, 5, 8, 40, 120]))
        for _ in range(rnd.choice([1, 1, 2, 30])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 6])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            out.append((" ".join(copy).upper() if rnd.random() < 0.2 else "\t".join(copy)))
    return out


def test_same_components_as_all_pairs(spark):
    for seed, percent in ((1, 85), (2, 80)):
        rows = list(enumerate([None, "", "  ", *texts(seed)], start=10))
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
        got = sorted(tuple(r) for r in minhash.near_duplicates(df, percent).collect())
        assert got == brute(rows, percent)


def test_shingles_equal_only_for_equal_words():
    a, off = shingle_sets(pa.array(["a b c d e", "A\tB  c d e ", "ab c d e f", "a b", "a  b", "b a", None, "", "abcde"]))
    s = [a[off[k]:off[k + 1]].tolist() for k in range(len(off) - 1)]
    assert s[0] == s[1] != s[2] and s[3] == s[4] != s[5] and s[6] == s[7] == [] and len(s[8]) == 1
    sliced, o2 = shingle_sets(pa.array(["zz", "a b c d e", "b a"]).slice(1))
    assert sliced[o2[0]:o2[1]].tolist() == s[0] and sliced[o2[1]:o2[2]].tolist() == s[5]


def test_signature_estimates_similarity():
    rnd = np.random.Generator(np.random.PCG64(5))
    common, a, b = (rnd.integers(0, 2 ** 64, n, dtype=np.uint64) for n in (600, 200, 200))
    sets = [np.concatenate([common, a]), np.concatenate([common, b])]
    sig = minhash.signatures(np.concatenate(sets), np.array([0, 800, 1600]), 400)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.08
    assert minhash.band_count(85) == 20 and minhash.band_count(80) == 29


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 90, 90: 90, 95: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd_docs, no_docs):
    got = {(r.doc_id, r.component_id, r.n_shingles) for r in minhash.near_duplicates(odd_docs).collect()}
    assert (0, 0, 0) in got and (1, 1, 0) in got and (5, 5, 1) in got and (6, 6, 1) in got and (21, 20, 5) in got
    assert (None, None, 1) in got
    kept = minhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([*range(8), 20, None], key=str)  # 21 copies 20, and 1 is there twice
    assert minhash.near_duplicates(no_docs).count() == 0 and minhash.drop_near_duplicates(no_docs).count() == 0


def test_an_id_with_two_texts_loses_neither(spark):
    one, other = "alpha beta gamma delta epsilon zeta eta", "quite a different text about nothing at all"
    rows = [(1, one), (2, one), (2, other), (2, other), (3, "a third text of more than five words"), (3, one), (4, other), (5, None), (5, ""),
            (None, one), (7, "short")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_shingles string")
    got = sorted(((r.doc_id, r.text) for r in minhash.drop_near_duplicates(df).collect()), key=str)
    # document 2's other text yields to document 4, which says the same under an id of its own, or stays
    for text in (one, other, "a third text of more than five words"):
        assert sum(1 for i, t in got if t == text and i is not None) == 1, (text, got)
    assert (None, one) in got and (7, "short") in got and (5, None) in got and (5, "") in got
    assert minhash.drop_near_duplicates(df).columns == df.columns


def test_three_rows_of_the_verdict(spark):
    df = spark.createDataFrame([(1, "same words here in both rows"), (2, "same words here in both rows"), (2, "none of the other text")],
                               "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash.drop_near_duplicates(df).collect())
    assert got == [(1, "same words here in both rows"), (2, "none of the other text")]
