import itertools
import random

from pyspark.sql import functions as F

from rankloom.llm import mixing
from rankloom.llm.common import word_count


def test_targets():
    assert mixing.targets([10, 10, 40], [1, 2, 3]) == [10.0, 20.0, 30.0]
    got = mixing.targets([1, 1, 58], [1, 2, 3])
    assert got[:2] == [3.0, 3.0] and got[2] == 54.0
    assert mixing.targets([0, 5], [1, 2]) == [0.0, 5.0] and mixing.targets([], []) == []


def test_route_costs_least():
    patterns, quotas = {("a",): 4, ("a", "b"): 3, ("b",): 2}, {"a": 6, "b": 5}
    got = mixing.route(patterns, quotas)
    best = min((sum(r * r for n, t in zip(patterns.values(), take) for r in range(3) for _ in range(max(0, min(n, t - r * n)))), take)
               for take in itertools.product(*[range(3 * n + 1) for n in patterns.values()])
               if sum(take) == 11 and take[0] <= 6 and take[2] <= 5 and sum(take) - take[2] >= 6 and sum(take) - take[0] >= 5)
    cost = sum(r * r for p, n in patterns.items() for r in range(3) for _ in range(max(0, min(n, got[p] - r * n))))
    assert sum(got.values()) == 11 and cost == best[0]


def docs_of(spark, seed=3, n=600):
    rnd = random.Random(seed)
    rows = [(k, "w " * rnd.choice([0, 1, 5, 50, 400]), None if rnd.random() < 0.1 else rnd.choice("aaaabcd")) for k in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def test_taken_words_meet_targets(spark):
    rows, docs = docs_of(spark)
    out = mixing.mix(docs, F.array("source"), word_count(F.col("text")))
    got = out.collect()
    assert len(got) == len(rows) and all(r.taken == r.size * r.repeats and 0 <= r.repeats <= 3 for r in got)
    size = {k: len(t.split()) for k, t, _ in rows}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    own = [sum(size[k] for k, _, s in rows if s == name) for name in names]
    want = dict(zip(names, mixing.targets(own, [mixing.WEIGHTS[k % 3] for k in range(len(names))])))
    source = {k: s for k, _, s in rows}
    for name, n in zip(names, own):
        mine = [r for r in got if source[r.doc_id] == name]
        assert all(r.source_size == n and abs(r.target - want[name]) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - want[name]) <= max(5, 0.01 * want[name])
    again = mixing.mix(docs.repartition(3), F.array("source"), word_count(F.col("text"))).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    times = {r.doc_id: r.n for r in mixing.mixed(docs, F.array("source"), word_count(F.col("text")))
             .groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert times == {r.doc_id: r.repeats for r in got if r.repeats}


def test_overlapping_sources(spark):
    rows = [(k, "w " * 10, ["a"] if k % 3 else ["a", "b"]) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    got = mixing.mix(docs, F.col("sources"), word_count(F.col("text")), {"a": 1.0, "b": 1.0}).collect()
    both = sum(r.taken for r in got if r.doc_id % 3 == 0)
    assert abs(sum(r.taken for r in got) - 3000) <= 20 and both >= 1480


def test_odd_rows(odd_docs, no_docs):
    words = word_count(F.col("text"))
    got = mixing.mix(odd_docs, F.array("source"), words).collect()
    assert len(got) == odd_docs.count() and {r.size for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert mixing.mixed(odd_docs, F.array("source"), words).columns == odd_docs.columns
    assert mixing.mixed(odd_docs, F.array("source"), words).count() == sum(r.repeats for r in got)
    assert mixing.mix(no_docs, F.array("source"), words).count() == 0
    assert mixing.mixed(no_docs, F.array("source"), words).count() == 0


def test_many_patterns_cost_least():
    rnd = random.Random(11)
    for _ in range(40):
        names = "abc"
        patterns = {}
        for _ in range(3):
            patterns[tuple(sorted(rnd.sample(names, rnd.randint(1, 3))))] = rnd.randint(1, 3)
        quotas = {s: rnd.randint(0, 6) for s in names}
        got = mixing.route(patterns, quotas)
        best = None
        for take in itertools.product(*[range(3 * n + 1) for n in patterns.values()]):
            fits = all(sum(t for p, t in zip(patterns, take) if set(p) <= set(some)) <= sum(quotas[s] for s in some)
                       for r in (1, 2, 3) for some in itertools.combinations(names, r))
            if fits:
                cost = sum(r * r for n, t in zip(patterns.values(), take) for r in range(3) for _ in range(max(0, min(n, t - r * n))))
                best = min(best or (0, 0), (-sum(take), cost))
        cost = sum(r * r for p, n in patterns.items() for r in range(3) for _ in range(max(0, min(n, got[p] - r * n))))
        assert (-sum(got.values()), cost) == (best or (0, 0))


def test_no_fitting_document_is_left(spark):
    """Every source ends within half its smallest document left over; thousands of equal small sizes fill one gap."""
    rnd = random.Random(5)
    rows = [(k, "w " * rnd.choice([3] * 40 + [700, 4001]), rnd.choice("aaab")) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(docs, F.array("source"), word_count(F.col("text"))).collect()
    source = {k: s for k, _, s in rows}
    for name in "ab":
        mine = [r for r in got if source[r.doc_id] == name]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2


def test_hash_order_narrowed_by_ranges(spark):
    """Amounts before the edge stay within the limit, and the edge's own no longer fits."""
    rnd = random.Random(9)
    rows = [(g, rnd.randrange(-2**63, 2**63) if n % 3 else rnd.randrange(1 << 40, (1 << 40) + 5000), rnd.randint(0, 4))
            for g in (1, 2, 3) for n in range(900)]
    limits = {1: 0, 2: 777, 3: 10**6}
    units = spark.createDataFrame(rows, "g long, _mix_h long, n long")
    got = {r.g: (r.edge, r.gap) for r in mixing.first_left(
        units, spark.createDataFrame(list(limits.items()), "g long, limit long"), ["g"]).collect()}
    want = {}
    for g, limit in limits.items():
        total = 0
        for h in sorted({h for k, h, _ in rows if k == g}):
            n = sum(n for k, x, n in rows if (k, x) == (g, h))
            if total + n > limit:
                want[g] = (h, limit - total)
                break
            total += n
    assert got == want and 3 not in got
