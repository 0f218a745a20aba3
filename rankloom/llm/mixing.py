"""Operator 4: mix sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document
belongs to). A flow network routes each pattern's tokens to the quotas of its
sources; using a document again costs more each time (convex), up to
``MAX_REPEATS``. The flow says how many tokens to take from each pattern, and
documents are then selected by a seeded hash, so reruns agree.

Scale: texts are read once, to count words into a narrow table written to the
shared folder. Only sums for each pattern reach the driver, bounded by
``MAX_PATTERNS`` (more raise an error). Selection never orders a whole
pattern: rows are summed by the top bits of their hash, then the one range at
the cut by further bits (``BITS``), and only what shares all of them is
ordered. The gap left by the first document that no longer fits is filled with
documents after the cut, the largest sizes first, until none of them fits; if
the smallest one left overshoots by less than what is missing, it is taken
too. No step has a limit of its own: what is kept for each pattern is a count
for each document size below twice the gap.

Defined results: null text has size 0; a null source is a source of its own,
last in order; an empty table gives no rows; repeated rows with one id, and ids
whose hashes tie, are taken or left together; a text of any length is one
document; other columns pass through untouched by ``mix``'s
inner names, which start with ``_mix_``.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table, word_count

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
MAX_PATTERNS = 100_000
SEED = 20_240_517
# The hash ranges a cut is narrowed down by: its top 12 bits, then 12 more.
BITS = (52, 40)


def targets(sizes: list[int], weights: list[float], cap: float = MAX_REPEATS) -> list[float]:
    """Share the total by weight; a target stops at ``cap`` times its size and the excess is shared again."""
    out, free, rest = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[k] for k in free)
        over = [k for k in free if rest * weights[k] / total > cap * sizes[k]]
        if not over:
            for k in free:
                out[k] = rest * weights[k] / total
            break
        for k in over:
            out[k] = float(cap * sizes[k])
            rest -= out[k]
        free = [k for k in free if k not in set(over)]
    return out


class Flow:
    """Min-cost flow by shortest augmenting paths with potentials (non-negative costs)."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to, self.room, self.cost = [], [], []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        height = [0] * len(self.arcs)
        while self._lift(source, sink, height):
            while level := self._levels(source, sink, height):
                self._block(source, sink, height, level)

    def _lift(self, source: int, sink: int, height: list[int]) -> bool:
        """Raise the potentials by the shortest distances; False if the sink is out of reach."""
        far, queue, closed = {source: 0}, [(0, source)], set()
        while queue:
            d, x = heapq.heappop(queue)
            if x in closed:
                continue
            closed.add(x)
            for e in self.arcs[x]:
                y = self.to[e]
                if self.room[e] and y not in closed:
                    away = d + self.cost[e] + height[x] - height[y]
                    if away < far.get(y, away + 1):
                        far[y] = away
                        heapq.heappush(queue, (away, y))
        if sink not in far:
            return False
        for x in range(len(height)):
            height[x] += min(far.get(x, far[sink]), far[sink])
        return True

    def _levels(self, source: int, sink: int, height: list[int]) -> list[int] | None:
        """Steps from the source along shortest arcs with room; None if they miss the sink."""
        level = [-1] * len(self.arcs)
        level[source], queue = 0, [source]
        for x in queue:
            for e in self.arcs[x]:
                y = self.to[e]
                if self.room[e] and level[y] < 0 and self.cost[e] + height[x] == height[y]:
                    level[y] = level[x] + 1
                    queue.append(y)
        return level if level[sink] >= 0 else None

    def _block(self, source: int, sink: int, height: list[int], level: list[int]) -> None:
        """Fill every path of these levels, all from one search for distances."""
        at, path, x = [0] * len(self.arcs), [], source
        while True:
            if x == sink:
                push = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= push
                    self.room[e ^ 1] += push
                full = next(n for n, e in enumerate(path) if not self.room[e])
                x = self.to[path[full] ^ 1]
                del path[full:]
            arcs = self.arcs[x]
            while at[x] < len(arcs):
                e = arcs[at[x]]
                y = self.to[e]
                if self.room[e] and level[y] == level[x] + 1 and self.cost[e] + height[x] == height[y]:
                    break
                at[x] += 1
            if at[x] < len(arcs):
                path.append(e)
                x = y
            elif x == source:
                return
            else:
                x = self.to[path.pop() ^ 1]
                at[x] += 1


def route(patterns: dict[tuple, int], quotas: dict, repeats: int = MAX_REPEATS) -> dict[tuple, int]:
    """Tokens to take from each pattern. Patterns that share no source are solved apart."""
    home: dict = {}

    def find(s):
        while home.setdefault(s, s) != s:
            home[s] = home[home[s]]
            s = home[s]
        return s

    for p in patterns:
        for s in p[1:]:
            home[find(p[0])] = find(s)
    groups: dict = {}
    for p in patterns:
        if p:
            groups.setdefault(find(p[0]), []).append(p)
    taken = dict.fromkeys(patterns, 0)
    for group in groups.values():
        names = {s: n for n, s in enumerate(dict.fromkeys(s for p in group for s in p))}
        flow = Flow(2 + len(group) + len(names))
        layers = {}
        for n, p in enumerate(group):
            layers[p] = [flow.arc(0, 2 + n, patterns[p], r * r) for r in range(repeats)]
            for s in p:
                flow.arc(2 + n, 2 + len(group) + names[s], repeats * patterns[p], 0)
        for s, n in names.items():
            flow.arc(2 + len(group) + n, 1, round(quotas[s]), 0)
        flow.run(0, 1)
        for p in group:
            taken[p] = sum(flow.room[e ^ 1] for e in layers[p])
    return taken


def _marks(docs: DataFrame, sources, id_col: str, seed: int) -> dict:
    """Columns the selection works on: pattern and hash of a row."""
    return {"_mix_p": F.to_json(F.array_sort(F.array_distinct(sources))), "_mix_h": F.xxhash64(F.lit(seed), F.col(id_col))}


def first_left(units: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    """Where each group's ``limit`` is used up: keys, ``edge`` and ``gap``.

    ``units`` holds the keys, a hash ``_mix_h`` and an amount ``n``, ``limits`` the keys and a limit.
    In order of the hash, ``edge`` is the first one whose amount no longer fits and ``gap`` what the ones before
    leave. Groups that fit as a whole have no row.
    """
    state = limits.select(*keys, "limit", F.lit(None).cast("long").alias("_mix_r"), F.lit(0).cast("long").alias("_mix_o"))
    inside = units.join(state, keys)
    for bits in BITS:
        part = inside.groupBy(*keys, "limit", "_mix_o", F.shiftright("_mix_h", bits).alias("_mix_s")).agg(F.sum("n").alias("n"))
        upto = part.withColumn("upto", F.col("_mix_o") + F.sum("n").over(Window.partitionBy(*keys).orderBy("_mix_s")))
        state = (upto.where(F.col("upto") > F.col("limit")).groupBy(*keys, "limit")
                     .agg(F.min(F.struct("_mix_s", (F.col("upto") - F.col("n")).alias("o"))).alias("c"))
                     .select(*keys, "limit", F.col("c._mix_s").alias("_mix_r"), F.col("c.o").alias("_mix_o")))
        state = materialise(state, "mix-range")
        inside = units.join(state, keys).where(F.shiftright("_mix_h", bits) == F.col("_mix_r"))
    upto = inside.groupBy(*keys, "limit", "_mix_o", "_mix_h").agg(F.sum("n").alias("n")).withColumn(
        "upto", F.col("_mix_o") + F.sum("n").over(Window.partitionBy(*keys).orderBy("_mix_h")))
    out = (upto.where(F.col("upto") > F.col("limit")).groupBy(*keys)
               .agg(F.min(F.struct("_mix_h", (F.col("limit") - F.col("upto") + F.col("n")).alias("gap"))).alias("c"))
               .select(*keys, F.col("c._mix_h").alias("edge"), F.col("c.gap").alias("gap")))
    return materialise(out, "mix-cut")


def _fill(sized: DataFrame, cut: DataFrame) -> DataFrame:
    """(pattern, hash) of the documents after the cut that fill each pattern's gap."""
    after = sized.join(cut, "_mix_p").where((F.col("_mix_h") >= F.col("edge")) & (F.col("size") > 0) & (F.col("gap") > 0))
    after = after.groupBy("_mix_p", "gap", "_mix_h").agg(F.sum("size").alias("size")).where(F.col("size") < 2 * F.col("gap"))
    after = materialise(after, "mix-after")
    counts = after.groupBy("_mix_p", "gap", "size").agg(F.count(F.lit(1)).alias("n")).groupBy("_mix_p", "gap").agg(
        F.sort_array(F.collect_list(F.struct("size", "n")), False).alias("sizes"))
    fold = F.expr("""aggregate(sizes,
        named_struct('gap', gap, 'spare', cast(null as bigint), 'picks', cast(array() as array<struct<size:bigint,k:bigint>>)),
        (a, x) -> named_struct(
            'gap', a.gap - least(a.gap div x.size, x.n) * x.size,
            'spare', if(a.gap div x.size < x.n, x.size, a.spare),
            'picks', if(a.gap >= x.size,
                        concat(a.picks, array(named_struct('size', x.size, 'k', least(a.gap div x.size, x.n)))), a.picks)))""")
    more = F.expr("if(f.spare - f.gap < f.gap, array(named_struct('size', f.spare, 'k', 1L)), "
                  "cast(array() as array<struct<size:bigint,k:bigint>>))")
    picks = (counts.select("_mix_p", fold.alias("f")).select("_mix_p", F.explode(F.concat("f.picks", more)).alias("x"))
                   .groupBy("_mix_p", F.col("x.size").alias("size")).agg(F.sum("x.k").alias("limit")))
    picks = materialise(picks, "mix-picks")
    units = after.join(picks.select("_mix_p", "size"), ["_mix_p", "size"]).select("_mix_p", "size", "_mix_h", F.lit(1).cast("long").alias("n"))
    edges = first_left(units, picks, ["_mix_p", "size"])
    out = units.join(edges, ["_mix_p", "size"], "left").where("edge IS NULL OR _mix_h < edge")
    return materialise(out.select("_mix_p", "_mix_h", F.lit(True).alias("_mix_fill")), "mix-fill")


def plan_mix(docs: DataFrame, sources, size, weights: dict | None = None, seed: int = SEED,
             id_col: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, rule, fill): the narrow table of all rows, for each pattern what to take, and the hashes that fill the gaps.

    ``sources`` is an array column (a document may belong to several), ``size``
    a count column. ``weights`` maps a source to its weight; without it the
    sources, by code point and null last, weigh 1, 2, 3, repeating.
    """
    spark = docs.sparkSession
    sized = materialise(docs.select(F.col(id_col).alias("_mix_id"), F.coalesce(size, F.lit(0)).cast("long").alias("size"),
                                    *[c.alias(n) for n, c in _marks(docs, sources, id_col, seed).items()]), "mix-sizes")
    sums = sized.groupBy("_mix_p").agg(F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(json.loads(r["_mix_p"])): int(r["n"]) for r in sums}
    keys = {tuple(json.loads(r["_mix_p"])): r["_mix_p"] for r in sums}
    names = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for p, n in patterns.items() if s in p) for s in names}
    weigh = [(weights or {}).get(s, 0 if weights else WEIGHTS[k % len(WEIGHTS)]) for k, s in enumerate(names)]
    quota = dict(zip(names, _scaled(targets([own[s] for s in names], weigh), sum(patterns.values()))))
    take = route(patterns, quota)
    rows = []
    for p, n in patterns.items():
        base = min(MAX_REPEATS, take[p] // n) if n else 0
        first = p[0] if p else None
        rows.append((keys[p], own.get(first, 0), float(quota.get(first, 0.0)), base, take[p] - base * n))
    plan = materialise(spark.createDataFrame(rows, "_mix_p string, source_size long, target double, base long, rest long"), "mix-plan")
    units = sized.select("_mix_p", "_mix_h", F.col("size").alias("n"))
    cut = first_left(units, plan.select("_mix_p", F.col("rest").alias("limit")), ["_mix_p"])
    rule = materialise(plan.join(cut.drop("gap"), "_mix_p", "left"), "mix-rule")
    return sized, rule, _fill(sized, cut)


def _with_repeats(rows: DataFrame, rule: DataFrame, fill: DataFrame) -> DataFrame:
    """``rows`` with their pattern's rule and how often the mix takes them. Both tables were written, so that
    Spark broadcasts them only where their size on disk allows it."""
    more = (F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("_mix_h") < F.col("edge")) | F.col("_mix_fill").isNotNull())
    return (rows.join(rule, "_mix_p").join(fill, ["_mix_p", "_mix_h"], "left")
                .withColumn("repeats", F.col("base") + F.when(more, 1).otherwise(0)))


def mix(docs: DataFrame, sources, size, weights: dict | None = None, seed: int = SEED,
        id_col: str = "doc_id") -> DataFrame:
    """id, size, source_size, target, repeats and taken of every row (see ``plan_mix``).

    For a document of several sources, source_size and target are those of the first.
    """
    sized, rule, fill = plan_mix(docs, sources, size, weights, seed, id_col)
    out = _with_repeats(sized, rule, fill)
    return out.select(F.col("_mix_id").alias(id_col), "size", "source_size", "target", "repeats",
                      (F.col("size") * F.col("repeats")).alias("taken"))


def mixed(docs: DataFrame, sources, size, weights: dict | None = None, seed: int = SEED,
          id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, unchanged."""
    _, rule, fill = plan_mix(docs, sources, size, weights, seed, id_col)
    marks = _marks(docs, sources, id_col, seed)
    packed = docs.select(F.struct("*").alias("_mix_row"), *[c.alias(n) for n, c in marks.items()])
    out = _with_repeats(packed, rule, fill).where("repeats > 0")
    return out.select("_mix_row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("_mix_row.*")


def _scaled(wanted: list[float], total: int) -> list[float]:
    """Overlapping sources count a document more than once; their quotas share the real total."""
    whole = sum(wanted)
    return [w * total / whole for w in wanted] if whole > total * (1 + 1e-9) else wanted


def op4_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mix(docs, F.array("source"), word_count(F.col("text"))).select(
        "doc_id", "size", "source_size", "target", "taken", "repeats")
