"""Operator 11: benchmark decontamination by winnowing, built-in expressions only.

A text's words are hashed, every ``k`` neighbouring hashes make a gram, and of
every ``w`` neighbouring grams the least is kept with its place. Any shared span
of ``k + w - 1`` words holds a whole winnowing window, whose least gram is kept
on both sides, so no shared span of that length is missed. With the window of
10 words ``k`` = 5 and ``w`` = 6; an item of fewer words is one window of its own
length, found by the same rule with its length in place of 10 (one more set of
grams for each such length that the items have, nine at most).

1. items: windows with their text, and their kept grams (written);
2. documents: kept grams exploded where they are scanned, semi-joined to the
   items' grams. The items' side is one row a gram, so a document's hits do not
   multiply, and Spark broadcasts it only if its measured size allows;
3. documents with a hit: every window that holds a hit gram is extended to its
   words and joined to the items' windows by these words themselves, so a hash
   that two grams share by chance finds nothing;
4. items that share a window are named through its class (windows held by the
   same items), so a window that many items share is not multiplied either.

Defined results: a null or wordless text has no words and is clean; a repeated
row gives a repeated result; rows of one id with different texts are judged each
by its own text; repeated item ids are one item, a null item id counts as the
item ``null``; without items every document is clean. Extra columns are not
read. A very long document is hashed where it is scanned; only its hits are
gathered, in one row that is bounded by its own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, table
from .terms import LOWER, UPPER, lower_ascii, runs

WINDOW = 10
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"   # between words, after lower-casing
_PLACE = 15                                       # low bits of a kept gram hold its place in the winnowing window


def gram_words(length: int) -> int:
    """k of a guarantee of ``length`` words; the winnowing window has ``length - k + 1`` grams."""
    return (length + 1) // 2


def _fold(df: DataFrame, name: str, width: int, f) -> DataFrame:
    """Column ``name`` with ``f`` folded over every ``width`` neighbours, by doubling steps."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        df = df.withColumn(name, F.zip_with(name, F.slice(name, step + 1, F.size(name)), f))
        reach += step
    return df.withColumn(name, F.slice(name, 1, F.greatest(F.size(name) - (width - 1), F.lit(0))))


def _kept(least: Column, t: int) -> Column:
    """(t, at, print) where a winnowing window keeps another gram than the one before it, else null."""
    place = lambda v, i: i + F.pmod(v.bitwiseAND(F.lit(_PLACE)) - i, F.lit(_PLACE + 1))
    return F.transform(least, lambda v, i: F.when(
        (i == 0) | (F.get(least, i - 1) != v),
        F.struct(F.lit(t).alias("t"), place(v, i).cast("int").alias("at"), F.shiftright(v, 4).alias("print"))))


# Lists are exploded with explode_outer below: for explode, Spark infers a filter on the list's size,
# pushes it through the projections and works the whole list out once more for it.


def winnow(df: DataFrame, words: str, lengths: list[int]) -> DataFrame:
    """``df`` with ``prints``: the kept grams (t, at, print) of its ``words`` for each guaranteed length t."""
    if max(lengths) - gram_words(max(lengths)) > _PLACE:
        raise ValueError(f"a winnowing window holds at most {_PLACE + 1} grams")
    df = df.withColumn("_h", F.transform(words, lambda x: F.xxhash64(x)))
    kept = []
    for t in lengths:
        k, name = gram_words(t), f"_m{t}"
        df = _fold(df.withColumn(name, F.col("_h")), name, k, lambda a, b: F.xxhash64(a, b))
        df = df.withColumn(name, F.transform(name, lambda g, i: g.bitwiseAND(~_PLACE).bitwiseOR(
            i.cast("long").bitwiseAND(F.lit(_PLACE)))))
        df = _fold(df, name, t - k + 1, lambda a, b: F.least(a, b))
        kept.append(_kept(F.col(name), t))
    return df.withColumn("prints", F.array_compact(F.concat(*kept))).drop("_h", *[f"_m{t}" for t in lengths])


def _windows(words: str, t: Column, starts: Column) -> Column:
    """(at, text) of the windows of t words from each start."""
    return F.transform(starts, lambda s: F.struct(s.alias("at"), F.array_join(F.slice(words, s + 1, t), " ").alias("text")))


class Benchmark:
    """The items' windows, classes and kept grams, written."""

    def __init__(self, items: DataFrame, id_col: str, text_col: str, window: int = WINDOW):
        words = runs(lower_ascii(F.col(text_col)), BREAKS)
        items = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words.alias("w"))
        items = materialise(items.where(F.size("w") > 0).withColumn("t", F.least(F.size("w"), F.lit(window))), "items")
        self.lengths = sorted(r.t for r in items.select("t").distinct().collect())  # at most ``window`` numbers
        starts = F.sequence(F.lit(0), F.size("w") - F.col("t"))
        held = items.select("item", F.explode_outer(_windows("w", F.col("t"), starts)).alias("x")).select("item", "x.text").distinct()
        held = materialise(held, "item-windows")
        mark = [F.bit_xor(F.xxhash64(F.lit(k), F.col("item"))) for k in (1, 2)]
        self.windows = materialise(held.groupBy("text").agg(
            F.struct(F.count(F.lit(1)).alias("n"), mark[0].alias("a"), mark[1].alias("b")).alias("class")), "window-classes")
        self.items = materialise(held.join(self.windows, "text").select("class", "item").distinct(), "class-items")
        prints = items.limit(0).selectExpr("t", "0L AS print")
        for t in self.lengths:
            own = winnow(items.where(F.col("t") == t), "w", [t])
            prints = prints.unionByName(own.select(F.explode_outer("prints").alias("p")).where("p IS NOT NULL").select("p.t", "p.print"))
        self.prints = materialise(prints.distinct(), "item-prints")


def find_hits(docs: DataFrame, bench: Benchmark, text_col: str) -> DataFrame:
    """Of each row of ``docs`` (columns _k, _j: its key) that holds item windows: ``spans`` (at, t) of every one, and ``classes``."""
    docs = docs.select("_k", "_j", runs(lower_ascii(F.col(text_col)), BREAKS).alias("w"))
    found = winnow(docs, "w", bench.lengths).select("_k", "_j", F.explode_outer("prints").alias("p")).select("_k", "_j", "p.*")
    found = found.join(bench.prints, ["t", "print"], "left_semi")
    hits = materialise(found.groupBy("_k", "_j").agg(F.collect_set(F.struct("t", "at")).alias("hits")), "hits")

    def reach(h):  # every start whose window holds the hit gram
        k = F.floor((h["t"] + 1) / 2).cast("int")
        low, high = F.greatest(h["at"] - (h["t"] - k), F.lit(0)), F.least(h["at"], F.size("w") - h["t"])
        return F.transform(F.sequence(low, high), lambda s: F.struct(h["t"].alias("t"), s.alias("at")))

    starts = docs.join(hits, ["_k", "_j"]).select("_k", "_j", "w", F.array_distinct(F.flatten(F.transform("hits", reach))).alias("s"))
    texts = F.transform("s", lambda s: F.struct(s["t"].alias("t"), s["at"].alias("at"),
                                                F.array_join(F.slice("w", s["at"] + 1, s["t"]), " ").alias("text")))
    spans = starts.select("_k", "_j", F.explode_outer(texts).alias("x")).where("x IS NOT NULL").select("_k", "_j", "x.*").join(bench.windows, "text")
    return spans.groupBy("_k", "_j").agg(F.sort_array(F.collect_set(F.struct("at", "t"))).alias("spans"),
                                         F.collect_set("class").alias("classes"))


def covered(spans: str) -> Column:
    """How many words the spans (at, t), sorted, cover together."""
    return F.aggregate(
        spans, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["at"] + s["t"]).alias("end"),
                              (a["n"] + F.greatest(F.lit(0), s["at"] + s["t"] - F.greatest(a["end"], s["at"]))).alias("n")),
        lambda a: a["n"])


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, items (sorted ids as strings), spans (word at, words t), contaminated."""
    key = [F.xxhash64(F.lit(k), F.col(id_col), F.col(text_col)) for k in (1, 2)]
    docs = docs.select(F.col(id_col), F.col(text_col), key[0].alias("_k"), key[1].alias("_j"))
    base = docs.select(id_col, "_k", "_j", F.size(runs(lower_ascii(F.col(text_col)), BREAKS)).cast("long").alias("n_words"))
    bench = Benchmark(items, item_col, item_text, window)
    if not bench.lengths:
        none = F.array().cast("array<string>")
        return base.select(id_col, "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"),
                           F.expr("CAST(array() AS array<struct<at:int,t:int>>)").alias("spans"), F.lit(False).alias("contaminated"))
    hits = materialise(find_hits(docs, bench, text_col), "document-hits")
    named = (hits.select("_k", "_j", F.explode("classes").alias("class")).join(bench.items, "class")
                 .groupBy("_k", "_j").agg(F.sort_array(F.collect_set("item")).alias("items")))
    found = hits.select("_k", "_j", "spans", covered("spans").alias("n_hit")).join(named, ["_k", "_j"])
    return base.join(materialise(found, "document-items"), ["_k", "_j"], "left").select(
        id_col, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.expr("CAST(array() AS array<struct<at:int,t:int>>)")).alias("spans"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def op11_decontamination(spark, sf_dir):
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def oracle() -> str:
    """Every window of every document against every item window, by their words."""
    words = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    lower = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '{words}') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all({lower}, '{words}') AS w FROM benchmark),
i AS (SELECT item, w, least(len(w), {WINDOW}) AS t FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, t, array_to_string(w[k:k + t - 1], ' ') AS x
       FROM (SELECT item, w, t, unnest(range(1, len(w) - t + 2)) AS k FROM i)),
ts AS (SELECT DISTINCT t FROM i),
dw AS (SELECT r, t, k, array_to_string(w[k:k + t - 1], ' ') AS x
       FROM (SELECT r, w, t, unnest(range(1, len(w) - t + 2)) AS k FROM d, ts WHERE len(w) >= t)),
h AS (SELECT r, t, k, x FROM dw WHERE x IN (SELECT x FROM iw)),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(k, k + t)) AS p FROM h) GROUP BY r),
g AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, item FROM h JOIN iw USING (x)) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(g.n, 0)::BIGINT AS n_items,
       sha256(coalesce(g.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN g USING (r)"""
