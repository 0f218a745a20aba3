"""Operator 9: quality rules, one Spark projection built from a threshold table.

Everything is a built-in expression: no user function, no shuffle. A text is
measured where it is scanned, so a hot source or a long text costs no more
than its own length (n log n for its repeated windows).

Defined results: a null or empty text has no words and fails the base rule;
repeated rows are measured once each; extra columns are not read. The id and
text columns are the only ones used, so clashing names elsewhere do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACES

SYMBOLS = "#*$%&|<>"
WINDOW = 5
BASE_MIN_WORDS = 10
BASE_MAX_REPEAT_PCT = 20

# Frequent function words of the corpus languages (en, fr, de, es).
STOP_WORDS = ("the of and to in is that for with was on as by this are be it at from or an "
              "le la les de des et un une du que en dans qui par pour sur est pas avec "
              "der die das und den zu mit von ist ein eine sich nicht auf dem im "
              "el los las del y una por para con se al su lo como más").split()

# (rule, measure, per, least %, most %): fails when 100 * measure lies outside
# [least * per, most * per]; None leaves a side open. ``only`` rows limit a rule
# to texts of at least that many words. Integer arithmetic, so engines agree.
RULES = [
    ("word_length", "word_chars", "n_words", 200, 1200, 0),
    ("symbols", "n_symbols", "n_words", None, 10, 0),
    ("stop_words", "n_stop_words", "n_words", 2, None, 50),
    ("dup_lines", "n_dup_lines", "n_lines", None, 50, 0),
]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words."""
    t = F.col("_t")
    df = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    trimmed = F.btrim(t, F.lit(SPACES))
    df = df.select(
        "_id",
        F.when(F.length(trimmed) > 0, F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
         .otherwise(F.array().cast("array<string>")).alias("_w"),
        F.filter(F.split(t, "\n"), lambda s: s.rlike(NOT_SPACE)).alias("_l"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    w = F.col("_w")
    # a window is its words' hash: one long a window keeps duplicates cheap to find
    windows = F.when(F.size(w) > WINDOW, F.transform(
        F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.select(
        "_id", "word_chars", "n_symbols", F.size(w).cast("long").alias("n_words"), windows.alias("_g"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"))
    # equal windows stand side by side once (hash, position) pairs are sorted
    pairs = F.when(F.size(F.array_distinct("_g")) < F.size("_g"),
                   F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.select("*", pairs.alias("_p")).drop("_g")
    p = F.col("_p")

    def twin(x, i):
        return (F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False)))

    hits = F.sort_array(F.transform(F.filter(p, twin), lambda x: x["i"]))
    covered = F.aggregate(
        hits, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")),
        lambda a: a["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p")


def _breaks(rule) -> Column:
    _, num, per, least, most, only = rule
    bad = F.lit(False)
    if least is not None:
        bad = bad | (100 * F.col(num) < least * F.col(per))
    if most is not None:
        bad = bad | (100 * F.col(num) > most * F.col(per))
    return bad & (F.col("n_words") >= only)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Measures, base_failed, the broken rules' names and kept, one row per input row."""
    df = measure(docs, id_col, text_col)
    base = (F.col("n_words") < BASE_MIN_WORDS) | (
        100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PCT * F.col("n_words"))
    broken = F.array_compact(F.array(*[F.when(_breaks(r), F.lit(r[0])) for r in rules]))
    return df.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                     "n_repeat_words", "n_lines", "n_stop_words", base.alias("base_failed"),
                     broken.alias("broken_rules")
                     ).withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def op9_quality_rules(spark, sf_dir):
    from .common import table
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    """The same measures in DuckDB, with real windows in place of their hashes."""
    sp = "[\\x20\\x09-\\x0D]+"
    stops = ", ".join(f"'{x}'" for x in STOP_WORDS)
    breaks = []
    for _, num, per, least, most, only in RULES:
        side = [f"100 * {num} < {least} * {per}"] if least is not None else []
        side += [f"100 * {num} > {most} * {per}"] if most is not None else []
        breaks.append(f"(({' OR '.join(side)}) AND n_words >= {only})")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  row_number() OVER () AS r FROM documents),
s AS (SELECT doc_id, r, t, list_filter(regexp_split_to_array(t, '{sp}'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{NOT_SPACE}')) AS l FROM d),
g AS (SELECT r, i, list_slice(w, i, i + {WINDOW - 1}) AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM s WHERE len(w) > {WINDOW})),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(least({WINDOW}, i - coalesce(p, i - {WINDOW}))) AS n
      FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM h) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
             list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS wc,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines,
             len(list_filter(w, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM s LEFT JOIN c USING (r)),
v AS (SELECT *, coalesce(wc, 0) AS word_chars,
             n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEAT_PCT} * n_words AS base_failed
      FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR {' OR '.join(breaks)}) AS kept
FROM v"""
