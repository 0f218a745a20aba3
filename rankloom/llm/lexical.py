"""Operator 13: ranked lexical search with bag deduplication.

1. Items are split into terms; the distinct terms are the vocabulary, numbered.
2. Documents' terms are exploded where they are scanned and joined to the
   vocabulary (broadcast only if its measured size allows). What is left of a
   document is its bag: the sorted numbers of its vocabulary terms, with repeats.
   Repeats and order of all else can't change a score, beyond the length m.
3. Documents with the same bag and m score alike. Bags are hashed (two 64-bit
   hashes), grouped by hash, m and bag itself, and the hashes are verified: if two
   bags ever share one, all are hashed anew with another seed. One row a class is
   left, with its number of documents (which gives each term's document count)
   and its smallest document id.
4. Classes are packed into chunks of about ``CHUNK`` postings and every chunk is
   scored once against each block of ``BLOCK`` items, in numpy over the terms both
   hold, in 64-bit integers. A chunk keeps of each item its ``k`` best classes by
   (score, smallest id): a class behind those can't hold one of the k best documents.
5. Of the classes left for each item the k best are expanded: members by
   ascending id, k at most of each class (the window's limit cuts a group of
   copies down inside each task), and the k best documents are numbered.

Each item row is searched on its own. Defined results: null or term-less texts
are found by nothing and count in no statistic; repeated rows are documents of
their own and come next to each other; null ids come last among equal scores;
an item without terms, or without matches, has no rows; extra columns are not
read. A very long text becomes a bag no longer than itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.encode import dense_index
from .common import materialise, prepare, table
from .terms import LOWER, UPPER, lower_ascii, runs

BREAKS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"   # between terms
TOP = 20
CHUNK = 1 << 18        # postings of a chunk of classes
ROWS = 4096            # classes of a chunk, at most
BLOCK = 256            # items of a block
LAST = np.iinfo(np.int64).max


def _terms(text_col: str):
    return runs(lower_ascii(F.col(text_col)), BREAKS)


def _item_terms(items: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(row, item_id) of the items with terms, and (row, term, repeats)."""
    items = items.select(F.col(item_col).alias("item_id"), _terms(text_col).alias("w")).where(F.size("w") > 0)
    # rows are numbered by what they hold and, among equal rows, by their count
    same = items.groupBy("item_id", "w").agg(F.count(F.lit(1)).alias("c"))
    rows = same.select("item_id", "w", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("copy"))
    key = F.to_json(F.struct("item_id", "copy", "w"), {"ignoreNullFields": "false"})
    rows = materialise(rows.withColumn("key", key), "item-rows")
    number = dense_index(rows, "key", "row", 0)
    rows = materialise(rows.join(number, "key").select("row", "item_id", "w"), "items")
    terms = rows.select("row", F.explode_outer("w").alias("term")).groupBy("row", "term").agg(F.count(F.lit(1)).alias("repeats"))
    return rows.select("row", "item_id"), materialise(terms, "item-terms")


def bags(docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, bag) of each row of ``docs`` that holds a term of the vocabulary (term, number)."""
    split = docs.select(F.col(id_col).alias("doc_id"), _terms(text_col).alias("w"))
    split = split.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.size("w").cast("long").alias("n"), "w")
    words = split.select("_row", "doc_id", "n", F.explode_outer("w").alias("term")).join(vocabulary, "term")
    return words.groupBy("_row", "doc_id", "n").agg(F.sort_array(F.collect_list("number")).alias("bag")).drop("_row")


def classes(members: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """``members`` (doc_id, m, bag) with their class (a, b), and the classes: a, b, m, bag, n_docs, first.

    ``bits`` shortens the hashes, to test that shared ones are found.
    """
    for seed in range(64):
        marks = [F.shiftrightunsigned(F.xxhash64(F.lit(2 * seed + k), "m", "bag"), 64 - bits).alias("ab"[k]) for k in (0, 1)]
        marked = members.select("*", *marks)
        found = materialise(marked.groupBy("a", "b", "m", "bag").agg(
            F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first")), "bag-classes")
        if found.groupBy("a", "b").count().where("count > 1").isEmpty():
            return marked, found
    raise ValueError(f"{bits} bits are too few for the classes")


def _pack(batches):
    """Class rows into chunks: flat (row, term, tf) postings beside the rows' m, hashes and smallest id."""
    held, size = [], 0

    def chunk():
        cols = [pa.concat_arrays([h[k] for h in held]) for k in range(5)]
        lengths = pa.compute.list_value_length(cols[4]).to_numpy(zero_copy_only=False)
        rows, terms = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths), cols[4].flatten().to_numpy()
        order = np.lexsort((rows, terms))        # by term, then row
        rows, terms = rows[order], terms[order].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(rows) != 0) | (np.diff(terms) != 0)]))
        tf = np.diff(np.append(new, len(rows)))
        values = [c.to_numpy(zero_copy_only=False) for c in (cols[0], cols[1], cols[2], cols[3].fill_null(LAST))]
        values += [rows[new], terms[new], tf]
        return pa.RecordBatch.from_arrays([pa.array([v.astype(np.int64).tobytes()], pa.binary()) for v in values],
                                          ["a", "b", "m", "first", "rows", "terms", "tf"])

    for b in batches:
        step = 256
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            held.append([part.column(k) for k in range(5)])
            size += len(part.column(4).flatten())
            if size >= CHUNK or sum(len(h[0]) for h in held) >= ROWS:
                yield chunk()
                held, size = [], 0
    if held:
        yield chunk()


def _score(k: int):
    def best(scores, first, count):
        """The positions of the ``count`` highest scores above 0, smallest ids first among equals."""
        at = np.flatnonzero(scores > 0)
        if len(at) > count:
            least = np.partition(scores[at], len(at) - count)[len(at) - count]
            at = at[scores[at] >= least]
        return at[np.lexsort((first[at], -scores[at]))][:count]

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                one = {c: batch.column(c)[n].as_py() for c in ("a", "b", "m", "first", "rows", "terms", "tf")}
                a, b, m, first, rows, terms, tf = (np.frombuffer(one[c], dtype=np.int64) for c in one)
                entry = batch.column("postings").slice(n, 1).flatten()
                item, term, weight = (entry.field(c).to_numpy().astype(np.int64) for c in ("row", "number", "weight"))
                names, item = np.unique(item, return_inverse=True)
                order = np.argsort(term, kind="stable")
                item, term, weight = item[order], term[order], weight[order]
                part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[rows])
                total = np.zeros((len(names), len(m)), dtype=np.int64)
                known, start = np.unique(term, return_index=True)
                stop = np.append(start[1:], len(term))
                low, high = np.searchsorted(terms, known), np.searchsorted(terms, known, "right")
                for s, e, x, y in zip(start, stop, low, high):
                    if x < y:
                        total[np.ix_(item[s:e], rows[x:y])] += np.outer(weight[s:e], part[x:y])
                for j, name in enumerate(names):
                    at = best(total[j], first, k)
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), name, dtype=np.int32)), pa.array(a[at]), pa.array(b[at]),
                             pa.array(first[at]), pa.array(total[j][at])], ["row", "a", "b", "first", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring documents of each item row."""
    spark = docs.sparkSession
    prepare(spark)
    rows, terms = _item_terms(items, item_col, item_text)
    vocabulary = materialise(dense_index(terms, "term", "number", 0), "vocabulary")
    length = F.size(_terms(text_col)).cast("long")
    counts = docs.select(length.alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("n_docs_all"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms_all"))
    counts = materialise(counts, "corpus-counts")  # one row
    m = F.expr("75 + (25 * n * n_docs_all) div n_terms_all")
    members = materialise(bags(docs, vocabulary, id_col, text_col).join(F.broadcast(counts)).select(
        "doc_id", m.alias("m"), "bag"), "bags")
    members, found = classes(members)
    holders = found.select("n_docs", F.explode_outer(F.array_distinct("bag")).alias("number")).groupBy("number").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * F.col("n_docs_all") + 2.0) / (2.0 * F.col("df") + 1.0))) * F.col("repeats")
    asked = terms.join(vocabulary, "term").join(holders, "number").join(F.broadcast(counts)).select("row", "number", weight.alias("weight"))
    blocks = materialise(asked.groupBy(F.floor(F.col("row") / BLOCK).alias("block")).agg(
        F.collect_list(F.struct("row", "number", "weight")).alias("postings")), "item-blocks")
    chunks = found.select("a", "b", "m", "first", "bag").mapInArrow(
        _pack, "a binary, b binary, m binary, first binary, rows binary, terms binary, tf binary")
    n_blocks = blocks.agg(F.max("block")).first()[0]
    last = F.lit(-1 if n_blocks is None else n_blocks).cast("long")
    visits = chunks.withColumn("block", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0).cast("long"))),
                                                           lambda b: b <= last))).join(blocks, "block").drop("block")
    scored = visits.mapInArrow(_score(k), "row int, a long, b long, first long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "first")
    top = materialise(scored.withColumn("_p", F.row_number().over(order)).where(f"_p <= {k}").select("row", "a", "b", "score"), "top-classes")
    wanted = members.select("a", "b", "doc_id").join(top.select("a", "b").distinct(), ["a", "b"], "left_semi")
    by_id = Window.partitionBy("a", "b").orderBy(F.col("doc_id").asc_nulls_last())
    expanded = wanted.withColumn("_p", F.row_number().over(by_id)).where(f"_p <= {k}").drop("_p")
    final = Window.partitionBy("row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = top.join(expanded, ["a", "b"]).withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return ranked.join(rows, "row").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    terms = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{terms}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
b AS (SELECT row_number() OVER () AS r, item_id, {split} AS w FROM benchmark),
s AS (SELECT count(*) AS N, sum(len(w))::BIGINT AS L FROM d WHERE len(w) > 0),
q AS (SELECT r AS q, term, count(*) AS c FROM (SELECT r, unnest(w) AS term FROM b) GROUP BY ALL),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
v AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * N + 2.0) / (2.0::DOUBLE * df + 1.0)))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
m AS (SELECT r, 75 + (25 * len(w)::BIGINT * N) // L AS m FROM d, s),
x AS (SELECT q, r, sum(c * v.w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM t JOIN q USING (term) JOIN v USING (term) JOIN m USING (r) GROUP BY q, r),
k AS (SELECT q, r, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank
      FROM x JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k JOIN d USING (r) JOIN b ON k.q = b.r WHERE rank <= {TOP}"""
