"""Operator 8: toxicity by the nearest labelled examples.

Fit. At most ``EXAMPLES`` labelled ids of each class are drawn by a seeded
hash (a documented bound; labels come only from rows whose crc32 of the id as
text mod 3 is not 1). Every drawn example is kept with all its terms, the
stems of its words; a term weighs its count times its inverse document
frequency, which counts all documents. Labels have no part in the weights.

Score. A text is compared by exact TF-IDF cosine through a block-max inverted
index: similar examples share a block and every term's list holds the largest
component in each block. The commonest terms, a table, give a part of every
cosine; that part and the largest components bound a block, and blocks that
stay below the k-th best of the parts are never opened (ties at the last
of the k best places all count). The neighbours' votes, weighted by closeness,
are mapped to a probability by a monotone curve fitted on the examples
themselves, each left out in turn.

Only the bounded model is broadcast; texts are scored whole, where they are
scanned, without a shuffle. The id is never an input of a score.

Defined results: null and empty texts and those without a known term get the
label share of the examples without terms; repeated rows are scored each; several
labels of one id count as toxic if any says so; an id with several texts gives one
example, its smallest text; without labels of both classes every score is
the share of toxic labels (0 without any); no rows give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, table

EXAMPLES = 3000
NEAREST = 15
THRESHOLD = 0.7
SEED = 11
SHORTEST, STEM = 4, 5  # letters of the shortest words and of a stem
BLOCK = 16  # examples of a block
HEAVY = 512  # terms held as a table, which bounds its size
TOGETHER = 64  # texts scored in one product
ROUNDING = 1e-9  # how far below the k-th best cosine a block's bound may lie and still be opened
PRIOR = 2.0  # weight of the label share in a vote

_WORD = re.compile(r"\w+").findall


def term_counts(text: str | None) -> dict[str, int]:
    """Terms of a text with their counts: the first STEM letters of each lower-cased word of SHORTEST or more."""
    stems: dict[str, int] = {}
    for w, n in Counter(_WORD(text.lower())).items() if text else ():
        if len(w) >= SHORTEST:
            stems[w[:STEM]] = stems.get(w[:STEM], 0) + n
    return stems


def held_out(id_col) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def _known(text: str | None, terms: dict[str, int]) -> dict[int, int]:
    """Number and count of the known terms of a text."""
    return {terms[w]: n for w, n in term_counts(text).items() if w in terms}


def count_known(docs: DataFrame, terms: dict[str, int], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns without it) of every row, with ``_terms`` and ``_counts``: the known terms of its text.

    The texts are tokenised here and nowhere else; document frequencies and scores read the numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    keep = docs.columns if keep is None else keep
    df = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    at = len(keep)

    def run(batches):
        for b in slices(batches, text=at):
            counts = [_known(t, shared.value) for t in b.column(at).to_pylist()]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in counts])]), pa.int32())
            flat = [pa.array([x for c in counts for x in part(c)], pa.int32()) for part in (dict.keys, dict.values)]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], *[pa.ListArray.from_arrays(ends, f) for f in flat]],
                                             [*keep, "_terms", "_counts"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return df.mapInArrow(run, ", ".join([*kinds, "_terms array<int>", "_counts array<int>"]))


def _lists(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, counts) of each row of a batch with ``_terms`` and ``_counts``."""
    terms, counts = batch.column("_terms"), batch.column("_counts")
    ends = np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    flat = [pc.list_flatten(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (terms, counts)]
    return list(zip(*[np.split(f, ends[:-1]) for f in flat]))


def packed(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array(list(counts), dtype=np.int64), np.array(list(counts.values()), dtype=np.int64)


@dataclass
class Index:
    """Examples as unit vectors in a block-max inverted index.

    Examples stand in an order in which similar ones are neighbours, BLOCK of them
    a block. The terms with the longest lists are a table; every other term's list
    is cut at block borders, and an entry is one (term, block) with the largest
    component there and the place of its postings.
    """

    idf: np.ndarray  # weight of each term
    labels: np.ndarray
    weights: np.ndarray
    ids: np.ndarray
    first: np.ndarray  # of each term: its first entry
    block: np.ndarray  # of each entry: its block
    top: np.ndarray  # and its largest component
    open: np.ndarray  # and its first posting
    at: np.ndarray  # examples of the postings
    unit: np.ndarray  # their components
    place: np.ndarray  # of each term: its row in the table, or -1
    table: np.ndarray  # components of the terms with the longest lists, for every example, whole blocks

    @classmethod
    def build(cls, vectors: list[dict[int, int]], idf, labels, weights, ids) -> Index:
        flat = lambda parts: np.array([x for v in vectors for x in parts(v)], dtype=np.int64)
        return cls.packed(np.array([len(v) for v in vectors]), flat(dict.keys), flat(dict.values), idf, labels, weights, ids)

    @classmethod
    def packed(cls, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, idf, labels, weights, ids) -> Index:
        """Of the examples' terms and counts, one example after another; none is empty."""
        n = len(lengths)
        w = counts * idf[terms]
        row = np.repeat(np.arange(n), lengths)
        w /= np.sqrt(np.bincount(row, w * w, n))[row]
        heaviest = terms[np.lexsort((terms, -w, row))]  # each example's terms by falling component
        start = np.cumsum(lengths) - lengths
        order = np.lexsort([heaviest[start + np.minimum(k, lengths - 1)] for k in (2, 1, 0)])
        seat = np.empty(n, dtype=np.int64)
        seat[order] = np.arange(n)
        row = seat[row]
        heavy = np.argsort(-np.bincount(terms, minlength=len(idf)), kind="stable")[:HEAVY]
        place = np.full(len(idf), -1)
        place[heavy] = np.arange(len(heavy))
        table = np.zeros((len(heavy), -(-n // BLOCK) * BLOCK))
        listed = place[terms] < 0
        table[place[terms[~listed]], row[~listed]] = w[~listed]
        terms, row, w = terms[listed], row[listed], w[listed]
        by_term = np.lexsort((row, terms))
        terms, row, w = terms[by_term], row[by_term], w[by_term]
        block = row // BLOCK
        opens = np.flatnonzero(np.append(len(w) > 0, (np.diff(terms) != 0) | (np.diff(block) != 0))[:len(w)])
        first = np.concatenate([[0], np.cumsum(np.bincount(terms[opens], minlength=len(idf)))])
        top = np.maximum.reduceat(w, opens) if len(w) else w
        return cls(idf, labels[order], weights[order], ids[order], first, block[opens], top, np.append(opens, len(w)), row, w,
                   place, table)

    def cosines(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int | None = NEAREST,
                without: list[int] | None = None) -> np.ndarray:
        """(queries, examples) cosines of (terms, counts), exact in every block that may hold one of the k best.

        What the table's terms add is known exactly, and what a block's lists can add at most. Where the two stay below
        the k-th largest of the former, the block is not opened, and holds none of the k best; without ``k`` all are.
        ``without`` names an example for each query that is no neighbour of it.
        """
        inner, lists = np.zeros((len(queries), len(self.table))), []
        for n, (terms, counts) in enumerate(queries):
            w = counts * self.idf[terms]
            w /= np.sqrt((w * w).sum())
            at = self.place[terms]
            inner[n, at[at >= 0]] = w[at >= 0]
            lists.append((terms[at < 0], w[at < 0]))
        out = inner @ self.table
        if without is not None:
            out[np.arange(len(out)), without] = 0
        size = len(self.ids)
        largest = out.reshape(len(out), -1, BLOCK).max(axis=2)
        least = np.partition(out, -k, axis=1)[:, -k] if k is not None and size > k else np.zeros(len(out))
        for n, (terms, w) in enumerate(lists):
            lo, hi = self.first[terms], self.first[terms + 1]
            entry, w = _runs(lo, hi), np.repeat(w, hi - lo)
            block = self.block[entry]
            ceiling = largest[n] + np.bincount(block, self.top[entry] * w, largest.shape[1])
            some = np.flatnonzero((ceiling >= least[n] - ROUNDING)[block])
            entry, w = entry[some], w[some]
            lo, hi = self.open[entry], self.open[entry + 1]
            posting = _runs(lo, hi)
            out[n] += np.bincount(self.at[posting], self.unit[posting] * np.repeat(w, hi - lo), out.shape[1])
        if without is not None:
            out[np.arange(len(out)), without] = 0
        return out[:, :size]

    def nearest(self, counts: dict[int, int], k: int = NEAREST) -> list[tuple[int, float]]:
        """(example, cosine) of the k nearest with a common term, ties at the last place included."""
        return self.closest(self.cosines([packed(counts)], k)[0], k) if counts else []

    @staticmethod
    def closest(score: np.ndarray, k: int = NEAREST) -> list[tuple[int, float]]:
        least = np.partition(score, -k)[-k] - 1e-12 if len(score) > k else 0.0
        found = np.flatnonzero((score >= least) & (score > 0))
        return [(int(n), float(score[n])) for n in found[np.argsort(-score[found], kind="stable")]]


def _runs(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of the ranges lo to hi, one range after another."""
    long = hi - lo
    ends = np.cumsum(long)
    return np.repeat(lo - ends + long, long) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Model:
    terms: dict[str, int]
    index: Index | None
    share: float
    blank: float = 0.0
    steps: tuple = ((), ())  # raw votes and the probability at each

    def raw(self, near: list[tuple[int, float]]) -> float:
        votes = np.array([s * self.index.weights[n] / (1.001 - min(s, 1.0)) for n, s in near])
        labels = self.index.labels[[n for n, _ in near]]
        return float(((votes * labels).sum() + PRIOR * self.share) / (votes.sum() + PRIOR))

    def scores(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[tuple[int, float]]]]:
        """Calibrated score and its evidence (examples and cosines) of each text, given as the numbers and counts of its terms."""
        if self.index is None:
            return [(self.share, [])] * len(counted)
        out = []
        for first in range(0, len(counted), TOGETHER):
            known = counted[first:first + TOGETHER]
            rows = iter(self.index.cosines([c for c in known if len(c[0])]))
            for near in (self.index.closest(next(rows)) if len(c[0]) else [] for c in known):
                out.append((float(np.interp(self.raw(near), *self.steps)), near) if near else (self.blank, []))
        return out


def monotone(raw: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit of labels to raw by pooling neighbours that violate the order: each pool's ends and value."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # toxic weight, weight, least raw, largest raw
    for x, y, w in zip(raw[order], labels[order], weights[order]):
        pools.append([w * y, w, x, x])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] or pools[-2][3] == pools[-1][2]):
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    few = PRIOR * weights.min()
    value = np.maximum.accumulate([(p[0] + 0.5 * few) / (p[1] + few) for p in pools])
    return np.array([x for p in pools for x in p[2:]]), np.repeat(value, 2)


def draw(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> tuple[DataFrame, dict[int, int]]:
    """At most EXAMPLES ids of each class, and how many labels each class has."""
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
                   .where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
                   .groupBy("id").agg(F.max("label").alias("label")))
    known = materialise(known, "toxicity-labels")
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [known.where(F.col("label") == c).orderBy(F.xxhash64(F.lit(SEED), F.col("id")), "id").limit(EXAMPLES)
            for c in (0, 1)]
    return materialise(some[0].unionByName(some[1]), "toxicity-drawn"), total


def vocabulary(examples: DataFrame) -> list[str]:
    """Every term of the examples, sorted."""
    def run(batches):
        for b in slices(batches, text=0):
            yield pa.RecordBatch.from_arrays([pa.array(sorted({w for t in b.column(0).to_pylist() for w in term_counts(t)}),
                                                       pa.string())], ["term"])

    return sorted(examples.select("text").mapInArrow(run, "term string").distinct().toArrow().column(0).to_pylist())


def document_frequencies(counted: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and all documents: partial counts of each task are summed by Spark."""
    def run(batches):
        seen, n = np.zeros(n_terms, dtype=np.int64), 0
        for b in slices(batches, 4096):
            seen += np.bincount(pc.list_flatten(b.column(0)).to_numpy(zero_copy_only=False), minlength=n_terms)
            n += b.num_rows
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(seen[some], n), pa.int64())],
                                         ["term", "n"])

    rows = (counted.select("_terms").mapInArrow(run, "term int, n long")
                   .groupBy("term").agg(F.sum("n").alias("n")).toArrow())
    at, n = rows.column("term").to_numpy(), rows.column("n").to_numpy()
    out = np.zeros(n_terms, dtype=np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return out, int(n[at < 0].sum())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of ``docs`` (texts) and ``labels`` (id, toxic)."""
    return fit_counted(docs, labels, id_col, text_col, [])[0]


def fit_counted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: list[str] | None = None) -> tuple[Model, DataFrame]:
    """The model, and the written rows it counted (``count_known``), ready to be scored."""
    drawn, total = draw(labels, id_col)
    everyone = sum(total.values())
    share = total.get(1, 0) / everyone if everyone else 0.0
    if not total.get(0) or not total.get(1):
        return _nothing(docs, share, text_col, keep)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    examples = texts.join(F.broadcast(drawn), "id")  # at most 2 * EXAMPLES ids
    examples = materialise(examples.groupBy("id", "label").agg(F.min("text").alias("text")), "toxicity-examples")
    drawn_of = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not drawn_of.get(0) or not drawn_of.get(1):
        return _nothing(docs, share, text_col, keep)
    terms = {w: n for n, w in enumerate(vocabulary(examples))}
    counted_docs = materialise(count_known(docs, terms, text_col, keep), "toxicity-terms")
    seen, n_docs = document_frequencies(counted_docs, len(terms))
    idf = np.log((1 + n_docs) / (1 + seen)) + 1
    # the bounded sample with all its terms
    rows = count_known(examples, terms, "text", ["id", "label"]).withColumnsRenamed({"_terms": "terms", "_counts": "counts"}).toArrow()
    lengths = pc.list_value_length(rows.column("terms")).to_numpy()
    labels = rows.column("label").to_numpy()
    weight = {c: total[c] / drawn_of[c] for c in (0, 1)}
    none = {c: weight[c] * int(((lengths == 0) & (labels == c)).sum()) for c in (0, 1)}
    floor = PRIOR * min(weight.values())
    blank = (none[1] + floor * share) / (none[0] + none[1] + floor)
    held = rows.filter(pa.array(lengths > 0))
    if not held.num_rows:
        return _nothing(docs, share, text_col, keep)
    held = held.sort_by("id")
    lengths = pc.list_value_length(held.column("terms")).to_numpy()
    at, counts = (pc.list_flatten(held.column(c)).to_numpy().astype(np.int64) for c in ("terms", "counts"))
    y = held.column("label").to_numpy().astype(np.float64)
    w = np.where(y == 1, weight[1], weight[0])
    index = Index.packed(lengths, at, counts, idf, y, w, held.column("id").to_numpy())
    model = Model(terms, index, share, blank)
    examples = dict(zip(held.column("id").to_numpy().tolist(), zip(*[np.split(x, np.cumsum(lengths)[:-1]) for x in (at, counts)])))
    left_out = []
    for first in range(0, len(y), TOGETHER):
        some = range(first, min(first + TOGETHER, len(y)))  # in the index's order
        score = index.cosines([examples[index.ids[k]] for k in some], without=list(some))
        near = [index.closest(row) for row in score]
        left_out += [model.raw(found) if found else share for found in near]
    model.steps = monotone(np.array(left_out), index.labels, index.weights)
    return model, counted_docs


def _nothing(docs: DataFrame, share: float, text_col: str, keep: list[str] | None) -> tuple[Model, DataFrame]:
    """The model without examples: every text scores ``share``."""
    return Model({}, None, share), count_known(docs, {}, text_col, keep)


def _shared(docs: DataFrame, model: Model):
    """The model without its vocabulary: what scoring needs of it."""
    return docs.sparkSession.sparkContext.broadcast(replace(model, terms={}))


def score_counted(counted: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """id, score, predicted and evidence (nearest examples with their cosine) of every counted row."""
    shared = _shared(counted, model)
    near = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64())]))

    def run(batches):
        m = shared.value
        for b in slices(batches, 256):
            out = m.scores(_lists(b))
            evidence = [[{"id": int(m.index.ids[n]), "cosine": s} for n, s in e[:3]] for _, e in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in out], pa.float64()),
                                              pa.array(evidence, near)], [id_col, "score", "evidence"])

    kind = counted.schema[id_col].dataType.simpleString()
    scored = counted.select(id_col, "_terms", "_counts").mapInArrow(
        run, f"`{id_col}` {kind}, score double, evidence array<struct<id:bigint,cosine:double>>")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score_counted`` of rows that the model has not counted."""
    return score_counted(count_known(docs, model.terms, text_col, [id_col]), model, id_col)


def keep_clean(counted: DataFrame, model: Model) -> DataFrame:
    """The counted rows the model does not call toxic, without the counts."""
    shared = _shared(counted, model)
    columns = [c for c in counted.columns if c not in ("_terms", "_counts")]

    def run(batches):
        for b in slices(batches, 256):
            clean = pa.array([p < THRESHOLD for p, _ in shared.value.scores(_lists(b))], pa.bool_())
            yield b.select(columns).filter(clean)

    return counted.mapInArrow(run, counted.select(*columns).schema)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` the model does not call toxic, unchanged."""
    return keep_clean(count_known(docs, model.terms, text_col), model)


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model, counted = fit_counted(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
    return score_counted(counted, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
