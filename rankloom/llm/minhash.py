"""Operator 3: near duplicates by circulant MinHash.

Shingles are mapped to 64-bit values by one fixed random mapping (the first
permutation). A second permutation of the 32-bit circle, shifted by k, gives
coordinate k of the signature, so two permutations stand for all ``COORDS``.
Bands of the signature propose candidates; every link is confirmed by the
exact Jaccard similarity of the full shingle sets.

Skew. Texts with equal sets collapse first (a hot copy group is one node).
Bands are met through an aggregate and a join, never by listing a bucket's
pairs:

1. Each member of a bucket is compared with the bucket's smallest document
   only, and the confirmed links are joined to components.
2. Where a bucket still holds several components, the other members are
   compared across components. Bounds that cannot lose a link remove most of
   them first: shingles no other open document has cannot be shared, so what
   is left limits the size of any partner. The comparison itself happens
   inside the join, which emits links, not pairs.

So each pair that shares a band is either compared or already known to lie in
one component. The number of bands follows from the threshold T: a pair at T
shares no band with probability (1 - T^ROWS)^bands, kept under ``MISS`` (20
bands for 0.85, 29 for 0.8).

Defined results: null, empty and blank texts have no shingles and are their
own component; repeated rows share one; a null id takes no part, has no
component and is kept; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.encode import dense_index
from .common import materialise, slices, table
from .components import connected_components
from .shingles import mix64, shingle_sets
from .sieve import Sieve, without

ROWS = 5
MISS = 1e-5  # chance that a pair at the threshold shares no band
_BLOCK = 1 << 16
_U32 = np.uint32

PRINT_SCHEMA = "n_shingles long, set_a long, set_b long, bands array<long>"


def _permute(x: np.ndarray, shift: int, out: np.ndarray, tmp: np.ndarray) -> np.ndarray:
    """The second permutation (a bijection of 32-bit values) of ``x`` shifted along the circle."""
    np.add(x, _U32(shift), out=out)
    for by, times in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(out, _U32(by), out=tmp)
        np.bitwise_xor(out, tmp, out=out)
        np.multiply(out, _U32(times), out=out)
    np.right_shift(out, _U32(16), out=tmp)
    return np.bitwise_xor(out, tmp, out=out)


def band_count(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def signatures(hashes: np.ndarray, offsets: np.ndarray, coords: int) -> np.ndarray:
    """(sets, coords) minima; every set must have a shingle."""
    n = len(offsets) - 1
    out = np.empty((n, coords), dtype=np.uint32)
    circle = (hashes >> np.uint64(32)).astype(np.uint32)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _BLOCK, "right")) - 1)
        x = circle[offsets[first]:offsets[last]]
        at = offsets[first:last] - offsets[first]
        a, b = np.empty_like(x), np.empty_like(x)
        for k in range(coords):
            out[first:last, k] = np.minimum.reduceat(_permute(x, k, a, b), at)
        first = last
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(sets, bands) 64-bit keys; a key holds its band's number."""
    bands = sig.shape[1] // ROWS
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(40), (len(sig), 1))
    rows = sig.reshape(len(sig), bands, ROWS).astype(np.uint64)
    for k in range(ROWS):
        keys = mix64(keys ^ rows[:, :, k])
    return keys.view(np.int64)


def _prints(id_col: str, bands: int):
    def run(batches):
        for b in slices(batches, text=1):
            hashes, offsets = shingle_sets(b.column(1))
            size = np.diff(offsets)
            some = size > 0
            at = offsets[:-1][some]
            sums = [np.zeros(len(size), np.uint64) for _ in range(2)]
            keys = np.empty((0, bands), np.int64)
            if len(at):
                mixed = mix64(hashes + np.uint64(1))
                sums[0][some] = np.add.reduceat(hashes, at)
                sums[1][some] = np.add.reduceat(mixed, at)
                keys = band_keys(signatures(hashes, np.append(at, len(hashes)), bands * ROWS))
            ends = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size), *[pa.array(s.view(np.int64)) for s in sums], listed],
                [id_col, "n_shingles", "set_a", "set_b", "bands"])
    return run


def _sets(sieve: Sieve):
    def run(batches):
        for b in slices((b.filter(sieve.passes(b.column(0))) for b in batches), text=1):
            hashes, offsets = shingle_sets(b.column(1))
            values = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), values], ["node", "shingles"])
    return run


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) for the documents in ``nodes``, worked out where the texts are read: no text is shuffled.

    The sieve lets a few other documents pass; both callers join the sets with the nodes."""
    return docs.mapInArrow(_sets(Sieve(nodes)), "node long, shingles array<long>")


def _linked(shared, n_a, n_b, percent: int):
    return 100 * shared >= percent * (n_a + n_b - shared)


def confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are similar enough."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialise(full_sets(docs, nodes), "minhash-sets")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(left, "a").join(right, "b")
                 .where(_linked(shared, F.size("sa"), F.size("sb"), percent)).select("a", "b").distinct())


def _across(open_rows: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links between different components among the members of open buckets (band, node, n, comp)."""
    nodes = open_rows.select("node").distinct()
    sets = materialise(full_sets(docs, nodes), "minhash-open-sets")
    held = sets.select("node", F.explode("shingles").alias("s"))
    shared = held.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("s")
    common = (held.join(shared, "s").groupBy("node").agg(F.collect_list("s").alias("common")))
    # a partner shares at most c shingles; ``most`` is the largest size with which that is still a link
    sized = open_rows.join(common, "node").withColumn("c", F.size("common")).withColumn(
        "most", F.floor(((100 + percent) * F.col("c")) / F.lit(percent) - F.col("n")))
    sized = sized.where(f"100 * most >= {percent} * n")  # any partner has that many shingles
    least = sized.groupBy("band").agg(F.min("n").alias("least"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    sized = materialise(sized.join(least.where("lo <> hi").select("band", "least"), "band").where("most >= least")
                             .select("band", "node", "n", "comp", "most", "common"), "minhash-open")
    x, y = sized.alias("x"), sized.alias("y")
    inner = F.size(F.array_intersect("x.common", "y.common"))
    return x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.node") < F.col("y.node"))
                  & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.n") <= F.col("y.most"))
                  & (F.col("y.n") <= F.col("x.most")) & _linked(inner, F.col("x.n"), F.col("y.n"), percent)
                  ).select(F.col("x.comp").alias("a"), F.col("y.comp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id (smallest id linked, itself included) of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    prints = materialise(docs.mapInArrow(_prints("_id", band_count(percent)), f"_id long, {PRINT_SCHEMA}"), "minhash-prints")
    key = ["n_shingles", "set_a", "set_b"]
    classes = materialise(prints.where("n_shingles > 0 AND _id IS NOT NULL").groupBy(*key)
                                .agg(F.min("_id").alias("node"), F.any_value("bands").alias("bands")), "minhash-classes")
    rows = classes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    met = rows.groupBy("band").agg(F.min(F.struct("node", "n")).alias("head"), F.max("node").alias("top"))
    met = met.where("top <> head.node").select("band", "head")
    members = materialise(rows.join(met, "band").where("node <> head.node"), "minhash-members")
    star = (members.where(f"100 * least(n, head.n) >= {percent} * greatest(n, head.n)")
                   .select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct())
    first = materialise(confirm(materialise(star, "minhash-star"), docs, percent), "minhash-links")
    comps = connected_components(first)
    placed = (members.join(comps, "node", "left")
                     .select("band", "node", "n", F.coalesce("component", "node").alias("comp")))
    several = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    open_rows = materialise(placed.join(several.select("band"), "band"), "minhash-open-rows")
    across = materialise(_across(open_rows, docs, percent), "minhash-across")
    joined = connected_components(across)
    place = (comps.join(joined.select(F.col("node").alias("component"), F.col("component").alias("wider")), "component", "left")
                  .select("node", F.coalesce("wider", "component").alias("component"))
                  .unionByName(joined.join(comps, "node", "left_anti")))
    place = classes.select(*key, F.col("node")).join(place, "node", "left").select(
        *key, F.coalesce("component", "node").alias("component_id"))
    return prints.select("_id", *key).join(place, key, "left").select(
        F.col("_id").alias(id_col), "n_shingles",
        F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component; of rows that repeat an id and its text, one.

    Rows that share an id but not the text are documents of their own: the one whose
    text has the smallest hash keeps the id, the others are numbered behind all ids,
    so they yield to any document with an id of its own that they are linked with.
    Rows without an id are kept.
    """
    again = materialise(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
                            .where("n > 1").select(id_col), "minhash-again")
    unique = again.isEmpty()
    named = docs if unique else _numbered(docs, again, id_col, text_col)
    node = id_col if unique else "_node"
    found = near_duplicates(named, percent, node, text_col)
    lost = materialise(found.where(F.col(node) != F.col("component_id")).select(node).distinct(), "minhash-lost")
    kept = without(named, lost)
    if not unique:
        kept = kept.where(F.col(node).isNull()).unionByName(kept.where(F.col(node).isNotNull()).dropDuplicates([node]))
    return kept.select(*docs.columns)


def _numbered(docs: DataFrame, again: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``_node``: the id, or a number behind all ids for the further texts of an id in ``again``."""
    marks = {f"_text_{k}": F.xxhash64(F.lit(k), F.col(text_col)) for k in (1, 2)}
    named = docs.withColumns(marks)
    text = F.struct(*marks)
    texts = named.join(again, id_col, "left_semi").select(F.col(id_col).alias("_id"), text.alias("_t")).distinct()
    first = texts.groupBy("_id").agg(F.min("_t").alias("_first"))
    further = texts.join(first, "_id").where(F.col("_t") != F.col("_first")).select(F.struct("_id", "_t").alias("_key"))
    top = docs.agg(F.max(id_col).alias("_top"))     # one row
    spare = dense_index(further, "_key", "_number").crossJoin(F.broadcast(top)).select(
        F.col("_key._id").alias("_id"), F.col("_key._t").alias("_t"), (F.col("_top") + F.col("_number")).alias("_spare"))
    named = named.join(spare, (F.col(id_col) == F.col("_id")) & (text == F.col("_t")), "left")
    return materialise(named.withColumn("_node", F.coalesce("_spare", F.col(id_col))).drop("_id", "_t", "_spare", *marks), "minhash-numbered")


def op3_minhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"), 85)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
