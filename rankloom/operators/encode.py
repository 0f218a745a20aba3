"""Model-input encoding: vocabularies, lookups, z-scores, one-hot, crossed
hash buckets, embedding lookup / pooling, quantile buckets, statistics.

Statistics and split points are one-row DataFrames joined back as a
broadcast (a single row is a proven bound); vocabularies are joined without
hints so AQE decides from their measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from .ranges import quantile_values, value_ranks

PLATFORMS = ("android_app", "website", "ios_app")   # fixed values: one-hot platform columns

# The 36 numeric model inputs and the 3 flags of the source system
# (item = the source's hotel), z-scored with saved statistics.
NUMERIC_FEATURES = [
    "fprice", "rating", "rcount", "searchtime", "discount_per", "user_abp", "place_popularity_score",
    "item_btod", "item_user_br", "item_user_ctr", "item_user_btod", "avg_item_ctr", "avg_item_btod",
    "stayLength", "abp_price_diff", "item_ctr", "item_br", "item_dtob", "item_place_ctr", "item_place_br",
    "item_place_dtob", "user_cat_ctr", "user_cat_br", "user_cat_dtob", "distance", "item_clicked_rate",
    "cat_clicked_rate", "fprice_ratio", "rating_ratio", "discount_per_ratio", "clicked_fprice_list_10",
    "clicked_rating_list_10", "clicked_distance_list_10", "clicked_distance_list_10_std",
    "clicked_fprice_list_10_std", "clicked_rating_list_10_std"]
FLAG_FEATURES = ["is_weekend_checkin", "is_weekend_searchDate", "is_city_search"]


def column_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: mean and sample stddev of every column, one pass."""
    aggs = []
    for c in cols:
        aggs += [F.avg(_exact(df, c)).cast("double").alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std")]
    return df.agg(*aggs)


def _exact(df: DataFrame, c: str):
    """Integral columns are averaged as decimals (exact sums: an epoch-ms mean
    summed in doubles loses its last digits)."""
    t = df.schema[c].dataType.typeName()
    return F.col(c).cast("decimal(32,6)") if t in ("long", "integer", "short", "byte") else F.col(c)


def column_means(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.avg(_exact(df, c)).cast("double").alias(c) for c in cols])


def column_stddevs(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.stddev_samp(c).alias(c) for c in cols])


NEAR_MEAN = 1e-12  # relative


def zscore(df: DataFrame, stats: DataFrame, cols: list[str], fill: float | None = 0.0) -> DataFrame:
    """(x - mean) / stddev with saved statistics; nulls (and a zero stddev)
    become ``fill`` (0 = the mean). A value within ``NEAR_MEAN`` of the mean is the
    mean: the difference left there is the rounding of the sum, which depends
    on the order of rows."""
    out = df.crossJoin(F.broadcast(stats.select(*[F.col(f"{c}__mean") for c in cols],
                                                *[F.col(f"{c}__std") for c in cols])))
    z = {}
    for c in cols:
        mean = F.col(f"{c}__mean")
        away = F.col(c).cast("double") - mean
        z[c] = F.try_divide(F.when(F.abs(away) <= NEAR_MEAN * F.abs(mean), 0.0).otherwise(away), F.col(f"{c}__std"))
    if fill is not None:
        z = {c: F.coalesce(e, F.lit(fill)) for c, e in z.items()}
    return out.withColumns(z).drop(*[f"{c}__mean" for c in cols], *[f"{c}__std" for c in cols])


def dense_index(values: DataFrame, col: str, name: str = "index", start: int = 1,
                partitions: int | None = None) -> DataFrame:
    """Number the distinct non-null values start, start+1, ... in value order,
    without moving them into one task.

    The distinct values are range-partitioned and sorted inside each range;
    each range counts its rows (one row per partition), the counts become
    offsets (a table of partition-count rows, broadcast), and a value's number
    is its range's offset plus its position in the range. The ranged table is
    written, so the count and the numbering see the same ranges.
    """
    from ..session import materialize
    d = values.select(col).where(F.col(col).isNotNull()).distinct()
    n = partitions or int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (d.repartitionByRange(n, col).sortWithinPartitions(col)
               .select(col, F.spark_partition_id().alias("_pid"),
                       F.monotonically_increasing_id().alias("_mid")))
    ranged = materialize(ranged, "vocabulary")
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (ranged.join(F.broadcast(offsets), "_pid")
                  .select(col, (F.col("_off") + local + start).cast("int").alias(name)))


def vocabulary(values: DataFrame, col: str, name: str = "index") -> DataFrame:
    """Distinct non-null values numbered 1..n in value order; 0 is reserved
    for padding and unknown values (numbered by ranges, see dense_index)."""
    return dense_index(values, col, name, start=1)


def lookup(df: DataFrame, col: str, vocab: DataFrame, out: str | None = None, index: str = "index") -> DataFrame:
    """Map a column through a vocabulary; unknown and null -> 0."""
    out = out or f"{col}_idx"
    v = vocab.select(F.col(vocab.columns[0]).alias("_v"), F.col(index).alias("_i"))
    j = df.join(v, df[col] == v["_v"], "left")
    return j.withColumn(out, F.coalesce(F.col("_i"), F.lit(0))).drop("_v", "_i")


def lookup_array(df: DataFrame, arr: str, vocab: DataFrame, out: str, key: str = "requestid",
                 index: str = "index") -> DataFrame:
    """Map every element of an array column through a vocabulary (unknown,
    null -> 0), keeping positions. Exploded per row key, joined, rebuilt."""
    v = vocab.select(F.col(vocab.columns[0]).alias("_v"), F.col(index).alias("_i"))
    ex = df.select(key, F.posexplode(arr).alias("_pos", "_v"))
    ex = ex.join(v, "_v", "left").withColumn("_i", F.coalesce("_i", F.lit(0)))
    back = ex.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_i"))),
                                           lambda x: x["_i"]).alias(out))
    return df.join(back, key, "left")


def one_hot(df: DataFrame, col: str, values=PLATFORMS) -> DataFrame:
    """One 0/1 column per listed value; anything else is all zeros."""
    return df.withColumns({v: (F.col(col) == v).cast("int") for v in values})


def hash_bucket(*cols, n: int) -> Column:
    """Stable bucket of a crossed value: md5 of the values joined by '_'
    (first 15 hex digits as a number) mod n; nulls are skipped by the join.
    The same text in DuckDB: ('0x' || substr(md5(s), 1, 15))::BIGINT % n."""
    key = F.concat_ws("_", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint"), F.lit(n))


def cross_bucket(df: DataFrame, a: str, b: str, n: int, out: str) -> DataFrame:
    """Crossed feature a x b hashed into n buckets."""
    return df.withColumn(out, hash_bucket(a, b, n=n))


def cross_with_list(df: DataFrame, a: str, arr: str, n: int, out: str) -> DataFrame:
    """Cross the candidate value with each history value, hashed into n
    buckets, and count per bucket: a sparse count vector, as two aligned
    arrays ``<out>_idx`` (ascending buckets) and ``<out>_cnt``.

    Sparse on purpose: at most len(arr) buckets are non-zero, and a dense
    n-slot array built by a per-slot lambda would re-evaluate the history for
    every slot (Catalyst inlines the intermediate column into the lambda)."""
    b = f"_{out}_b"
    df = df.withColumn(b, F.array_sort(F.transform(arr, lambda x: hash_bucket(F.col(a), x, n=n))))
    idx = F.array_distinct(F.col(b))
    cnt = F.transform(idx, lambda d: F.size(F.filter(F.col(b), lambda x: x == d)).cast("bigint"))
    return df.withColumns({f"{out}_idx": idx, f"{out}_cnt": cnt}).drop(b)


def sparse_to_dense(idx, cnt, n: int) -> Column:
    """Dense length-n vector from (index, count) arrays (for small n only)."""
    m = F.map_from_arrays(idx if isinstance(idx, Column) else F.col(idx),
                          cnt if isinstance(cnt, Column) else F.col(cnt))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")),
                       lambda k: F.coalesce(F.element_at(m, k), F.lit(0).cast("bigint")))


def quantile_splits(df: DataFrame, col: str, n: int = 10, accuracy: int | None = None) -> DataFrame:
    """One row ``splits``: -inf, the n-1 inner quantiles, +inf, equal points merged.
    NaN and null are left out of the quantiles. The points are exact order
    statistics, unless an ``accuracy`` asks for an approximate single pass (off by
    1 / accuracy of the rows in rank)."""
    ends = [F.array(F.lit(float(x))) for x in ("-inf", "inf")]
    if accuracy is None:
        q = quantile_values(df, col, n).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))),
                                                        lambda x: x["value"].cast("double")).alias("_q"))
    else:
        q = (df.where(F.col(col).isNotNull() & ~F.isnan(col))
               .agg(F.percentile_approx(col, [i / n for i in range(1, n)], accuracy).cast("array<double>").alias("_q")))
    inner = F.coalesce("_q", F.array().cast("array<double>"))
    return q.select(F.array_distinct(F.concat(ends[0], inner, ends[1])).alias("splits"))


def bucket_by(df: DataFrame, col: str, splits: DataFrame, out: str) -> DataFrame:
    """Bucket index = number of inner split points <= x (0..k-1) by saved ``splits`` (one row); NaN gets
    the extra bucket k (kept), null stays null."""
    j = df.crossJoin(F.broadcast(splits))
    inner = F.slice("splits", 2, F.size("splits") - 2)
    b = F.size(F.filter(inner, lambda t: t <= F.col(col)))
    nb = F.size("splits") - 1
    return j.withColumn(out, F.when(F.col(col).isNull(), F.lit(None))
                         .when(F.isnan(col), nb).otherwise(b).cast("double")).drop("splits")


def quantile_buckets(df: DataFrame, col: str, out: str, n: int = 10, accuracy: int | None = None) -> DataFrame:
    """``bucket_by`` the quantiles of the column itself."""
    return bucket_by(df, col, quantile_splits(df, col, n, accuracy), out)


def quantile_discretizer(df: DataFrame, col: str, out: str, n: int = 10, rel_error: float = 0.001):
    """Spark ML QuantileDiscretizer with invalid values kept (fit + transform)."""
    from pyspark.ml.feature import QuantileDiscretizer
    qd = QuantileDiscretizer(numBuckets=n, inputCol=col, outputCol=out, relativeError=rel_error,
                             handleInvalid="keep")
    return qd.fit(df).transform(df)


def discretizer_splits(df: DataFrame, col: str, n: int = 10, rel_error: float = 0.001) -> list[float]:
    """The n - 1 inner points of the QuantileDiscretizer, before it merges equal ones."""
    return df.approxQuantile(col, [k / n for k in range(1, n)], rel_error)


def rank_errors(df: DataFrame, col: str, splits: list[float], n: int) -> DataFrame:
    """(k, value, rank_error): how far, as a share of the rows, each split's ranks are from k / n (0: its rows include it)."""
    ranked = value_ranks(df, col)
    total = ranked.agg(F.sum("n").alias("_all"))
    points = df.sparkSession.createDataFrame(list(enumerate(splits, 1)), "k int, value double")
    j = points.join(ranked, points["value"] == ranked[col]).crossJoin(F.broadcast(total))
    aim = F.col("k") * F.col("_all") / n
    off = F.greatest(F.lit(0.0), F.col("before_n") + 1 - aim - 1, aim - F.col("before_n") - F.col("n")) / F.col("_all")
    return j.select("k", "value", off.alias("rank_error"))


def mean_vector(emb: DataFrame, col: str = "embedding") -> DataFrame:
    """One row: element-wise mean of all vectors, one average per position."""
    cells = emb.select(F.posexplode(col).alias("_p", "_e")).groupBy("_p").agg(F.avg(F.col("_e").cast("double")).alias("_m"))
    return cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda x: x["_m"]).alias("mean_vector"))


def embedding_table(emb: DataFrame, vocab: DataFrame, id_col: str = "itemid", col: str = "embedding",
                    index: str = "index") -> DataFrame:
    """(index, id, vector); row 0 (padding / unknown, no id) is the mean vector."""
    rows = emb.join(vocab, id_col).select(F.col(index).alias("index"), id_col,
                                          F.col(col).cast("array<double>").alias("vector"))
    none = F.lit(None).cast(emb.schema[id_col].dataType)
    zero = mean_vector(emb, col).select(F.lit(0).alias("index"), none.alias(id_col), F.col("mean_vector").alias("vector"))
    return rows.unionByName(zero)


def pad(arr, n: int = 10, value=0) -> Column:
    """Right-pad an index array to length n with the padding index."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(a), F.lit(0))))


def _once(value: Column, use) -> Column:
    """``use(value)``, the value worked out once a row: Catalyst moves a column that a lambda uses into the lambda, where it
    would be worked out for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pool_history(df: DataFrame, arr_idx: str, table: DataFrame, out: str, key: str = "requestid",
                 n: int = 10, by: str = "index") -> DataFrame:
    """Mean of the vectors of the history, padded to n with index 0
    (the padding row, which is the mean vector, counts in the mean).

    ``by`` names the column of ``table`` (index, vector) that the history holds: its
    index, or the id itself, which saves mapping the history to indices first. What
    is not in the table counts as index 0; it is added as (missing slots) x (row 0), a
    one-row vector, so index 0 is no join key. The list is exploded once, and the
    vectors of a key are summed in the order of their positions.
    """
    zero = table.where(F.col("index") == 0).select(F.col("vector").alias("_zero"))
    known = table.where(F.col("index") != 0).select(F.col(by).alias("_id"), "vector")
    ex = df.select(F.col(key).alias("_key"), F.posexplode(arr_idx).alias("_p", "_id")).join(known, "_id")
    back = ex.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_p", "vector"))).alias("_vs"))
    out_df = df.join(back, df[key] == back["_key"], "left").join(F.broadcast(zero))  # one row
    found = F.coalesce(F.transform("_vs", lambda x: x["vector"]), F.array().cast("array<array<double>>"))
    slots = F.greatest(F.lit(n), F.coalesce(F.size(arr_idx), F.lit(0)))
    padding = lambda k: F.transform("_zero", lambda z: z * k)
    total = _once(found, lambda vs: _once(slots - F.size(vs), lambda k: F.aggregate(
        vs, padding(k), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))))
    return out_df.withColumn(out, _once(slots, lambda s: F.transform(total, lambda x: x / s))).drop("_key", "_vs", "_zero")


def embedding_dot(a: str, b: str) -> Column:
    return dot(a, b)


def model_input_columns() -> list[str]:
    """Order of the dense model input: numerics and flags by name, then the
    platform one-hots (42 columns)."""
    return sorted(NUMERIC_FEATURES + FLAG_FEATURES) + list(PLATFORMS)


def model_input(df: DataFrame, stats: DataFrame) -> DataFrame:
    """The 42 model inputs as columns: z-scored numerics (null -> 0 = the
    mean), flags (null -> 0) and the platform one-hot. Training and scoring
    pass the same saved ``stats`` (one code path for both)."""
    out = zscore(df, stats, NUMERIC_FEATURES)
    out = one_hot(out, "platform").fillna(0, subset=FLAG_FEATURES)
    return out


def assemble_input(df: DataFrame, out: str = "features") -> DataFrame:
    """Spark ML vector of the 42 inputs in ``model_input_columns`` order."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=model_input_columns(), outputCol=out).transform(df)
