"""Item -> place distance: the most converting place within a radius, else
the nearest place.

No item x place cross product. Points go onto the unit sphere.

* all pairs within a radius: a 3-D grid of cell size h puts every place closer
  than chord h to an item into the item's 3x3x3 neighbourhood. Places are copied
  into the 27 neighbour cells (the place table is the small side) and joined to
  items on the cell id: a merge join, in which a crowded cell's items are
  dealt into parts. The result is as large as the pairs are many.
* the best place: a tree of cells, each cut into 2 x 2 x 2 on the next level, empty
  ones left out. Cells of items and cells of places descend together; a place
  cell stays with an item cell if the best rank it can give is not behind a rank
  that some other cell is sure to give. The rank is conversion first inside the radius,
  distance outside it, so one descent serves both. The level at which
  it ends follows the crowding of the places, so an item meets a handful of
  places however many there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_KM, haversine_km
from ..session import materialize
from .assemble import dedup_key

DEPTH = 20          # levels of the cell tree, 12 m at the deepest
LEAF_PLACES = 2     # points in the cell of a place, on average, at the level the lists are made for
START_PAIRS = 250_000
BROADCAST_PLACES = 200_000     # about 8 MB of lists
PART_ITEMS = 4096   # items of a cell that meet its places in one part
OFFSETS = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]


def chord(km: float) -> float:
    return 2 * math.sin(min(km / (2 * EARTH_RADIUS_KM), math.pi / 2))


def _xyz(df: DataFrame, lat: str, lng: str) -> DataFrame:
    la, lo = F.radians(F.col(lat)), F.radians(F.col(lng))
    return df.withColumns({"_x": F.cos(la) * F.cos(lo), "_y": F.cos(la) * F.sin(lo), "_z": F.sin(la)})


def _cells(df: DataFrame, h: float) -> DataFrame:
    return df.withColumns({f"_c{a}": F.floor(F.col(f"_{a}") / h).cast("bigint") for a in "xyz"})


def _spread(places: DataFrame, h: float) -> DataFrame:
    """Each place into its 27 neighbour cells."""
    off = F.explode(F.array(*[F.array(F.lit(a), F.lit(b), F.lit(c)) for a, b, c in OFFSETS]))
    p = _cells(places, h).withColumn("_o", off)
    return p.withColumns({f"_c{a}": F.col(f"_c{a}") + F.col("_o")[i] for i, a in enumerate("xyz")}).drop("_o")


def _dealt(items: DataFrame, places: DataFrame, cell: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt over the tasks by cell and part of a cell: ``PART_ITEMS`` items on average, and a copy of each place of the cell.

    Spark's estimate of the places doesn't see their copies and would broadcast them from the driver, so all joins are
    merges. The number of tasks is named: few bytes of pairs are much work, and would be put together.
    """
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = items.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / PART_ITEMS).alias("_parts")).hint("merge")
    part = F.pmod(F.xxhash64(*items.columns), F.col("_parts"))
    items = items.join(parts, cell).withColumn("_part", part).drop("_parts")
    places = places.join(parts, cell).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_parts")
    return items.repartition(n, *cell, "_part"), places.repartition(n, *cell, "_part")


def _candidates(items: DataFrame, places: DataFrame, h: float) -> DataFrame:
    it = _cells(items, h).select("itemid", "lat", "lng", "_x", "_y", "_z", "_cx", "_cy", "_cz")
    pl = _spread(places, h).select("placeid", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"),
                                   *[F.col(f"_{a}").alias(f"_p{a}") for a in "xyz"], "_cx", "_cy", "_cz")
    it, pl = _dealt(it, pl, ["_cx", "_cy", "_cz"])
    j = pl.join(it.hint("merge"), on=["_cx", "_cy", "_cz", "_part"], how="inner")     # the merge holds one part's items
    # most candidates are told apart by a few products; the margin leaves rounding to the exact distance
    gap = sum((F.col(f"_{a}") - F.col(f"_p{a}")) * (F.col(f"_{a}") - F.col(f"_p{a}")) for a in "xyz")
    return j.where(gap <= h * h * (1 + 1e-6) + 1e-12).withColumn("dist", haversine_km("lat", "lng", "p_lat", "p_lng"))


def radius_pairs(items: DataFrame, places: DataFrame, radius_km: float = 5.0) -> DataFrame:
    """All (item, place, dist) with dist <= radius_km, by grid blocking."""
    items = _xyz(items.select("itemid", "lat", "lng"), "lat", "lng")
    places = _xyz(places.select("placeid", "lat", "lng"), "lat", "lng")
    c = _candidates(items, places, chord(radius_km) * 1.001)
    return c.where(F.col("dist") <= radius_km).select("itemid", "placeid", "dist")


def _pack(x: Column, y: Column, z: Column) -> Column:
    """A cell's three numbers as one key."""
    return F.shiftleft(x, 2 * DEPTH).bitwiseOR(F.shiftleft(y, DEPTH)).bitwiseOR(z)


def _numbers(cell: Column) -> list[Column]:
    mask = F.lit((1 << DEPTH) - 1).cast("bigint")
    return [F.shiftright(cell, DEPTH * k).bitwiseAND(mask) for k in (2, 1, 0)]


def _ancestor(cell: Column, up) -> Column:
    """The cell ``up`` levels above, numbered on its own level."""
    return _pack(*[F.call_function("shiftright", n, F.lit(up) if isinstance(up, int) else up) for n in _numbers(cell)])


def _tree_cell() -> Column:
    """The cell of the deepest level that holds a row's point (_x, _y, _z)."""
    top = 2 ** DEPTH
    return _pack(*[F.greatest(F.least(F.floor((F.col(f"_{a}") + 1) / (2 / top)), F.lit(top - 1)), F.lit(0)).cast("bigint") for a in "xyz"])


def _depth_and_start(items: DataFrame, places: DataFrame, leaf: float) -> tuple[int, int]:
    """The level whose cells hold ``LEAF_PLACES`` points, as a place sees it, and the level to start at.

    At most ``DEPTH`` + 1 rows and one row of numbers reach the driver.
    """
    cells = places.select(F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("level"), "_cell")
    cells = cells.groupBy("level", _ancestor(F.col("_cell"), DEPTH - F.col("level")).alias("_c")).agg(F.count(F.lit(1)).alias("n"))
    found = {r["level"]: r for r in cells.groupBy("level").agg(
        F.count(F.lit(1)).alias("cells"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("crowd")).collect()}
    if not found:
        return 0, 0
    depth = next((k for k in range(DEPTH) if found[k]["crowd"] <= LEAF_PLACES or 2 / 2 ** k <= leaf), DEPTH)
    n = items.agg(*[F.approx_count_distinct(_ancestor(F.col("_cell"), DEPTH - k)).alias(f"n{k}") for k in range(depth + 1)]).first()
    return depth, max([k for k in range(depth + 1) if found[k]["cells"] * n[f"n{k}"] <= START_PAIRS], default=0)


def _prune(pairs: DataFrame, level: int, reach: float) -> DataFrame:
    """Of the pairs of an item cell ``a`` and a place cell ``b``, those in which ``b`` can hold the best place of an item of ``a``.

    A place's rank is (outside the radius, conversion key if inside, distance). ``_low`` is not above the rank of any
    pair of points, and some place has a rank not above ``_high`` for every item; the margins are for rounding.
    """
    size = 2 / 2 ** level
    steps = [F.abs(x - y) for x, y in zip(_numbers(F.col("a")), _numbers(F.col("b")))]
    near = F.sqrt(sum(F.pow(F.greatest(n - 1, F.lit(0)) * size, F.lit(2.0)) for n in steps)) * (1 - 1e-9) - 1e-12
    far = F.sqrt(sum(F.pow((n + 1) * size, F.lit(2.0)) for n in steps)) * (1 + 1e-9) + 1e-12
    none = F.struct(F.lit(False).alias("none"), F.lit(0.0).alias("value"))
    rank = lambda outside, d: F.struct(outside.alias("outside"), F.when(outside, none).otherwise(F.col("_conv")).alias("conv"), d.alias("d"))
    pairs = pairs.withColumns({"_low": rank(near > reach * (1 + 1e-9) + 1e-12, near), "_high": rank(far > reach * (1 - 1e-9) - 1e-12, far)})
    pairs = pairs.withColumn("_most", F.min("_high").over(Window.partitionBy("a")))
    return pairs.where(F.col("_low") <= F.col("_most")).select("a", "b")


def candidate_lists(items: DataFrame, places: DataFrame, radius_km: float, leaf: float = 0.0) -> tuple[DataFrame, int]:
    """(a, places): for each cell that holds an item, the places that can be best for an item in it; and the cells' level.

    ``items`` and ``places`` carry their ``_cell`` of the deepest level; ``places`` are distinct points with a
    conversion key. Both sides descend together, halving the cells on each axis; a list's length depends on
    the crowding of a cell (about ``LEAF_PLACES``), not on the number of places.
    """
    depth, start = _depth_and_start(items, places, leaf)
    a_leaf = materialize(items.select(_ancestor(F.col("_cell"), DEPTH - depth).alias("_leaf")).distinct(), "item_cells")
    points = places.withColumn("_leaf", _ancestor(F.col("_cell"), DEPTH - depth))
    b_leaf = materialize(points.groupBy("_leaf").agg(F.min("_conv").alias("_conv")), "place_cells")

    def at(leaves: DataFrame, level: int, name: str) -> DataFrame:
        cell = _ancestor(F.col("_leaf"), depth - level).alias(name)
        return leaves.select(cell).distinct() if name == "a" else leaves.groupBy(cell).agg(F.min("_conv").alias("_conv"))

    kept = _prune(at(a_leaf, start, "a").crossJoin(F.broadcast(at(b_leaf, start, "b"))), start, chord(radius_km))   # START_PAIRS at most
    for level in range(start + 1, depth + 1):
        a = at(a_leaf, level, "a").withColumn("_a", _ancestor(F.col("a"), 1))
        b = at(b_leaf, level, "b").withColumn("_b", _ancestor(F.col("b"), 1))
        pairs = kept.withColumnsRenamed({"a": "_a", "b": "_b"}).join(a, "_a").join(b, "_b")
        kept = _prune(pairs, level, chord(radius_km))
    found = kept.join(points.withColumnRenamed("_leaf", "b"), "b")
    return found.groupBy("a").agg(F.collect_list(F.struct("lat", "lng", "_conv")).alias("_places")), depth


def _meet(items: DataFrame, lists: DataFrame, depth: int) -> DataFrame:
    """Each item with the list of its cell, and the distances. The items are dealt first: few bytes of them are much work."""
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = materialize(lists, "place_lists")
    held = lists.agg(F.sum(F.size("_places"))).first()[0] or 0
    # the items are never the broadcast side: their list work would end in one task
    lists = F.broadcast(lists) if held <= BROADCAST_PLACES else lists.hint("merge")
    met = items.repartition(n, "itemid").withColumn("a", _ancestor(F.col("_cell"), DEPTH - depth)).join(lists, "a")
    return met.withColumn("_dist", F.transform("_places", lambda p: haversine_km("lat", "lng", p["lat"], p["lng"])))


def nearest_pairs(items: DataFrame, places: DataFrame, leaf: float = 0.0) -> DataFrame:
    """(itemid, placeid, dist) of every item's nearest places, both sides with their point on the unit sphere.

    ``leaf`` is the least width of a cell worth looking at; the crowding of the places may end the descent sooner."""
    items, places = (df.withColumn("_cell", _tree_cell()) for df in (items, places))
    none = F.struct(F.lit(False).alias("none"), F.lit(0.0).alias("value"))
    points = materialize(places.select("lat", "lng", "_cell", none.alias("_conv")).distinct(), "place_points")
    met = _meet(items, *candidate_lists(items, points, -1.0, leaf))
    best = met.select("itemid", F.array_min(F.zip_with("_places", "_dist", lambda p, d: F.struct(d.alias("dist"), p["lat"].alias("lat"), p["lng"].alias("lng")))).alias("_p"))
    return best.select("itemid", "_p.*").join(places.select("placeid", "lat", "lng"), ["lat", "lng"]).select("itemid", "placeid", "dist")


def place_distance(items: DataFrame, places: DataFrame, radius_km: float = 5.0) -> DataFrame:
    """(itemid, lat, lng) x (placeid, lat, lng, conversion) -> (itemid, distance_backfill).

    Within ``radius_km``: the place with the highest conversion (nulls last;
    ties by distance, then id). Otherwise the nearest place (ties by id).
    A place id listed twice keeps its row with the highest conversion.
    """
    items = _xyz(items.select("itemid", "lat", "lng").where(F.col("lat").isNotNull() & F.col("lng").isNotNull()),
                 "lat", "lng").select("itemid", "lat", "lng", _tree_cell().alias("_cell"))
    places = dedup_key(places.select("placeid", "lat", "lng", "conversion")
                             .withColumns({"_no": F.col("conversion").isNull(), "_nc": -F.col("conversion")}),
                       ["placeid"], ["_no", "_nc", "lat", "lng"]).drop("_no", "_nc")
    # of the places at one point only the best can decide: the distance is the same
    conv = F.struct(F.col("conversion").isNull().alias("none"), (-F.col("conversion")).alias("value"))
    points = places.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).groupBy("lat", "lng").agg(F.min(conv).alias("_conv"))
    points = materialize(_xyz(points, "lat", "lng").select("lat", "lng", "_conv", _tree_cell().alias("_cell")), "place_points")

    met = _meet(items, *candidate_lists(items, points, radius_km))
    ranks = F.zip_with("_places", "_dist", lambda p, d: F.struct((d > radius_km).alias("outside"), F.when(d <= radius_km, p["_conv"]).alias("conv"),
                                                                 d.alias("d")))
    best = met.select("itemid", F.array_min(ranks).alias("_rank"))
    return best.groupBy("itemid").agg(F.min("_rank").alias("_rank")).select("itemid", F.col("_rank.d").alias("distance_backfill"))


def backfill_distance(df: DataFrame, backfill: DataFrame, flag: str = "iscitysearch") -> DataFrame:
    """City searches take the item's place distance instead of the logged one."""
    out = df.join(backfill, on="itemid", how="left")
    return out.withColumn("distance", F.when(F.col(flag) == 1, F.col("distance_backfill"))
                          .otherwise(F.col("distance"))).drop("distance_backfill")


def same_city(df: DataFrame, item_city: DataFrame) -> DataFrame:
    """Keep candidates listed in the searched city (adds ``cityid_item``)."""
    ic = item_city.select("itemid", "cityid_item").distinct()
    return df.join(ic, on="itemid", how="inner").where(F.col("cityid") == F.col("cityid_item"))
