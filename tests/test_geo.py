"""Grid-blocked place distance = brute force over all pairs."""

import math
import random

from rankloom.functions.geo import EARTH_RADIUS_KM
from rankloom.operators import geo as G


def hav(a, b, c, d):
    r = math.radians
    dlat, dlng = r(a - c), r(b - d)
    x = math.sin(dlat / 2) ** 2 + math.cos(r(a)) * math.cos(r(c)) * math.sin(dlng / 2) ** 2
    return EARTH_RADIUS_KM * 2 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def brute(items, places, radius=5.0):
    out = {}
    for i, la, lo in items:
        ds = [(hav(la, lo, pla, plo), pid, conv) for pid, pla, plo, conv in places]
        near = [t for t in ds if t[0] <= radius]
        if near:
            near.sort(key=lambda t: (t[2] is None, -(t[2] or 0), t[0], t[1]))
            out[i] = near[0][0]
        else:
            out[i] = min(ds, key=lambda t: (t[0], t[1]))[0]
    return out


def test_radius_and_nearest_levels(spark):
    rnd = random.Random(11)
    places = [(p, 10 + rnd.random(), 70 + rnd.random(), rnd.choice([None, rnd.random() / 10])) for p in range(40)]
    places += [(100, -33.9, 151.2, 0.5), (101, 64.1, -21.9, None)]     # far away, other hemispheres
    items = [(i, 10 + rnd.random() * 1.2, 70 + rnd.random() * 1.2) for i in range(300)]
    items += [(1000, -34.5, 150.0), (1001, 80.0, 10.0), (1002, -60.0, -120.0)]  # settled at coarse levels
    idf = spark.createDataFrame(items, "itemid long, lat double, lng double")
    pdf = spark.createDataFrame(places, "placeid long, lat double, lng double, conversion double")
    got = {r.itemid: r.distance_backfill for r in G.place_distance(idf, pdf).collect()}
    want = brute(items, places)
    assert set(got) == set(want)
    for k in want:
        assert abs(got[k] - want[k]) < 1e-6, k


def test_exact_radius_edge(spark):
    # a place exactly 5 km north of the item counts as inside the radius
    dlat = math.degrees(5.0 / EARTH_RADIUS_KM)
    items = spark.createDataFrame([(1, 10.0, 70.0)], "itemid long, lat double, lng double")
    for place, inside in ((10.0 + dlat, True), (10.0 + dlat * (1 + 1e-9), False), (10.0 - dlat * (1 - 1e-9), True)):
        places = spark.createDataFrame([(1, place, 70.0, 0.01), (2, 10.001, 70.0, None)],
                                       "placeid long, lat double, lng double, conversion double")
        (r,) = G.place_distance(items, places, max(5.0, hav(10.0, 70.0, 10.0 + dlat, 70.0))).collect()
        # inside, the converting place wins over the nearer one
        assert abs(r.distance_backfill - (5.0 if inside else hav(10.0, 70.0, 10.001, 70.0))) < 1e-6


def test_duplicate_place_keeps_best_conversion(spark):
    items = spark.createDataFrame([(1, 10.0, 70.0)], "itemid long, lat double, lng double")
    places = spark.createDataFrame([(7, 10.01, 70.0, 0.1), (7, 10.02, 70.0, 0.3)],
                                   "placeid long, lat double, lng double, conversion double")
    (r,) = G.place_distance(items, places).collect()
    assert abs(r.distance_backfill - hav(10.0, 70.0, 10.02, 70.0)) < 1e-9


def test_far_items_meet_few_places(spark):
    """No item is near a place; each meets the places of the cells that can win, not all of them."""
    rnd = random.Random(4)
    places = [(p, rnd.uniform(-80, 80), rnd.uniform(-180, 180), None) for p in range(400)]
    places += [(1000 + p, 45 + rnd.random() / 100, 9 + rnd.random() / 100, None) for p in range(300)]   # one crowded cell
    items = [(i, rnd.uniform(-89, 89), rnd.uniform(-180, 180)) for i in range(150)] + [(500, 90.0, 0.0), (501, 0.0, 180.0), (502, 0.0, 0.0)]
    idf = spark.createDataFrame(items, "itemid long, lat double, lng double")
    pdf = spark.createDataFrame(places, "placeid long, lat double, lng double, conversion double")
    pairs = G.nearest_pairs(G._xyz(idf, "lat", "lng"), G._xyz(pdf, "lat", "lng"), G.chord(5.0)).collect()
    best = {}
    for r in pairs:
        best[r.itemid] = min(best.get(r.itemid, (9e9, 0)), (r.dist, r.placeid))
    want = brute(items, places, radius=-1.0)
    assert set(best) == set(want) and all(abs(best[k][0] - want[k]) < 1e-6 for k in want)
    crowded = sum(1 for r in pairs if r.placeid >= 1000)
    assert len(pairs) - crowded < 3 * len(items)


def test_nothing_is_left_persisted(spark):
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    items = spark.createDataFrame([(1, 10.0, 70.0), (2, 50.0, 0.0)], "itemid long, lat double, lng double")
    places = spark.createDataFrame([(7, 10.01, 70.0, 0.1)], "placeid long, lat double, lng double, conversion double")
    assert G.place_distance(items, places).count() == 2
    assert G.place_distance(items, places.limit(0)).count() == 0 and G.place_distance(items.limit(0), places).count() == 0
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before


def test_lists_stay_short_as_places_multiply(spark):
    """Ten times the places inside every radius: the same distances as brute force, and lists that are no longer."""
    from pyspark.sql import functions as F
    rnd = random.Random(5)
    items = [(i, 10 + rnd.random() / 5, 70 + rnd.random() / 5) for i in range(200)]
    idf = spark.createDataFrame(items, "itemid long, lat double, lng double")
    sizes = []
    for n in (200, 2000):
        places = [(p, 10 + rnd.random() / 5, 70 + rnd.random() / 5, rnd.choice([None, 0.1, 0.2, rnd.random()])) for p in range(n)]
        pdf = spark.createDataFrame(places, "placeid long, lat double, lng double, conversion double")
        got = {r.itemid: r.distance_backfill for r in G.place_distance(idf, pdf).collect()}
        want = brute(items, places)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
        points = G._xyz(pdf, "lat", "lng").select("lat", "lng", F.struct(F.col("conversion").isNull().alias("none"), (-F.col("conversion")).alias("value")).alias("_conv"),
                                                  G._tree_cell().alias("_cell"))
        at = G._xyz(idf, "lat", "lng").withColumn("_cell", G._tree_cell())
        lists, _ = G.candidate_lists(at, points, 5.0)
        sizes.append(lists.agg(F.avg(F.size("_places"))).first()[0])
    assert sizes[1] < 2 * sizes[0] + 4


def test_radius_pairs_of_crowded_cells_are_dealt_without_a_broadcast(spark, monkeypatch):
    """The places copied into their neighbour cells are not sent to the driver; a cell's items meet them in parts, each pair once."""
    rnd = random.Random(8)
    monkeypatch.setattr(G, "PART_ITEMS", 7, raising=False)
    items = [(i, 10 + rnd.random() / 50, 70 + rnd.random() / 50) for i in range(120)] + [(500, -45.0, 10.0), (501, None, 70.0), (None, 10.0, 70.0), (3, 10.0, 70.0), (3, 10.0, 70.0)]
    places = [(p, 10 + rnd.random() / 10, 70 + rnd.random() / 10) for p in range(60)] + [(900, 10.0, None), (901, 60.0, 60.0), (7, 10.01, 70.0)]
    idf = spark.createDataFrame(items, "itemid long, lat double, lng double")
    pdf = spark.createDataFrame(places, "placeid long, lat double, lng double")
    out = G.radius_pairs(idf, pdf, 5.0)
    got = sorted(((r.itemid, r.placeid, round(r.dist, 6)) for r in out.collect()), key=str)
    near = [(i, p, round(hav(la, lo, pla, plo), 6)) for i, la, lo in items for p, pla, plo in places if la is not None and plo is not None]
    assert got == sorted([t for t in near if t[2] <= 5.0], key=str) and len(got) > 1000
    p = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in p and "SortMergeJoin" in p
