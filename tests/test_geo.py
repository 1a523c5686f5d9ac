"""Distances, regions, map bins and density cells."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wherewhen.functions import geo
from wherewhen.functions.geo import Box
from wherewhen.operators import mapbins, proximity, quadtree, regions
from wherewhen.schema import NEIGHBORHOODS
from wherewhen.session import stored


def haversine(lat1, lng1, lat2, lng2, radius):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(
        math.radians(lat2)) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * radius * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def scatter(n, seed=1, hot=0.33):
    """Random points, a third of them on one spot."""
    rng = random.Random(seed)
    spot = (32.75, -117.15)
    return [
        (i, *(spot if rng.random() < hot else (rng.uniform(32.64, 32.88), rng.uniform(-117.28, -117.08))))
        for i in range(n)
    ]


def test_distance(spark):
    frame = spark.range(1).select(
        geo.great_circle(F.lit(32.7157), F.lit(-117.1611), F.lit(34.0522), F.lit(-118.2437), geo.EARTH_MILES).alias("far"),
        geo.great_circle(F.lit(32.7), F.lit(-117.1), F.lit(32.7), F.lit(-117.1), geo.EARTH_MILES).alias("zero"),
    ).first()
    assert 100 < frame.far < 120 and frame.zero == 0


def test_distance_labels(evaluate):
    cases = {
        0.05: "264 ft", 0.02: "106 ft", 0.0: "0 ft", 0.5: "0.5 mi", 1.23: "1.2 mi", 5.67: "5.7 mi", 12.34: "12 mi",
        100.9: "101 mi",
    }
    assert evaluate(geo.distance_label, list(cases), "v double") == list(cases.values())


def test_nearest_first_puts_unknown_last(spark):
    frame = spark.createDataFrame([(0, None, None), (1, 32.8, -117.1), (2, 32.7, -117.1), (3, 32.7, -117.1)], "k int, lat double, lng double")
    near = proximity.with_distance(frame, (32.7, -117.1), radius=geo.EARTH_MILES)
    assert [r.k for r in proximity.nearest_first(near, ["k"]).collect()] == [2, 3, 1, 0]
    assert [r.k for r in proximity.nearest_first(near, ["k"], limit=2).collect()] == [2, 3]


def test_radius_keeps_unknown_and_matches_brute_force(spark):
    rows = scatter(2000) + [(9999, None, -117.0)]
    frame = spark.createDataFrame(rows, "k int, lat double, lng double")
    at = (32.76, -117.12)
    for meters in (1.0, 900.0, 4000.0):
        got = {r.k for r in proximity.within_radius(frame, at, meters).collect()}
        want = {k for k, lat, lng in rows if lat is None or haversine(*at, lat, lng, geo.EARTH_METERS) <= meters}
        assert got == want
    assert 9999 not in {r.k for r in proximity.within_radius(frame, at, 900.0, keep_missing=False).collect()}


def test_near_centers_matches_brute_force(spark):
    points, centers = scatter(1500), scatter(40, seed=2, hot=0.2)
    p = spark.createDataFrame(points, "k int, lat double, lng double")
    c = spark.createDataFrame(centers, "center int, lat double, lng double")
    got = {(r.center, r.k) for r in proximity.near_centers(p, c, "center", 1500.0, ["k"]).collect()}
    want = {
        (ci, k) for ci, clat, clng in centers for k, lat, lng in points
        if haversine(clat, clng, lat, lng, geo.EARTH_METERS) <= 1500
    }
    assert got == want
    top = proximity.near_centers(p, c, "center", 1500.0, ["k"], k=2).groupBy("center").count().collect()
    assert all(r["count"] <= 2 for r in top)
    with pytest.raises(ValueError):
        proximity.near_centers(p, c, "center", 9e6, ["k"])


def test_shared_edges_go_to_the_first_box(spark):
    frame = spark.createDataFrame([(32.755, -117.12), (32.745, -117.12), (10.0, 10.0), (None, None)], "lat double, lng double")
    got = [r.neighborhood for r in regions.assign_region(frame, NEIGHBORHOODS).collect()]
    assert got == ["north_park", "north_park", None, None]


def test_region_table_equals_region_chain(spark):
    frame = spark.createDataFrame(scatter(3000, seed=3), "k int, lat double, lng double")
    chain = regions.assign_region(frame, NEIGHBORHOODS).select("k", "neighborhood")
    table = regions.assign_region_table(frame, regions.boxes_frame(spark, NEIGHBORHOODS), tile_degrees=0.02)
    assert sorted(chain.collect()) == sorted(table.select("k", "neighborhood").collect())
    # Larger than the globe, without a key, and more boxes than anyone writes into an expression.
    world = [*NEIGHBORHOODS, *[Box(float(i), float(i), float(i), float(i), f"b{i}") for i in range(80)], Box(-90.0, -180.0, 90.0, 180.0, "world")]
    nowhere = frame.limit(3).select(F.lit(None).cast("int").alias("k"), F.lit(None).cast("double").alias("lat"), "lng")
    both = frame.unionByName(nowhere)
    want = regions.assign_region(both, world)
    got = regions.assign_region_table(both, regions.boxes_frame(spark, world), tile_degrees=0.001)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r.neighborhood for r in regions.assign_region_table(frame, regions.boxes_frame(spark, [])).collect()} == {None}


def test_near_centers_at_poles_and_seam(spark):
    rng = random.Random(11)
    spots = [(90.0, 0.0), (-90.0, 17.0), (70.0, 180.0), (70.0, -180.0), (0.0, 179.999), (89.99, 45.0), (0.0, 0.0)]
    points = [(i, *spots[i % 7]) for i in range(7)] + [
        (7 + i, max(-90.0, min(90.0, lat + rng.uniform(-0.02, 0.02))), (lng + rng.uniform(-0.05, 0.05) + 180) % 360 - 180)
        for i, (lat, lng) in enumerate(spots * 20)
    ]
    p = spark.createDataFrame(points, "k int, lat double, lng double")
    c = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)], "center int, lat double, lng double")
    got = sorted((r.center, r.k) for r in proximity.near_centers(p, c, "center", 2500.0, ["k"]).collect())
    assert got == sorted(
        (i, k) for i, (clat, clng) in enumerate(spots) for k, lat, lng in points
        if haversine(clat, clng, lat, lng, geo.EARTH_METERS) <= 2500
    )


def test_area_selection():
    assert [b.id for b in regions.select_areas(presets=["utc", "gaslamp"])] == ["utc", "gaslamp"]
    around = regions.select_areas(point=(32.7, -117.1))[0]
    assert (round(around.south, 3), round(around.east, 3)) == (32.688, -117.085)
    assert regions.select_areas()[0].north == 32.88
    with pytest.raises(ValueError):
        regions.select_areas(presets=["atlantis"])


def test_quadrants_cover_the_parent(spark):
    box = F.struct(*[F.lit(v).alias(n) for n, v in zip(("south", "west", "north", "east"), (32.7, -117.2, 32.9, -117.0))])
    kids = spark.range(1).select(F.explode(geo.quadrants(box, 0.075)).alias("q")).select("q.*").collect()
    assert len(kids) == 4
    assert min(k.south for k in kids) == 32.7 and max(k.north for k in kids) == 32.9
    assert all(k.north - k.south == pytest.approx(0.2 * 0.575) for k in kids)
    south_west, north_east = kids[0], kids[3]
    assert south_west.north > north_east.south and south_west.east > north_east.west


def brute_quadtree(points, box, cap, min_miles):
    """The adaptive search as a work list."""
    todo, leaves = [("", box.south, box.west, box.north, box.east)], {}
    while todo:
        path, s, w, n, e = todo.pop(0)
        inside = {k for k, lat, lng in points if s <= lat <= n and w <= lng <= e}
        if len(inside) >= cap and (e - w) * 58 > min_miles and (n - s) * 69 > min_miles:
            ml, mg, ol, og = (s + n) / 2, (w + e) / 2, (n - s) * 0.075, (e - w) * 0.075
            todo += [
                (path + "0", s, w, ml + ol, mg + og), (path + "1", s, mg - og, ml + ol, e),
                (path + "2", ml - ol, w, n, mg + og), (path + "3", ml - ol, mg - og, n, e),
            ]
        else:
            leaves[path] = inside
    return leaves


@pytest.mark.parametrize("levels_per_pass", [5, 2])
def test_quadtree_matches_the_work_list(spark, tmp_path, levels_per_pass):
    points = scatter(1200, seed=5)
    box = geo.Box(32.64, -117.28, 32.88, -117.08)
    frame = spark.createDataFrame(points + points[:300], "k int, lat double, lng double")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    want = brute_quadtree(points, box, 40, 0.75)
    cells = quadtree.quadtree_cells(frame, box, key="k", cap=40, levels_per_pass=levels_per_pass)
    assert {r.path: r.n_points for r in cells.collect()} == {p: len(ids) for p, ids in want.items()}
    members = quadtree.quadtree_members(frame.dropDuplicates(["k"]), cells, box, ["k"])
    found = {}
    for r in members.collect():
        found.setdefault(r.path, set()).add(r.k)
    assert found == {p: ids for p, ids in want.items() if ids}
    assert set().union(*found.values()) == {k for k, *_ in points}


def test_small_cells_are_not_split(spark):
    box = geo.Box(32.70, -117.10, 32.70 + 0.75 / 69 * 0.99, -117.09)
    frame = spark.createDataFrame([(i, 32.705, -117.095) for i in range(100)], "k int, lat double, lng double")
    assert quadtree.max_depth(box) == 0
    assert [r.n_points for r in quadtree.quadtree_cells(frame, box).collect()] == [100]


def test_codes_have_room_for_every_level():
    world = Box(-80.0, -180.0, 80.0, 180.0)
    assert quadtree.max_depth(world, 0.01) <= quadtree.DEEPEST
    with pytest.raises(ValueError, match="levels"):
        quadtree.max_depth(world, 1e-7)


def test_clusters(spark):
    rows = [(1, 32.7, -117.1, True), (2, 32.7, -117.1, False), (3, 32.8, -117.2, False), (4, None, None, True)]
    frame = spark.createDataFrame(rows, "k int, lat double, lng double, active boolean")
    low = {(r.kind, r.n_points, r.has_active, r.point_key) for r in mapbins.cluster_points(frame, 13, "k").collect()}
    assert low == {("cluster", 2, True, None), ("single", 1, False, 3)}
    high = mapbins.cluster_points(frame, 15, "k").collect()
    assert [r.kind for r in high] == ["single"] * 3
    members = mapbins.with_map_cell(frame, 13).groupBy("cell_x", "cell_y").count().collect()
    assert sorted(r["count"] for r in members) == [1, 2]
    box = mapbins.bounds(frame).first()
    assert (box.south, box.west, box.north, box.east) == (32.7, -117.2, 32.8, -117.1)


def test_radius_box_is_pushed(spark, tmp_path):
    path = str(tmp_path / "points")
    spark.createDataFrame([(1, 10.0, 10.0), (2, None, 10.0), (3, 50.0, 10.0)], "k int, lat double, lng double").write.parquet(path)
    near = proximity.within_radius(spark.read.parquet(path), (10.0, 10.0), 1000.0)
    plan = near._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(lat" in plan.split("PushedFilters")[1] and sorted(r.k for r in near.collect()) == [1, 2]


def miles_apart(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((la - lb) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lo - lp) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


def test_k_nearest_without_a_radius(spark):
    """Crowds, empty country, latitude 70, both sides of 180 degrees, poles, and repeated positions."""
    rng = random.Random(12)
    spots = [(32.7 + rng.random() / 50, -117.1 + rng.random() / 50) for _ in range(400)]
    spots += [(70 + rng.random(), 25 + rng.random() * 3) for _ in range(60)] + [(rng.uniform(-5, 5), rng.choice([179.99, -179.99])) for _ in range(60)]
    spots += [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)] + [(10.0, 10.0)] * 40 + [(90.0, 0.0), (-90.0, 0.0), (0.0, 0.0)]
    points = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)] + [(9999, None, 1.0)], "p long, lat double, lng double")
    asked = [(32.71, -117.09), (70.2, 26.1), (0.0, 180.0), (1.0, -180.0), (90.0, 12.0), (-89.9, 50.0), (10.0, 10.0), (-50.0, 100.0), (0.0, 0.0), (60.0, -160.0)]
    centers = spark.createDataFrame([(i, *s) for i, s in enumerate(asked)] + [(77, None, None)], "c long, lat double, lng double")
    for k in (1, 7, 45):
        got = {}
        for r in proximity.nearest_k_any(points, centers, "c", ["p"], k).collect():
            got.setdefault(r.c, []).append((r["rank"], r.p, r.distance))
        assert set(got) == set(range(len(asked)))
        for i, at in enumerate(asked):
            want = sorted(miles_apart(at, s) for s in spots)[:k]
            found = sorted(got[i])
            assert [round(d, 2) for _, _, d in found] == [round(d, 2) for d in want]
            assert len({p for _, p, _ in found}) == k
    few = points.where("p < 3")
    assert proximity.nearest_k_any(few, centers, "c", ["p"], 10).count() == 3 * len(asked)
    assert proximity.nearest_k_any(points.where("p < 0"), centers, "c", ["p"], 3).collect() == []


def test_k_nearest_compares_few_pairs(spark):
    """A far-away centre looks at the near rim of the crowd, not at all of it."""
    points = spark.range(20_000).select(F.col("id").alias("p"), (32.6 + F.rand(1) / 4).alias("lat"), (-117.2 + F.rand(2) / 4).alias("lng"))
    centers = spark.createDataFrame([(0, 70.0, 20.0), (1, 32.7, -117.1), (2, -40.0, 179.0)], "c long, lat double, lng double")
    assert proximity.nearest_k_any(points, centers, "c", ["p"], 5).count() == 15
    assert proximity.compared_pairs(points, centers, "c", ["p"], 5).count() < 200


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_listed_points_are_not_broadcast(spark, tmp_path, monkeypatch, broadcast):
    """Points are many more under their cells than in their file; leaves are what travels."""
    monkeypatch.setattr(quadtree, "_BROADCAST_LEAVES", broadcast)
    box = geo.Box(32.64, -117.28, 32.88, -117.08)
    points = scatter(1500, seed=8)
    spark.createDataFrame(points, "k int, lat double, lng double").write.parquet(str(tmp_path / "points"))
    frame = spark.read.parquet(str(tmp_path / "points"))
    members = quadtree.quadtree_members(frame, quadtree.quadtree_cells(frame, box, key="k", cap=40), box, ["k"])
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and ("BroadcastHashJoin" in plan) == (broadcast > 0)
    found = {}
    for r in members.collect():
        found.setdefault(r.path, set()).add(r.k)
    assert found == {p: ids for p, ids in brute_quadtree(points, box, 40, 0.75).items() if ids}


def test_nearest_within_reach_compares_few_pairs(spark):
    """Crowds in reach, many points on one spot, centres that repeat: each as in a plain join."""
    points = scatter(3000, seed=21)
    rows = scatter(60, seed=22, hot=0.2)
    centers = [*rows, *rows[:10], (0, 32.7, -117.1), (None, 32.75, -117.15), (99, 10.0, 10.0)]
    p = spark.createDataFrame(points + points[:50], "k int, lat double, lng double")
    c = spark.createDataFrame(centers, "center int, lat double, lng double")
    plain = {}
    for center, *at in centers:
        for k, lat, lng in points + points[:50]:
            far = haversine(*at, lat, lng, geo.EARTH_METERS)
            if far <= 1500:
                plain.setdefault(center, []).append((round(far, 6), k))
    got = {}
    for r in proximity.near_centers(p, c, "center", 1500.0, ["k"], k=3).collect():
        got.setdefault(r.center, []).append((round(r.distance, 6), r.k))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v)[:3] for i, v in plain.items()}
    # A third of the points on one spot are no more pairs than k of them.
    hot = spark.createDataFrame([(i, 32.75, -117.15) for i in range(5000)], "k int, lat double, lng double")
    assert proximity.compared_pairs(hot, c.where("center is not null"), "center", ["k"], 3, meters=1500.0).count() <= 3 * len(centers)
    plan = proximity.near_centers(p, c, "center", 1500.0, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_centers_are_dealt_out_by_their_number(spark, monkeypatch):
    """The descent holds a bounded number of centres in a task, without a shuffle that packs them into one."""
    monkeypatch.setattr(proximity, "_TASK_CENTERS", 50)
    held = []
    monkeypatch.setattr(proximity, "stored", lambda frame, purpose: (held.append(frame) if purpose == "held-cells" else None, stored(frame, purpose))[1])
    points = spark.createDataFrame(scatter(2000, seed=31), "p int, lat double, lng double")
    centers = spark.createDataFrame(scatter(400, seed=32), "c int, lat double, lng double")
    assert proximity.nearest_k_any(points, centers, "c", ["p"], 2).count() == 800
    plan = held[0]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__id" in plan and "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
