import pytest
import math

from pyspark.sql import functions as F

from conftest import SF_SMALL
from crisismap.functions import geometry as G
from crisismap.operators import spatial as SP
from crisismap.plans import fixtures as fx
from crisismap.plans.q_geo import post_points


def ring(pts):
    return [{"lon": float(x), "lat": float(y)} for x, y in pts]


def box(x0, y0, x1, y1):
    return ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])


RING_T = "array<struct<lon:double,lat:double>>"


def test_point_in_polygon_closed_edges(spark):
    tri = ring([(0, 0), (2, 0), (2, 2), (0, 0)])
    pts = [(1.0, 0.5, True), (0.5, 1.0, False), (1.0, 1.0, True), (2.0, 2.0, True), (2.0, 1.0, True),
           (3.0, 1.0, False), (0.0, 0.0, True), (1.5, 0.0, True)]
    df = spark.createDataFrame([(x, y, e, tri) for x, y, e in pts], f"x double, y double, e boolean, r {RING_T}")
    got = df.select("e", F.expr(G.point_in_polygon("x", "y", "r")).alias("g")).collect()
    assert all(r.e == r.g for r in got)


def test_polygons_intersect_cases(spark):
    cases = [
        (box(0, 0, 1, 1), box(2, 2, 3, 3), False),       # disjoint
        (box(0, 0, 1, 1), box(1, 0, 2, 1), True),        # touching edge
        (box(0, 0, 1, 1), box(1, 1, 2, 2), True),        # touching corner
        (box(0, 0, 10, 10), box(2, 2, 3, 3), True),      # nested
        (box(0, 4, 10, 6), box(4, 0, 6, 10), True),      # crossing, no vertex inside the other
    ]
    df = spark.createDataFrame(cases, f"a {RING_T}, b {RING_T}, e boolean")
    got = df.select("e", F.expr(G.polygons_intersect("a", "b")).alias("g"),
                    F.expr(G.polygons_intersect("b", "a")).alias("h")).collect()
    assert all(r.e == r.g == r.h for r in got)


def test_distances(spark):
    df = spark.createDataFrame([(box(0, 0, 1, 1), box(4, 5, 6, 6), 5.0, 1.0)],
                               f"a {RING_T}, b {RING_T}, px double, py double")
    r = df.select(F.expr(G.polygon_polygon_distance("a", "b")).alias("d"),
                  F.expr(G.point_polygon_distance("px", "py", "a")).alias("p"),
                  F.expr(G.point_polygon_distance("0.5D", "0.5D", "a")).alias("z")).first()
    assert math.isclose(r.d, 5.0) and math.isclose(r.p, 4.0) and r.z == 0.0


def test_projection_reference_points(spark):
    df = spark.createDataFrame([(5.0, 50.0)], "lon double, lat double")
    x, y = G.project("lon", "lat", "EPSG:3035")
    r = df.select(x.alias("x"), y.alias("y")).first()
    assert abs(r.x - 3962799.45) < 0.01 and abs(r.y - 2999718.85) < 0.01
    mx, my = G.project("lon", "lat", "EPSG:3857")
    r = df.select(mx.alias("x"), my.alias("y")).first()
    assert abs(r.x - 556597.45) < 0.01 and abs(r.y - 6446275.84) < 0.01
    df2 = spark.createDataFrame([(-120.0, 0.0)], "lon double, lat double")
    ax, ay = G.project("lon", "lat", "EPSG:3310")
    r = df2.select(ax.alias("x"), ay.alias("y")).first()
    assert abs(r.x) < 1e-6 and abs(r.y + 4000000.0) < 1e-6  # origin maps to the false northing


def test_node_join_equals_brute_force(spark):
    pts = post_points(spark, SF_SMALL)
    grid = fx.grid(spark)
    fast = SP.points_in_cells(pts, grid).select("cid", "crawl_seq", "k", "cell_id")
    brute = pts.crossJoin(grid).where(F.expr(G.point_in_polygon("lon", "lat", "ring"))).select(
        "cid", "crawl_seq", "k", "cell_id")
    assert fast.count() == brute.count()
    assert fast.exceptAll(brute).count() == 0 and brute.exceptAll(fast).count() == 0


def test_node_join_plan_has_no_nested_loop(spark):
    pts = fx.fires(spark, SF_SMALL).select("fire_id", "lon", "lat")
    plan = SP.points_in_cells(pts, fx.grid(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_salted_fallback_matches_broadcast(spark, monkeypatch):
    import crisismap.operators.spatial as mod

    pts = post_points(spark, SF_SMALL)
    grid = fx.grid(spark)
    a = mod.points_in_cells(pts, grid).select("cid", "crawl_seq", "k", "cell_id")
    monkeypatch.setattr(mod, "maybe_broadcast", lambda df, max_rows=0: (df, False))
    monkeypatch.setattr(mod, "ROWS_PER_SALT", 3)
    b = mod.points_in_cells(pts, grid).select("cid", "crawl_seq", "k", "cell_id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


BOXES = "id long, xmin double, ymin double, xmax double, ymax double"


def _boxes(rng, n, first):
    """Point-size to continent-size boxes; a third of them on one spot."""
    rows = []
    for i in range(n):
        x, y = (5.0, 5.0) if i % 3 == 0 else (rng.uniform(-100, 100), rng.uniform(-100, 100))
        w, h = rng.choice([(0, 0), (0.5, 0.5), (3, 1), (150, 120)]) if i % 3 else (0.25, 0.25)
        rows.append((first + i, float(x), float(y), x + w, y + h))
    return [*rows, (first + n, None, 1.0, 2.0, 2.0), (first + n + 1, float("nan"), 1.0, 2.0, 2.0)]


@pytest.mark.parametrize("small, whole", [(True, True), (False, True), (False, False)])
def test_box_join_equals_brute_force(spark, monkeypatch, small, whole):
    import random

    rng = random.Random(5)
    left, right = _boxes(rng, 240, 0), _boxes(rng, 200, 1000)
    if not small:  # neither broadcast nor, at last, trees and nodes from all shapes
        monkeypatch.setattr(SP, "maybe_broadcast", lambda df: (df, False))
        monkeypatch.setattr(SP, "ROWS_PER_SALT", 10)
    if not whole:
        monkeypatch.setattr(SP, "SAMPLE_SHAPES", 40)
    want = {(a[0], b[0]) for a in left for b in right if None not in a + b and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    one, two = spark.createDataFrame(left, BOXES), spark.createDataFrame(right, BOXES).toDF("other", "x0", "y0", "x1", "y1")
    names = ("xmin", "ymin", "xmax", "ymax"), ("x0", "y0", "x1", "y1")
    got = [(r.id, r.other) for r in SP.box_join(one, two, *names).collect()]
    assert len(got) == len(set(got)) and set(got) == want  # each pair once
    dots = one.select("id", "xmin", "ymin")
    pairs = {(a[0], b[0]) for a in left for b in right if None not in a + b and b[1] <= a[1] <= b[3] and b[2] <= a[2] <= b[4]}
    got = [(r.id, r.other) for r in SP.box_join(dots, two, ("xmin", "ymin", "xmin", "ymin"), names[1], points=True).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    assert SP.box_join(one, two.limit(0), *names).count() == SP.box_join(one.limit(0), two, *names).count() == 0


def test_shapes_are_kept_at_few_nodes(spark):
    import numpy as np

    from crisismap.operators.splits import SplitTree

    rng = np.random.default_rng(7)
    held = SplitTree.fit(rng.uniform(0, 100, (4000, 2)), 1000).nodes(2)
    low = rng.uniform(0, 90, (60, 2))
    high = low + rng.choice([0.0, 1.0, 80.0], (60, 1))
    box, node = held.cover(low, high, 16)
    assert np.bincount(box, minlength=60).min() >= 1 and np.bincount(box).max() <= 16
    dots = low + (high - low) * rng.uniform(0, 1, (60, 2))
    for i in range(60):  # any place of a box lies in exactly one of its nodes
        mine = node[box == i]
        assert ((dots[i] >= held.low[mine]) & (dots[i] < held.high[mine])).all(axis=1).sum() == 1


def test_nearest_equals_brute_force(spark):
    grid = fx.grid(spark).where("level = 4")
    fires = fx.fires(spark, SF_SMALL).limit(40)
    fast = SP.nearest_distance(grid, fires, "EPSG:3310").select("cell_id", "min_distance")
    pc = grid.select("cell_id", G.project_ring("ring", "EPSG:3310").alias("pr"))
    x, y = G.project("lon", "lat", "EPSG:3310")
    hz = fires.select(x.alias("hx"), y.alias("hy"))
    brute = pc.crossJoin(hz).groupBy("cell_id").agg(
        F.min(F.expr(G.point_polygon_distance("hx", "hy", "pr"))).alias("b"))
    rows = fast.join(brute, "cell_id").collect()
    assert len(rows) == 280
    assert all(abs(r.min_distance - r.b) < 1e-6 for r in rows)


def test_valid_ring(spark):
    df = spark.createDataFrame([(box(0, 0, 1, 1), True), (ring([(0, 0), (1, 0), (0, 0)]), False),
                                (ring([(0, 0), (1, 0), (2, 0), (0, 0)]), False),
                                (ring([(0, 0), (1, 0), (1, 1), (0, 1)]), False)], f"r {RING_T}, e boolean")
    assert all(r.e == r.g for r in df.select("e", F.expr(G.valid_ring("r")).alias("g")).collect())


def test_holes_and_parts(spark):
    from crisismap.functions import geometry as G
    from crisismap.operators import spatial as SP

    def box(x, y, h):
        return [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]

    point = "struct<lon: double, lat: double>"
    floods = spark.createDataFrame([(1, [[box(0.0, 0.0, 3.0), box(0.0, 0.0, 2.0)], [box(10.0, 0.0, 0.5)]]),
                                    (2, [[box(50.0, 50.0, 1.0)[:4]]])], f"id int, polygons array<array<array<{point}>>>")
    hazards = SP.valid_hazards(floods)
    assert [r.id for r in hazards.collect()] == [1]  # an open ring is no valid one
    cells = spark.createDataFrame([("in hole", box(0.0, 0.0, 1.0)), ("on rim", box(2.5, 0.0, 0.1)), ("over rim", box(2.0, 0.0, 0.5)),
                                   ("part", box(10.0, 0.0, 5.0)), ("far", box(30.0, 0.0, 1.0))], f"cell_id string, ring array<{point}>")
    flags = {r.cell_id: r.intersects for r in SP.intersects_any(cells, hazards, hazard_ring="ring").collect()}
    assert flags == {"in hole": False, "on rim": True, "over rim": True, "part": True, "far": False}
    pairs = cells.crossJoin(hazards.select(F.col("ring").alias("hazard")))
    apart = {r.cell_id: r.d for r in pairs.select("cell_id", F.expr(G.polygon_polygon_distance("ring", "hazard")).alias("d")).collect()}
    assert apart == {"in hole": 1.0, "on rim": 0.0, "over rim": 0.0, "part": 0.0, "far": 18.5}
