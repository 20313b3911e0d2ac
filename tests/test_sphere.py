"""Polygons on the sphere against outlines of many short chords in an equal-area map around their middle."""

import math

import numpy as np
import pytest

from crisismap.functions import sphere as SPH
from crisismap.operators import posts as P
from crisismap.operators import spatial as SP

NORTH = [(0, 60), (90, 55), (180, 70), (-90, 50)]
SOUTH = [(0, -60), (-90, -55), (-180, -70), (90, -50)]
CASES = {
    "box": [SPH.box_ring(P.EUROPE_BOX)],
    "over the 180th meridian": [[(150, -20), (-160, -35), (-150, 40), (170, 10), (155, 35)]],
    "around the north pole": [NORTH],
    "around the south pole": [SOUTH],
    "around the north pole, westwards": [NORTH[::-1]],
    "pole as a vertex": [[(10, 20), (70, 30), (100, 90)]],
    "south pole as a vertex": [[(170, -20), (-140, -30), (0, -90)]],
    "meridians": [[(10, -40), (10, 30), (50, 30), (50, -40)]],
    "hole": [[(0, 0), (60, 0), (60, 50), (0, 50)], [(20, 10), (40, 10), (30, 40)]],
    "closed ring, repeated vertex": [[(0, 0), (60, 0), (60, 0), (60, 50), (0, 50), (0, 0)]],
}


def unit(lon, lat):
    lon, lat = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)


def chords(ring):
    """Vertices along the great circles between the vertices of a ring."""
    out = []
    for a, b in zip(ring, [*ring[1:], ring[0]]):
        u, v = unit(*map(float, a)), unit(*map(float, b))
        angle = math.acos(max(-1.0, min(1.0, float(u @ v))))
        if angle > 0:
            t = np.linspace(0, 1, 3000, endpoint=False)[:, None]
            out.append((np.sin((1 - t) * angle) * u + np.sin(t * angle) * v) / math.sin(angle))
    return np.concatenate(out)


def flat(points, middle):
    """Lambert's equal-area map around ``middle``."""
    east = np.cross([0, 0, 1.0], middle)
    if np.linalg.norm(east) < 1e-9:
        east = np.array([1.0, 0, 0])
    east /= np.linalg.norm(east)
    scale = np.sqrt(2 / (1 + points @ middle))[..., None]
    return scale * np.stack([points @ east, points @ np.cross(middle, east)], axis=-1)


def brute(rings, points):
    """Inside, and whether the point is too near an outline to be told by chords."""
    lines = [chords(r) for r in rings]
    middle = lines[0].mean(axis=0)
    middle /= np.linalg.norm(middle)
    xy, odd, near = flat(points, middle), np.zeros(len(points), bool), np.zeros(len(points), bool)
    for line in lines:
        a = flat(line, middle)
        b = np.roll(a, -1, axis=0)
        for i, (x, y) in enumerate(xy):
            up = (a[:, 1] > y) != (b[:, 1] > y)
            at = a[up, 0] + (y - a[up, 1]) * (b[up, 0] - a[up, 0]) / (b[up, 1] - a[up, 1])
            odd[i] ^= bool((at > x).sum() % 2)
            near[i] |= np.hypot(a[:, 0] - x, a[:, 1] - y).min() < 3e-3
    return odd, near


@pytest.mark.parametrize("name", CASES)
def test_inside_equals_chords_in_a_map(spark, name):
    rings = CASES[name]
    rng = np.random.default_rng(len(name))
    middle = chords(rings[0]).mean(axis=0)
    some = np.concatenate([rng.normal(size=(200, 3)), middle / np.linalg.norm(middle) + 0.5 * rng.normal(size=(400, 3))])
    some /= np.linalg.norm(some, axis=1)[:, None]
    lonlat = np.degrees(np.stack([np.arctan2(some[:, 1], some[:, 0]), np.arcsin(some[:, 2])], axis=1))
    df = spark.createDataFrame([(i, [(float(x), float(y))]) for i, (x, y) in enumerate(lonlat)],
                               "i int, points array<struct<lon:double,lat:double>>")
    got = {r.i for r in SP.sphere_polygon_filter(df, rings).collect()}
    want, near = brute(rings, some)
    assert near.sum() < 100 and 20 < want.sum() < 550
    assert [i for i in range(len(some)) if not near[i] and (i in got) != want[i]] == []


def test_edges_and_missing_points(spark):
    rings = [[(10, 0), (50, 0), (50, 40), (10, 40)]]
    rows = [(0, [(10.0, 20.0)], True), (1, [(30.0, 0.0)], True), (2, [(50.0, 40.0)], True), (3, [(30.0, 40.5)], True),
            (4, [(30.0, 45.0)], False), (5, [(30.0, -0.01)], False), (6, [], False), (7, None, False),
            (8, [(None, 3.0), (30.0, 3.0)], True), (9, [(None, None)], False), (10, [(9.99, 20.0)], False), (11, [(390.0, 3.0)], True)]
    df = spark.createDataFrame(rows, "i int, points array<struct<lon:double,lat:double>>, want boolean")
    out = df.withColumn("got", SPH.any_inside("points", rings)).collect()
    assert [(r.i, r.got) for r in out] == [(r.i, r.want) for r in out]
    assert df.where(SPH.any_inside("points", [])).count() == 0
    poles = spark.createDataFrame([(1, [(77.0, 90.0)]), (2, [(77.0, -90.0)])], "i int, points array<struct<lon:double,lat:double>>")
    for name, want in (("around the north pole", [1]), ("around the south pole", [2]), ("pole as a vertex", [1]), ("box", []),
                       ("south pole as a vertex", [2])):
        assert [r.i for r in SP.sphere_polygon_filter(poles, CASES[name]).collect()] == want
    with pytest.raises(ValueError):
        SPH.outline([(0, 10), (180, 10), (90, 0)])
    with pytest.raises(ValueError):
        SPH.box_ring((-100, 0, 100, 10))
