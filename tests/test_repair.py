"""Repaired polygons against the even-odd rule at random points and hand-made faults."""

import numpy as np
import pytest

from crisismap.operators import repair as RP


def ring(*corners):
    return np.array([*corners, corners[0]], float)


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def odd(rings, points):
    out = np.zeros(len(points), bool)
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, [*r[1:], r[0]]):
            if y1 != y2:
                over = (y1 > points[:, 1]) != (y2 > points[:, 1])
                out ^= over & (points[:, 0] < x1 + (points[:, 1] - y1) * (x2 - x1) / (y2 - y1))
    return out


def area(polygons):
    return sum(RP._area(r[:-1]) for p in polygons for r in p)


HOLED = [[box(0, 0, 4, 4), box(1, 1, 2, 2)]]
# (polygons, valid, parts, rings, area)
CASES = {
    "box": ([[box(0, 0, 2, 2)]], True, 1, 1, 4),
    "clockwise, straight vertex": ([[ring((0, 0), (0, 2), (2, 2), (2, 1), (2, 0))]], True, 1, 1, 4),
    "hole": (HOLED, True, 1, 2, 15),
    "hole with an island": ([[box(0, 0, 9, 9), box(1, 1, 8, 8)], [box(2, 2, 3, 3)]], True, 2, 3, 33),
    "hole that touches in a point": ([[box(0, 0, 4, 4), ring((0, 2), (1, 1), (2, 2), (1, 3))]], True, 1, 2, 14),
    "parts that touch in a point": ([[box(0, 0, 1, 1)], [box(1, 1, 2, 2)]], True, 2, 2, 2),
    "repeated vertex": ([[ring((0, 0), (2, 0), (2, 0), (2, 2), (0, 2))]], True, 1, 1, 4),
    "bow-tie": ([[ring((0, 0), (2, 2), (2, 0), (0, 2))]], False, 2, 2, 2),
    "spike": ([[ring((0, 0), (2, 0), (2, 1), (5, 1), (2, 1), (2, 2), (0, 2))]], False, 1, 1, 4),
    "overlapping parts": ([[box(0, 0, 2, 2)], [box(1, 1, 3, 3)]], False, 2, 2, 6),
    "parts with a common side": ([[box(0, 0, 1, 1)], [box(1, 0, 2, 1)]], False, 1, 1, 2),
    "the same part twice": ([[box(0, 0, 1, 1)], [box(0, 0, 1, 1)]], False, 0, 0, 0),
    "part in a part": ([[box(0, 0, 4, 4)], [box(1, 1, 2, 2)]], False, 1, 2, 15),
    "hole outside": ([[box(0, 0, 1, 1), box(2, 0, 3, 1)]], False, 2, 2, 2),
    "ring that touches itself": ([[ring((0, 0), (4, 0), (4, 4), (2, 0), (0, 4))]], False, 2, 2, 8),
    "open": ([[box(0, 0, 2, 2)[:-1]]], False, 1, 1, 4),
    "missing vertex": ([[np.array([(0, 0), (2, 0), (np.nan, 1), (2, 2), (0, 2), (0, 0)], float)]], False, 1, 1, 4),
    "line": ([[ring((0, 0), (2, 0))]], False, 0, 0, 0),
    "nothing": ([], False, 0, 0, 0),
    "no rings": ([[]], False, 0, 0, 0),
}


@pytest.mark.parametrize("name", CASES)
def test_known_faults(name):
    polygons, valid, parts, rings, size = CASES[name]
    ok, out = RP.repair_polygons(polygons)
    assert (ok, len(out), sum(map(len, out)), area(out)) == (valid, parts, rings, size)
    if parts:
        again, same = RP.repair_polygons(out)
        assert again and all((a == b).all() for p, q in zip(out, same) for a, b in zip(p, q))


@pytest.mark.parametrize("block", [RP.PAIRS_A_BLOCK, 7])
def test_random_rings_keep_their_even_odd_ground(monkeypatch, block):
    monkeypatch.setattr(RP, "PAIRS_A_BLOCK", block)
    for seed in range(25):
        rng = np.random.default_rng(seed)
        grid = seed % 2 == 0  # whole numbers: many vertices on edges and edges on edges
        polygons = [[ring(*(rng.integers(0, 7, (n, 2)) if grid else rng.random((n, 2)) * 6)) for n in rng.integers(3, 9, 2)]
                    for _ in range(rng.integers(1, 4))]
        _, out = RP.repair_polygons(polygons)
        points = rng.random((3000, 2)) * 7
        want = odd([r for p in polygons for r in p], points)
        each = np.array([odd(p, points) for p in out]).reshape(len(out), -1)
        assert (each.sum(axis=0) == want).all(), seed  # every odd place in exactly one polygon
        for p in out:
            assert RP._area(p[0][:-1]) > 0 and all(RP._area(h[:-1]) < 0 for h in p[1:])
            for r in p:
                assert len({*map(tuple, r[:-1].tolist())}) == len(r) - 1
        again, same = RP.repair_polygons(out)
        assert again and np.isclose(area(out), area(same)), seed


def test_large_ring():
    turn = np.linspace(0, 2 * np.pi, 20_000, endpoint=False)
    star = np.stack([np.cos(turn) * (2 + np.cos(40 * turn)), np.sin(turn) * (2 + np.cos(40 * turn))], axis=1)
    ok, out = RP.repair_polygons([[ring(*star)]])
    assert ok and np.isclose(area(out), RP._area(star))


def test_column_keeps_valid_ones_and_nulls(spark):
    def plain(polygons):
        return [[[(float(x), float(y)) for x, y in r] for r in p] for p in polygons]

    rows = [(i, plain(case[0])) for i, case in enumerate(CASES.values()) if "missing" not in list(CASES)[i]]
    rows += [(100, None), (101, [None]), (102, [[None]]), (103, [[[(0.0, 0.0), None, (1.0, 0.0), (1.0, 1.0), (0.0, None), (0.0, 0.0)]]])]
    df = spark.createDataFrame(rows, f"i int, polygons array<array<array<{RP.POINT}>>>")
    got = {r.i: r for r in RP.make_valid(df).collect()}
    for i, case in enumerate(CASES.values()):
        if i in got:
            assert (got[i].valid, len(got[i].polygons), sum(map(len, got[i].polygons))) == case[1:4], i
            if case[1]:
                assert [[[tuple(p) for p in r] for r in q] for q in got[i].polygons] == plain(case[0])
    assert got[100].valid is None and got[100].polygons is None
    assert [(got[i].valid, got[i].polygons) for i in (101, 102)] == [(False, [])] * 2
    assert not got[103].valid and len(got[103].polygons) == 1
    assert RP.make_valid(df.limit(0)).count() == 0
