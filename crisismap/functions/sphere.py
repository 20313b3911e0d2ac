"""Points in polygons whose edges are great circles (F4, F5, G2 on the sphere).

A point lies inside if the meridian from it to the north pole crosses the outline an odd number of
times, or an even number if the outline holds the pole. An edge is the shorter arc between its ends, so an
outline may cross the 180th meridian or go around a pole; of an outline around the poles the smaller side
is the inside. An edge is kept as the longitude where it begins in the west, its width in degrees, and the
normal of its plane that points north: a point is north of the edge if its product with the normal is
positive. So a point's sines and cosines are worked out once, and an edge costs three products.
Points within ``NEAR`` radians of an edge are on it, which counts as inside.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR = 1e-12


class Edge(NamedTuple):
    west: float
    width: float
    normal: tuple[float, float, float] | None  # None: along the north pole, north of everything
    south: float
    north: float


def _unit(lon: float, lat: float) -> tuple[float, float, float]:
    a, b = math.radians(lon), math.radians(lat)
    return math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)


def _turn(a: float, b: float) -> float:
    """Degrees from longitude a to b the shorter way, east positive."""
    return (b - a + 180.0) % 360.0 - 180.0


def _edge(a: tuple[float, float], b: tuple[float, float]) -> Edge:
    turn = _turn(a[0], b[0])
    if turn == -180.0:
        raise ValueError(f"an edge over a pole, from {a} to {b}: give the pole as a vertex")
    if turn < 0:
        a, b = b, a
    (ax, ay, az), (bx, by, bz) = _unit(*a), _unit(*b)
    normal = ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx
    size = math.hypot(*normal)
    return Edge(a[0], abs(turn), tuple(x / size for x in normal), min(a[1], b[1]), max(a[1], b[1]))


def outline(ring: Sequence[tuple[float, float]]) -> tuple[list[Edge], bool]:
    """Edges of a ring of (lon, lat), closed or not, and whether it holds the north pole.

    Repeated vertices make no edge. A pole as a vertex has the longitudes of both its neighbours. The pole is held if
    the ring goes around the poles and the area between it and the equator, going east, is north of the equator on
    balance: then the cap at the north pole is the smaller side.
    """
    ring = [*map(tuple, ring)]
    ring = [p for p, after in zip(ring, [*ring[1:], *ring[:1]], strict=True) if p != after]
    sides = zip(ring, [*ring[-1:], *ring[:-1]], [*ring[1:], *ring[:1]], strict=True)
    ring = [v for p, before, after in sides
            for v in ([(before[0], p[1]), (after[0], p[1])] if abs(p[1]) == 90.0 else [p])]
    pairs = [(a, b) for a, b in zip(ring, [*ring[1:], *ring[:1]], strict=True) if a != b]
    edges = []
    for a, b in pairs:
        if a[1] == b[1] == 90.0:
            turn = _turn(a[0], b[0])
            edges.append(Edge(a[0] if turn > 0 else b[0], abs(turn), None, 90.0, 90.0))
        elif not a[1] == b[1] == -90.0:
            edges.append(_edge(a, b))
    around = sum(_turn(a[0], b[0]) for a, b in pairs)
    if abs(around) < 180.0:
        return edges, False
    area = 0.0
    for a, b in pairs:
        half, s, t = math.radians(_turn(a[0], b[0])) / 2, *(math.tan(math.radians(p[1]) / 2) for p in (a, b))
        area += 2 * math.atan2(math.tan(half) * (s + t), 1 + s * t)
    return edges, area * around > 0


def point_struct(lon: str, lat: str) -> str:
    """SQL text of a point with its place on the unit sphere."""
    return (f"named_struct('lon', {lon}, 'lat', {lat}, 'x', cos(radians({lat})) * cos(radians({lon})), "
            f"'y', cos(radians({lat})) * sin(radians({lon})), 'z', sin(radians({lat})))")


def inside(point: str, rings: Sequence[Sequence[tuple[float, float]]]) -> str:
    """SQL text: the point (of ``point_struct``) lies in the polygon of these rings, holes by the even-odd rule."""
    on, crossed, poles = [], [], 0
    for edges, pole in map(outline, rings):
        poles += pole
        for west, width, normal, south, north in edges:
            along = f"pmod({point}.lon - {west!r}D, 360D)"
            if normal is None:
                crossed.append(f"CASE WHEN {along} < {width!r}D THEN 1 ELSE 0 END")
                continue
            x, y, z = normal
            above = f"({point}.x * {x!r}D + {point}.y * {y!r}D + {point}.z * {z!r}D)"
            if width == 0:
                on.append(f"({along} = 0 AND {point}.lat BETWEEN {south!r}D AND {north!r}D)")
                on += [f"{point}.lat = {lat!r}D" for lat in (south, north) if abs(lat) == 90.0]
            else:
                on.append(f"({along} <= {width!r}D AND abs({above}) <= {NEAR!r}D)")
                crossed.append(f"CASE WHEN {along} < {width!r}D AND {above} < 0 THEN 1 ELSE 0 END")
    if not on:
        return "false"
    return f"({' OR '.join(on)} OR ({' + '.join([str(poles), *crossed])}) % 2 = 1)"


def any_inside(points: str, rings: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """F5 on the sphere: any point of an array of (lon, lat) structs lies in the polygon; NULL coordinates lie nowhere."""
    placed = f"transform({points}, p -> {point_struct('p.lon', 'p.lat')})"
    return F.coalesce(F.expr(f"exists({placed}, q -> coalesce({inside('q', rings)}, false))"), F.lit(False))


def box_ring(box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """The box (lon0, lat0, lon1, lat1) as a polygon of its four corners; from lon0 eastwards to lon1, under 180 degrees.

    Its north and south sides are great circles, so they bulge towards the pole. lon0 above lon1 is a box over
    the 180th meridian.
    """
    x0, y0, x1, y1 = map(float, box)
    if not 0 < (x1 - x0) % 360 < 180:
        raise ValueError("a box on the sphere must be less than 180 degrees wide")
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
