"""Planar geometry as Column expressions (G1-G5, F8), no spatial library.

Geometries are arrays of ``struct<lon double, lat double>`` (projected rings
reuse the same field names for x / y). The builders emit SQL text in a small
common subset so the same formulas run in Spark (``F.expr``) and in DuckDB
(oracle SQL); ``SPARK`` and ``DUCK`` pick the array-function spelling.
Higher-order functions are evaluated per row inside the executor's stage.

A geometry of several rings (holes, further parts) is one vertex array too, with
a vertex without coordinates between its rings (``flat_rings``). An edge that
has such an end is NULL in every formula and so counts nowhere; the even-odd
rule over all rings at once leaves holes out, and distances take the nearest edge
of any ring.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


class Dialect:
    def __init__(self, name: str):
        self.name = name

    def seq(self, lo: str, hi: str) -> str:
        return f"sequence({lo}, {hi})" if self.name == "spark" else f"range({lo}, ({hi}) + 1)"

    def at(self, arr: str, i1: str) -> str:
        return f"element_at({arr}, {i1})" if self.name == "spark" else f"({arr})[{i1}]"

    def size(self, arr: str) -> str:
        return f"size({arr})" if self.name == "spark" else f"len({arr})"

    def exists(self, arr: str, var: str, pred: str) -> str:
        if self.name == "spark":
            return f"coalesce(exists({arr}, {var} -> {pred}), false)"
        return f"coalesce(list_bool_or(list_transform({arr}, {var} -> {pred})), false)"

    def count_if(self, arr: str, var: str, pred: str) -> str:
        if self.name == "spark":
            return f"size(filter({arr}, {var} -> {pred}))"
        return f"len(list_filter({arr}, {var} -> {pred}))"

    def min_of(self, arr: str, var: str, expr: str) -> str:
        if self.name == "spark":
            return f"array_min(transform({arr}, {var} -> {expr}))"
        return f"list_min(list_transform({arr}, {var} -> {expr}))"

    def map(self, arr: str, var: str, expr: str) -> str:
        return f"transform({arr}, {var} -> {expr})" if self.name == "spark" else f"list_transform({arr}, {var} -> {expr})"

    def point(self, x: str, y: str) -> str:
        if self.name == "spark":
            return f"named_struct('lon', {x}, 'lat', {y})"
        return f"struct_pack(lon := {x}, lat := {y})"


SPARK = Dialect("spark")
DUCK = Dialect("duck")


def _edges(ring: str, d: Dialect) -> str:
    """Indexes 1..n-1 of a closed ring: edge i runs from vertex i to vertex i+1."""
    return d.seq("1", f"{d.size(ring)} - 1")


def _orient(ax, ay, bx, by, cx, cy) -> str:
    return f"(({bx}) - ({ax})) * (({cy}) - ({ay})) - (({by}) - ({ay})) * (({cx}) - ({ax}))"


def point_on_segment(px, py, ax, ay, bx, by) -> str:
    return (f"({_orient(ax, ay, bx, by, px, py)} = 0 AND {px} BETWEEN least({ax}, {bx}) AND greatest({ax}, {bx})"
            f" AND {py} BETWEEN least({ay}, {by}) AND greatest({ay}, {by}))")


def point_in_polygon(px: str, py: str, ring: str, d: Dialect = SPARK, var: str = "e") -> str:
    """G2 with closed edges: on an edge counts as inside ("intersects"), else even-odd crossings.

    The crossing test is division-free: compare signs of a cross product.
    """
    a = d.at(ring, var)
    b = d.at(ring, f"{var} + 1")
    ax, ay, bx, by = f"{a}.lon", f"{a}.lat", f"{b}.lon", f"{b}.lat"
    on = point_on_segment(px, py, ax, ay, bx, by)
    cross = (f"(({ay} > {py}) <> ({by} > {py}) AND "
             f"((({bx}) - ({ax})) * (({py}) - ({ay})) - (({px}) - ({ax})) * (({by}) - ({ay}))) "
             f"* sign(({by}) - ({ay})) > 0)")
    edges = _edges(ring, d)
    return f"({d.exists(edges, var, on)} OR {d.count_if(edges, var, cross)} % 2 = 1)"


def _seg_intersect(ax, ay, bx, by, cx, cy, dx, dy) -> str:
    o1 = f"sign({_orient(ax, ay, bx, by, cx, cy)})"
    o2 = f"sign({_orient(ax, ay, bx, by, dx, dy)})"
    o3 = f"sign({_orient(cx, cy, dx, dy, ax, ay)})"
    o4 = f"sign({_orient(cx, cy, dx, dy, bx, by)})"
    box = (f"greatest({ax}, {bx}) >= least({cx}, {dx}) AND greatest({cx}, {dx}) >= least({ax}, {bx}) AND "
           f"greatest({ay}, {by}) >= least({cy}, {dy}) AND greatest({cy}, {dy}) >= least({ay}, {by})")
    return f"({o1} * {o2} <= 0 AND {o3} * {o4} <= 0 AND {box})"


def polygons_intersect(ra: str, rb: str, d: Dialect = SPARK) -> str:
    """Closed polygons share a point: an edge pair touches/crosses, or one holds the other."""
    a1, a2 = d.at(ra, "i"), d.at(ra, "i + 1")
    b1, b2 = d.at(rb, "j"), d.at(rb, "j + 1")
    seg = _seg_intersect(f"{a1}.lon", f"{a1}.lat", f"{a2}.lon", f"{a2}.lat",
                         f"{b1}.lon", f"{b1}.lat", f"{b2}.lon", f"{b2}.lat")
    any_edge = d.exists(_edges(ra, d), "i", d.exists(_edges(rb, d), "j", seg))
    return f"({any_edge} OR {_start_inside(ra, rb, d, 'g', 'k')} OR {_start_inside(rb, ra, d, 'h', 'm')})"


def _start_inside(ra: str, rb: str, d: Dialect, at: str, var: str) -> str:
    """The first vertex of any ring of one geometry lies in the other."""
    first, before = d.at(ra, at), d.at(ra, f"greatest({at} - 1, 1)")
    starts = f"({at} = 1 OR {before}.lon IS NULL)"
    inside = point_in_polygon(f"{first}.lon", f"{first}.lat", rb, d, var)
    return d.exists(d.seq("1", d.size(ra)), at, f"({starts} AND {first}.lon IS NOT NULL AND {inside})")


def flat_rings(polygons: str) -> Column:
    """Polygons (arrays of rings) as one vertex array with an empty vertex between rings."""
    gap = "array(named_struct('lon', CAST(NULL AS DOUBLE), 'lat', CAST(NULL AS DOUBLE)))"
    each = f"flatten(transform(flatten({polygons}), r -> concat({gap}, r)))"
    return F.expr(f"CASE WHEN size(flatten({polygons})) > 0 THEN slice({each}, 2, size({each}) - 1) END")


def valid_polygons(polygons: str) -> Column:
    """F8 for polygons with rings: there is a ring, and each is valid."""
    return F.expr(f"coalesce(size(flatten({polygons})) > 0 AND forall(flatten({polygons}), r -> {valid_ring('r')}), false)")


def segment_distance(px, py, ax, ay, bx, by) -> str:
    """Euclidean distance from a point to a closed segment (degenerate segment = its point)."""
    dx, dy = f"(({bx}) - ({ax}))", f"(({by}) - ({ay}))"
    len2 = f"({dx} * {dx} + {dy} * {dy})"
    t = (f"(CASE WHEN {len2} = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, "
         f"((({px}) - ({ax})) * {dx} + (({py}) - ({ay})) * {dy}) / {len2})) END)")
    qx, qy = f"(({ax}) + {t} * {dx})", f"(({ay}) + {t} * {dy})"
    return f"sqrt(power(({px}) - {qx}, 2) + power(({py}) - {qy}, 2))"


def point_polygon_distance(px: str, py: str, ring: str, d: Dialect = SPARK) -> str:
    """0 inside or on the polygon, else the nearest edge distance."""
    a, b = d.at(ring, "s"), d.at(ring, "s + 1")
    edge = segment_distance(px, py, f"{a}.lon", f"{a}.lat", f"{b}.lon", f"{b}.lat")
    return (f"(CASE WHEN {point_in_polygon(px, py, ring, d)} THEN 0.0 "
            f"ELSE {d.min_of(_edges(ring, d), 's', edge)} END)")


def polygon_polygon_distance(ra: str, rb: str, d: Dialect = SPARK) -> str:
    """0 when they intersect, else min vertex-to-edge distance in both directions."""
    va, vb = d.at(ra, "u"), d.at(rb, "v")
    b1, b2 = d.at(rb, "w"), d.at(rb, "w + 1")
    a1, a2 = d.at(ra, "z"), d.at(ra, "z + 1")
    ab = d.min_of(d.seq("1", d.size(ra)), "u", d.min_of(_edges(rb, d), "w", segment_distance(
        f"{va}.lon", f"{va}.lat", f"{b1}.lon", f"{b1}.lat", f"{b2}.lon", f"{b2}.lat")))
    ba = d.min_of(d.seq("1", d.size(rb)), "v", d.min_of(_edges(ra, d), "z", segment_distance(
        f"{vb}.lon", f"{vb}.lat", f"{a1}.lon", f"{a1}.lat", f"{a2}.lon", f"{a2}.lat")))
    return f"(CASE WHEN {polygons_intersect(ra, rb, d)} THEN 0.0 ELSE least({ab}, {ba}) END)"


def ring_bbox(ring: str, d: Dialect = SPARK) -> dict[str, str]:
    """min/max of x and y over the ring's vertices."""
    out = {}
    for key, fld, agg in (("xmin", "lon", "min"), ("xmax", "lon", "max"), ("ymin", "lat", "min"),
                          ("ymax", "lat", "max")):
        vals = d.map(ring, "p", f"p.{fld}")
        out[key] = f"array_{agg}({vals})" if d.name == "spark" else f"list_{agg}({vals})"
    return out


def valid_ring(ring: str, d: Dialect = SPARK) -> str:
    """F8 (reduced): closed, >= 4 vertices, no NULL coordinate, non-zero shoelace area."""
    first, last = d.at(ring, "1"), d.at(ring, d.size(ring))
    a, b = d.at(ring, "q"), d.at(ring, "q + 1")
    terms = d.map(_edges(ring, d), "q", f"{a}.lon * {b}.lat - {b}.lon * {a}.lat")
    area = f"aggregate({terms}, 0D, (acc, t) -> acc + t)" if d.name == "spark" else f"list_sum({terms})"
    nulls = d.exists(ring, "p", "p.lon IS NULL OR p.lat IS NULL")
    return (f"({ring} IS NOT NULL AND {d.size(ring)} >= 4 AND NOT {nulls} AND {first}.lon = {last}.lon AND "
            f"{first}.lat = {last}.lat AND {area} <> 0)")


# ------------------------------------------------------------------ G1 -----
# Fixed projection constants: GRS80 ellipsoid; EPSG:3035 (LAEA Europe) and
# EPSG:3310 (California Albers); Snyder, USGS PP 1395, pp. 98-103, 187-190.
GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101
WEB_MERCATOR_R = 6378137.0
_E2 = 2 * GRS80_F - GRS80_F ** 2
_E = math.sqrt(_E2)


def _q(phi: float) -> float:
    s = math.sin(phi)
    return (1 - _E2) * (s / (1 - _E2 * s * s) - (1 / (2 * _E)) * math.log((1 - _E * s) / (1 + _E * s)))


def _q_sql(lat: str) -> str:
    s = f"sin(radians({lat}))"
    return (f"({1 - _E2!r} * ({s} / (1 - {_E2!r} * {s} * {s}) - {1 / (2 * _E)!r} * "
            f"ln((1 - {_E!r} * {s}) / (1 + {_E!r} * {s}))))")


def mercator_sql(lon: str, lat: str) -> tuple[str, str]:
    """EPSG:3857."""
    r = WEB_MERCATOR_R
    return f"({r!r} * radians({lon}))", f"({r!r} * ln(tan(pi() / 4 + radians({lat}) / 2)))"


def laea_sql(lon: str, lat: str, lat0: float = 52.0, lon0: float = 10.0, fe: float = 4321000.0,
             fn: float = 3210000.0) -> tuple[str, str]:
    """EPSG:3035 by default (ellipsoidal Lambert azimuthal equal-area, oblique aspect)."""
    a = GRS80_A
    qp = _q(math.pi / 2)
    p1 = math.radians(lat0)
    b1 = math.asin(_q(p1) / qp)
    rq = a * math.sqrt(qp / 2)
    dd = a * (math.cos(p1) / math.sqrt(1 - _E2 * math.sin(p1) ** 2)) / (rq * math.cos(b1))
    beta = f"asin({_q_sql(lat)} / {qp!r})"
    dl = f"radians(({lon}) - {lon0!r})"
    bb = (f"({rq!r} * sqrt(2 / (1 + {math.sin(b1)!r} * sin({beta}) + "
          f"{math.cos(b1)!r} * cos({beta}) * cos({dl}))))")
    x = f"({fe!r} + {bb} * {dd!r} * cos({beta}) * sin({dl}))"
    y = (f"({fn!r} + ({bb} / {dd!r}) * ({math.cos(b1)!r} * sin({beta}) - "
         f"{math.sin(b1)!r} * cos({beta}) * cos({dl})))")
    return x, y


def albers_sql(lon: str, lat: str, lat1: float = 34.0, lat2: float = 40.5, lat0: float = 0.0,
               lon0: float = -120.0, fe: float = 0.0, fn: float = -4000000.0) -> tuple[str, str]:
    """EPSG:3310 by default (ellipsoidal Albers equal-area conic)."""
    a = GRS80_A

    def m(phi):
        return math.cos(phi) / math.sqrt(1 - _E2 * math.sin(phi) ** 2)

    p1, p2, p0 = map(math.radians, (lat1, lat2, lat0))
    m1, m2 = m(p1), m(p2)
    q1, q2, q0 = _q(p1), _q(p2), _q(p0)
    n = (m1 ** 2 - m2 ** 2) / (q2 - q1)
    c = m1 ** 2 + n * q1
    rho0 = a * math.sqrt(c - n * q0) / n
    rho = f"({a / n!r} * sqrt({c!r} - {n!r} * {_q_sql(lat)}))"
    theta = f"({n!r} * radians(({lon}) - {lon0!r}))"
    return f"({fe!r} + {rho} * sin({theta}))", f"({fn!r} + {rho0!r} - {rho} * cos({theta}))"


PROJECTIONS = {"EPSG:3857": mercator_sql, "EPSG:3035": laea_sql, "EPSG:3310": albers_sql}


def project_ring_sql(ring: str, crs: str, d: Dialect = SPARK) -> str:
    x, y = PROJECTIONS[crs]("p.lon", "p.lat")
    return d.map(ring, "p", d.point(x, y))


def project(lon, lat, crs: str) -> tuple[Column, Column]:
    """G1 as Columns: (x, y) in the target CRS from lon/lat degrees (EPSG:4326)."""
    lon_s = lon if isinstance(lon, str) else None
    lat_s = lat if isinstance(lat, str) else None
    if lon_s is None or lat_s is None:
        raise TypeError("project() takes column names")
    x, y = PROJECTIONS[crs](f"`{lon_s}`", f"`{lat_s}`")
    return F.expr(x), F.expr(y)


def project_ring(ring: str, crs: str) -> Column:
    return F.expr(project_ring_sql(ring, crs))


def mercator_inverse(x: str, y: str) -> tuple[Column, Column]:
    """EPSG:3857 back to lon/lat degrees (grids are shipped in 3857 and joined in 4326)."""
    r = WEB_MERCATOR_R
    return (F.expr(f"degrees(({x}) / {r!r})"),
            F.expr(f"degrees(2 * atan(exp(({y}) / {r!r})) - pi() / 2)"))
