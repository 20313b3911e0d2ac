"""Registered queries: spatial joins, grid aggregation and hazard statistics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from crisismap.functions import geometry as G
from crisismap.functions.text import parse_created_at
from crisismap.operators import posts as P
from crisismap.operators import repair as RP
from crisismap.operators import spatial as SP
from crisismap.operators import stats as S
from crisismap.plans import fixtures as fx
from crisismap.plans.oracle_views import with_views

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None, views=()):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        return fn
    return deco


# ----------------------------------------------------------- shared pieces --
def post_points(spark, base):
    """P7 + P15 with the point's position kept as part of its identity."""
    p = P.with_points(fx.posts(spark, base))
    return p.select("cid", "crawl_seq", "ts", "disaster_related",
                    F.posexplode("points").alias("k", "pt")).select(
        "cid", "crawl_seq", "ts", "disaster_related", "k",
        F.col("pt.lon").alias("lon"), F.col("pt.lat").alias("lat"))


def point_cells(spark, base):
    return SP.points_in_cells(post_points(spark, base), fx.grid(spark))


def cell_counts(spark, base):
    grid = fx.grid(spark)
    counts = SP.cell_counts(point_cells(spark, base), ["level", "cell_id"])
    return SP.fill_grid(grid, counts, ["level", "cell_id"], ["count", "count_related"])


def flood_flags(spark, base):
    return SP.intersects_any(fx.grid(spark), fx.floods(spark, base), hazard_ring="ring", flag="intersects")


def fire_flags(spark, base):
    grid = fx.grid(spark)
    hits = SP.points_in_cells(fx.fires(spark, base).select("lon", "lat"), grid)
    hit_cells = hits.select("level", "cell_id").distinct().withColumn("intersects", F.lit(True))
    return grid.join(hit_cells, ["level", "cell_id"], "left").fillna(False, subset=["intersects"])


def nearest_fire(spark, base):
    return SP.nearest_distance(fx.grid(spark), fx.fires(spark, base), "EPSG:3310")


def nearest_flood(spark, base):
    return SP.nearest_distance(fx.grid(spark), fx.floods(spark, base), "EPSG:3035", hazard_ring="ring")


PP_SQL = """pp AS (
  SELECT cid, crawl_seq, ts, disaster_related, unnest(range(len(pts))) AS k, unnest(pts) AS pt
  FROM (SELECT *, list_filter(toponyms, t -> t.longitude IS NOT NULL AND t.latitude IS NOT NULL) AS pts FROM posts))"""
IN_CELL = """pt.longitude BETWEEN g.x0 AND g.x0 + 2 AND pt.latitude BETWEEN g.y0 AND g.y0 + 2 AND
  (g.shape = 'sq' OR (g.shape = 'a' AND pt.latitude - g.y0 <= pt.longitude - g.x0)
                  OR (g.shape = 'b' AND pt.latitude - g.y0 >= pt.longitude - g.x0))"""
PC_SQL = f"pc AS (SELECT pp.*, g.level, g.cell_id FROM pp JOIN grid g ON {IN_CELL})"
COUNTS_SQL = """cc AS (
  SELECT g.level, g.cell_id, CAST(coalesce(c.count, 0) AS BIGINT) AS count,
    CAST(coalesce(c.count_related, 0) AS BIGINT) AS count_related
  FROM grid g LEFT JOIN (SELECT level, cell_id, count(*) AS count,
    count(*) FILTER (WHERE disaster_related = 1) AS count_related FROM pc GROUP BY ALL) c
  ON g.cell_id = c.cell_id AND g.level = c.level)"""
# closed-form box-vs-cell overlap (squares and the two diagonal halves)
FLOOD_HIT = """EXISTS (SELECT 1 FROM floods f WHERE
  greatest(f.cx - f.half, g.x0) <= least(f.cx + f.half, g.x0 + 2) AND
  greatest(f.cy - f.half, g.y0) <= least(f.cy + f.half, g.y0 + 2) AND
  (g.shape = 'sq'
   OR (g.shape = 'a' AND greatest(f.cy - f.half, g.y0) - least(f.cx + f.half, g.x0 + 2) <= g.y0 - g.x0)
   OR (g.shape = 'b' AND least(f.cy + f.half, g.y0 + 2) - greatest(f.cx - f.half, g.x0) >= g.y0 - g.x0)))"""
FIRE_HIT = """EXISTS (SELECT 1 FROM (SELECT struct_pack(longitude := lon, latitude := lat) AS pt FROM fires) q
  WHERE """ + IN_CELL.replace("pt.", "q.pt.") + ")"
FLAGS_SQL = f"ff AS (SELECT g.level, g.cell_id, {FLOOD_HIT} AS intersects FROM grid g)"
FIREFLAGS_SQL = f"fi AS (SELECT g.level, g.cell_id, {FIRE_HIT} AS intersects FROM grid g)"

# The SQL's own projections and distances share nothing with functions/geometry.py: inverse hyperbolic tangents for the authalic
# latitude, tables of edges, and the convexity of the shapes.
# GRS80; EPSG:3310 (parallels 34 and 40.5, meridian -120); EPSG:3035 (centre 10, 52).
_A, _E2 = 6378137.0, 2 / 298.257222101 - 1 / 298.257222101 ** 2
_E = math.sqrt(_E2)


def _authalic(s: float) -> float:
    return (1 - _E2) * (s / (1 - _E2 * s * s) + math.atanh(_E * s) / _E)


def _authalic_sql(lat: str) -> str:
    s = f"sin(radians({lat}))"
    return f"({1 - _E2!r} * ({s} / (1 - {_E2!r} * {s} * {s}) + atanh({_E!r} * {s}) / {_E!r}))"


def _parallel(lat: float) -> float:
    s = math.sin(math.radians(lat))
    return math.cos(math.radians(lat)) / math.sqrt(1 - _E2 * s * s)


def projected_sql(crs: int, lon: str, lat: str) -> tuple[str, str]:
    """DuckDB expressions of the x and y of a place."""
    q = _authalic_sql(lat)
    if crs == 3857:
        return f"({_A!r} * radians({lon}))", f"({_A!r} * ln(tan(pi() / 4 + radians({lat}) / 2)))"
    if crs == 3310:
        q1, q2 = (_authalic(math.sin(math.radians(v))) for v in (34.0, 40.5))
        n = (_parallel(34.0) ** 2 - _parallel(40.5) ** 2) / (q2 - q1)
        c = _parallel(34.0) ** 2 + n * q1
        radius, turn = f"({_A / n!r} * sqrt({c!r} - {n!r} * {q}))", f"({n!r} * radians({lon} + 120))"
        return f"({radius} * sin({turn}))", f"({_A / n * math.sqrt(c)!r} - {radius} * cos({turn}) - 4000000)"
    pole, centre = _authalic(1.0), math.asin(_authalic(math.sin(math.radians(52.0))) / _authalic(1.0))
    size = _A * math.sqrt(pole / 2)
    ratio = _A * _parallel(52.0) / (size * math.cos(centre))
    lift, turn = f"asin({q} / {pole!r})", f"radians({lon} - 10)"
    scale = (f"({size!r} * sqrt(2 / (1 + {math.sin(centre)!r} * sin({lift}) + {math.cos(centre)!r} * cos({lift}) * cos({turn}))))")
    return (f"(4321000 + {scale} * {ratio!r} * cos({lift}) * sin({turn}))",
            f"(3210000 + {scale} / {ratio!r} * ({math.cos(centre)!r} * sin({lift}) - {math.sin(centre)!r} * cos({lift}) * cos({turn})))")


def _segment_sql(px: str, py: str, e: str) -> str:
    """Distance of a point from the edge (ax, ay, bx, by) of ``e``."""
    dx, dy = f"({e}.bx - {e}.ax)", f"({e}.by - {e}.ay)"
    t = f"greatest(0, least(1, (({px} - {e}.ax) * {dx} + ({py} - {e}.ay) * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    return f"sqrt(pow({px} - {e}.ax - {t} * {dx}, 2) + pow({py} - {e}.ay - {t} * {dy}, 2))"


def _ray_sql(px: str, py: str, e: str) -> str:
    return f"(({e}.ay > {py}) <> ({e}.by > {py}) AND {px} < {e}.ax + ({py} - {e}.ay) / nullif({e}.by - {e}.ay, 0) * ({e}.bx - {e}.ax))"


def _side_sql(e: str, px: str, py: str) -> str:
    return f"sign(({e}.bx - {e}.ax) * ({py} - {e}.ay) - ({e}.by - {e}.ay) * ({px} - {e}.ax))"


def _cell_edges_sql(crs: int) -> str:
    (ax, ay), (bx, by) = projected_sql(crs, "(x0 + u1)", "(y0 + v1)"), projected_sql(crs, "(x0 + u2)", "(y0 + v2)")
    return f"""k(shape, no, u1, v1, u2, v2) AS (VALUES ('sq', 1, 0, 0, 2, 0), ('sq', 2, 2, 0, 2, 2), ('sq', 3, 2, 2, 0, 2), ('sq', 4, 0, 2, 0, 0),
  ('a', 1, 0, 0, 2, 0), ('a', 2, 2, 0, 2, 2), ('a', 3, 2, 2, 0, 0), ('b', 1, 0, 0, 2, 2), ('b', 2, 2, 2, 0, 2), ('b', 3, 0, 2, 0, 0)),
ce AS (SELECT level, cell_id, no, {ax} AS ax, {ay} AS ay, {bx} AS bx, {by} AS by FROM grid JOIN k USING (shape))"""


_px, _py = projected_sql(3310, "lon", "lat")
NEAR_FIRE_SQL = f"""{_cell_edges_sql(3310)},
h AS (SELECT DISTINCT {_px} AS hx, {_py} AS hy FROM fires),
hd AS (SELECT level, cell_id, min({_segment_sql('hx', 'hy', 'ce')}) AS dist, count(*) FILTER (WHERE {_ray_sql('hx', 'hy', 'ce')}) AS rays
       FROM ce CROSS JOIN h GROUP BY level, cell_id, hx, hy),
nf AS (SELECT level, cell_id, min(CASE WHEN rays % 2 = 1 THEN 0 ELSE dist END) AS min_distance FROM hd GROUP BY ALL)"""
_fa, _fb = projected_sql(3035, "(cx + u1 * half)", "(cy + v1 * half)"), projected_sql(3035, "(cx + u2 * half)", "(cy + v2 * half)")
NEAR_FLOOD_SQL = f"""{_cell_edges_sql(3035)},
w(no, u1, v1, u2, v2) AS (VALUES (1, -1, -1, 1, -1), (2, 1, -1, 1, 1), (3, 1, 1, -1, 1), (4, -1, 1, -1, -1)),
fe AS (SELECT flood_id, no, {_fa[0]} AS ax, {_fa[1]} AS ay, {_fb[0]} AS bx, {_fb[1]} AS by FROM floods CROSS JOIN w),
pd AS (SELECT level, cell_id, min(least({_segment_sql('fe.ax', 'fe.ay', 'ce')}, {_segment_sql('ce.ax', 'ce.ay', 'fe')})) AS dist,
         bool_or({_side_sql('ce', 'fe.ax', 'fe.ay')} * {_side_sql('ce', 'fe.bx', 'fe.by')} < 0
             AND {_side_sql('fe', 'ce.ax', 'ce.ay')} * {_side_sql('fe', 'ce.bx', 'ce.by')} < 0) AS crossed,
         count(*) FILTER (WHERE fe.no = 1 AND {_ray_sql('fe.ax', 'fe.ay', 'ce')}) AS in_cell,
         count(*) FILTER (WHERE ce.no = 1 AND {_ray_sql('ce.ax', 'ce.ay', 'fe')}) AS in_flood
       FROM ce CROSS JOIN fe GROUP BY level, cell_id, flood_id),
nd AS (SELECT level, cell_id, min(CASE WHEN crossed OR in_cell % 2 = 1 OR in_flood % 2 = 1 THEN 0 ELSE dist END) AS min_distance
       FROM pd GROUP BY ALL)"""


# ------------------------------------------------------------------ step 3 --
@register("points_in_cells", views=("posts", "grid"), sql=f"""
WITH {PP_SQL}, {PC_SQL} SELECT cid, crawl_seq, CAST(k AS INTEGER) AS k, level, cell_id FROM pc""")
def points_in_cells_q(spark, base):
    """J2 + P15: every post point joined to every grid cell it intersects (both levels)."""
    return point_cells(spark, base).select("cid", "crawl_seq", "k", "level", "cell_id")


@register("cell_counts_filled", views=("posts", "grid"), sql=f"""
WITH {PP_SQL}, {PC_SQL}, {COUNTS_SQL} SELECT * FROM cc""")
def cell_counts_filled_q(spark, base):
    """A1 + J1: points per cell, all and related, on the full grid (zero-filled)."""
    return cell_counts(spark, base).select("level", "cell_id", "count", "count_related")


@register("weekly_cell_counts", views=("posts", "grid"), sql=f"""
WITH {PP_SQL}, {PC_SQL},
wk AS (SELECT DISTINCT isoyear(ts) AS iso_year, week(ts) AS week FROM pp WHERE ts IS NOT NULL),
c AS (SELECT level, cell_id, isoyear(ts) AS iso_year, week(ts) AS week, count(*) AS count FROM pc
      WHERE ts IS NOT NULL GROUP BY ALL)
SELECT g.level, g.cell_id, CAST(wk.iso_year AS INTEGER) AS iso_year, CAST(wk.week AS INTEGER) AS week,
  CAST(coalesce(c.count, 0) AS BIGINT) AS count
FROM grid g CROSS JOIN wk LEFT JOIN c ON c.level = g.level AND c.cell_id = g.cell_id AND c.iso_year = wk.iso_year
  AND c.week = wk.week""")
def weekly_cell_counts_q(spark, base):
    """A2 + T6 + T7: per ISO week (with ISO year) and cell, zero-filled over the weeks of all points; the time is
    parsed leniently from its text."""
    text = fx.posts(spark, base).withColumn("ts", parse_created_at("createdAt", strict=False).cast("timestamp_ntz"))
    pts = P.explode_points(P.with_points(text)).select("cid", "crawl_seq", "ts", "lon", "lat")
    pairs = SP.points_in_cells(pts, fx.grid(spark))
    out = SP.weekly_cell_counts(pairs, pts, fx.grid(spark))
    return out.select("level", "cell_id", F.col("iso_year").cast("int").alias("iso_year"),
                      F.col("week").cast("int").alias("week"), "count")


@register("intersects_flood", views=("grid", "floods"), sql=f"WITH {FLAGS_SQL} SELECT * FROM ff")
def intersects_flood_q(spark, base):
    """J5 + G4: does each cell intersect any flood polygon."""
    return flood_flags(spark, base).select("level", "cell_id", "intersects")


@register("intersects_fire", views=("grid", "fires"), sql=f"WITH {FIREFLAGS_SQL} SELECT * FROM fi")
def intersects_fire_q(spark, base):
    """J5 for point hazards: does each cell contain (or touch) any fire detection."""
    return fire_flags(spark, base).select("level", "cell_id", "intersects")


@register("nearest_fire", views=("grid", "fires"), sql=f"""
WITH {NEAR_FIRE_SQL} SELECT level, cell_id, round(min_distance, 3) AS min_distance FROM nf""")
def nearest_fire_q(spark, base):
    """J4 + G1 + G5: metres (EPSG:3310) from each cell polygon to the nearest fire point."""
    return nearest_fire(spark, base).select("level", "cell_id", F.round("min_distance", 3).alias("min_distance"))


# closed forms: a cell that meets the square but doesn't lie within its open hole, or that meets the second part; a
# triangle meets a box if their boxes meet and the box reaches its side of the diagonal
HOLED_SQL = """
f AS (SELECT 2 + ((s_suppkey * 37) % 248) / 8 AS cx, 36 + ((s_suppkey * 19) % 176) / 8 AS cy, 0.125 * (2 + s_suppkey % 23) AS half
      FROM supplier WHERE s_suppkey % 10 <> 1),
b AS (SELECT cx - half AS bx0, cx + half AS bx1, cy - half AS by0, cy + half AS by1, half - 0.125 AS hole, cx, cy FROM f
      UNION ALL SELECT cx + half + 0.25, cx + half + 0.5, cy - 0.125, cy + 0.125, NULL, cx, cy FROM f),
m AS (SELECT level, cell_id FROM grid g JOIN b ON
    greatest(bx0, x0) <= least(bx1, x0 + 2) AND greatest(by0, y0) <= least(by1, y0 + 2)
    AND (shape = 'sq' OR (shape = 'a' AND greatest(by0, y0) - least(bx1, x0 + 2) <= y0 - x0)
                      OR (shape = 'b' AND least(by1, y0 + 2) - greatest(bx0, x0) >= y0 - x0))
    AND NOT (hole IS NOT NULL AND x0 > cx - hole AND x0 + 2 < cx + hole AND y0 > cy - hole AND y0 + 2 < cy + hole)
  GROUP BY ALL)"""


@register("intersects_holed_flood", views=("grid",), sql=f"""
WITH {HOLED_SQL} SELECT g.level, g.cell_id, m.cell_id IS NOT NULL AS intersects FROM grid g LEFT JOIN m USING (level, cell_id)""")
def intersects_holed_flood_q(spark, base):
    """J5 + F8 + G4: flood polygons with a hole and a second part, the broken ones left out; a cell inside a hole stays dry."""
    floods = SP.valid_hazards(fx.lake_floods(spark, base))
    return SP.intersects_any(fx.grid(spark), floods, hazard_ring="ring", flag="intersects").select("level", "cell_id", "intersects")


@register("repaired_floods", sql="""
SELECT s_suppkey AS flood_id, s_suppkey % 5 = 0 AS valid, CAST(CASE WHEN s_suppkey % 5 IN (0, 2) THEN 1 ELSE 2 END AS INTEGER) AS parts,
  CAST(CASE WHEN s_suppkey % 5 = 2 THEN 1 ELSE 2 END AS INTEGER) AS rings,
  round(h * h * [3, 2, 4, 6, 4][s_suppkey % 5 + 1], 9) AS area
FROM (SELECT s_suppkey, CAST(0.25 * (1 + s_suppkey % 11) AS DOUBLE) AS h FROM supplier)""")
def repaired_floods_q(spark, base):
    """F8 + G3: flood polygons with bow-ties, spikes, overlapping parts and holes that stick out, made valid by even-odd area."""
    out = RP.make_valid(fx.faulty_floods(spark, base))
    size = """abs(aggregate(sequence(1, size(r) - 1), 0D, (a, i) -> a + (r[i - 1].lon * r[i].lat - r[i].lon * r[i - 1].lat) / 2))"""
    # a polygon's outer ring less its holes, whichever way they run
    area = F.expr(f"""aggregate(polygons, 0D, (s, p) -> s + aggregate(transform(p, r -> {size}), 0D, (t, x) -> t - x)
        + 2 * aggregate(transform(slice(p, 1, 1), r -> {size}), 0D, (t, x) -> t + x))""")
    return out.select("flood_id", "valid", F.size("polygons").alias("parts"), F.size(F.flatten("polygons")).alias("rings"),
                      F.round(area, 9).alias("area"))


@register("nearest_flood", views=("grid", "floods"), sql=f"""
WITH {NEAR_FLOOD_SQL} SELECT level, cell_id, round(min_distance, 3) AS min_distance FROM nd""")
def nearest_flood_q(spark, base):
    """J4 + G1 + G5: metres (EPSG:3035) from each cell polygon to the nearest flood polygon."""
    return nearest_flood(spark, base).select("level", "cell_id", F.round("min_distance", 3).alias("min_distance"))


@register("footprint_join", views=("floods", "footprints"), sql="""
SELECT DISTINCT f.flood_id, p.unique_id FROM floods f LEFT JOIN footprints p
  ON f.equi7grid_cont = p.equi7grid_cont AND f.equi7grid_tile_id = p.equi7grid_tile_id AND f.file_date = p.file_date
  AND abs(f.cx - p.fcx) <= f.half + p.fhalf AND abs(f.cy - p.fcy) <= f.half + p.fhalf""")
def footprint_join_q(spark, base):
    """Delineations left-joined to footprints on (continent, tile, date) and intersects."""
    out = SP.delineations_with_footprints(fx.floods(spark, base), fx.footprints(spark, base),
                                          ["equi7grid_cont", "equi7grid_tile_id", "file_date"])
    return out.select("flood_id", "unique_id").distinct()


# A concave region outline (multiples of 1/8 so both engines agree exactly).
REGION = [(4.0, 40.0), (20.0, 38.0), (28.5, 46.0), (18.0, 44.125), (12.0, 52.0), (3.0, 50.0), (4.0, 40.0)]
_REGION_EDGES = ", ".join(f"({x1!r}, {y1!r}, {x2!r}, {y2!r})" for (x1, y1), (x2, y2) in zip(REGION, REGION[1:]))


# rays to the right counted over a table of edges, by the point where each edge crosses the ray's height
@register("polygon_region_filter", views=("posts",), sql=f"""
WITH e(x1, y1, x2, y2) AS (SELECT CAST(a AS DOUBLE), CAST(b AS DOUBLE), CAST(c AS DOUBLE), CAST(d AS DOUBLE)
                           FROM (VALUES {_REGION_EDGES}) t(a, b, c, d)),
p AS (SELECT cid, crawl_seq, unnest(toponyms) AS t FROM posts),
q AS (SELECT cid, crawl_seq, t.longitude AS x, t.latitude AS y FROM p WHERE t.longitude IS NOT NULL AND t.latitude IS NOT NULL),
c AS (SELECT cid, crawl_seq, x, y,
        count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) AS crossings,
        bool_or((x2 - x1) * (y - y1) = (y2 - y1) * (x - x1) AND x BETWEEN least(x1, x2) AND greatest(x1, x2)
                AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) AS on_edge
      FROM q CROSS JOIN e GROUP BY ALL)
SELECT DISTINCT cid, crawl_seq FROM c WHERE on_edge OR crossings % 2 = 1""")
def polygon_region_filter_q(spark, base):
    """F5 + G2: posts with a point inside (or on the edge of) a concave region polygon."""
    return SP.polygon_filter(P.with_points(fx.posts(spark, base)), REGION).select("cid", "crawl_seq")


def _crossings_sql(points: str, edges: str, keys: str) -> str:
    """Of each point (x, y), whether it lies in an outline of great circles: crossings of its meridian with the edges
    (x1, y1, x2, y2) north of it, by the latitude at which an edge meets the meridian; west to east, no 180th meridian."""
    return f"""
SELECT {keys}, count(*) FILTER (WHERE (x1 > x) <> (x2 > x) AND meets > y) % 2 = 1
    OR bool_or((x1 = x AND y1 = y) OR (x1 = x AND x2 = x AND y BETWEEN least(y1, y2) AND greatest(y1, y2))) AS inside
FROM (SELECT *, CASE WHEN x1 <> x2 THEN degrees(atan((tan(radians(y1)) * sin(radians(x2 - x)) + tan(radians(y2)) * sin(radians(x - x1)))
        / sin(radians(x2 - x1)))) END AS meets FROM {points} CROSS JOIN {edges}) GROUP BY {keys}"""


_X0, _Y0, _X1, _Y1 = P.EUROPE_BOX
MOVED = 165.0


@register("sphere_box_points", views=("posts",), sql=f"""
WITH {PP_SQL}, p AS (SELECT cid, crawl_seq, k, pt.longitude AS x, pt.latitude AS y FROM pp),
e(x1, y1, x2, y2) AS (SELECT CAST(a AS DOUBLE), CAST(b AS DOUBLE), CAST(c AS DOUBLE), CAST(d AS DOUBLE) FROM (VALUES
  ({_X0}, {_Y0}, {_X1}, {_Y0}), ({_X1}, {_Y0}, {_X1}, {_Y1}), ({_X1}, {_Y1}, {_X0}, {_Y1}), ({_X0}, {_Y1}, {_X0}, {_Y0})) t(a, b, c, d)),
s AS ({_crossings_sql("p", "e", "cid, crawl_seq, k, x, y")})
SELECT cid, crawl_seq, CAST(k AS INTEGER) AS k, x BETWEEN {_X0} AND {_X1} AND y BETWEEN {_Y0} AND {_Y1} AS planar,
  inside AS sphere, inside AS moved FROM s""")
def sphere_box_points_q(spark, base):
    """F4 both ways: each post point in the region box as a plane rectangle and as a polygon on the sphere, and the
    latter with all longitudes moved so that the box lies over the 180th meridian."""
    pts = post_points(spark, base)
    over = tuple((v + MOVED + 180) % 360 - 180 if i % 2 == 0 else v for i, v in enumerate(P.EUROPE_BOX))
    one = pts.withColumn("one", F.array(F.struct("lon", "lat"))).withColumn(
        "far", F.array(F.struct((F.pmod(F.col("lon") + F.lit(MOVED + 180), F.lit(360.0)) - 180).alias("lon"), "lat")))
    return one.select("cid", "crawl_seq", "k", P.in_box("one").alias("planar"), P.in_sphere_box("one").alias("sphere"),
                      P.in_sphere_box("far", over).alias("moved"))


@register("sphere_region_filter", views=("posts",), sql=f"""
WITH {PP_SQL}, p AS (SELECT DISTINCT cid, crawl_seq, pt.longitude AS x, pt.latitude AS y FROM pp),
e(x1, y1, x2, y2) AS (SELECT CAST(a AS DOUBLE), CAST(b AS DOUBLE), CAST(c AS DOUBLE), CAST(d AS DOUBLE)
                      FROM (VALUES {_REGION_EDGES}) t(a, b, c, d)),
s AS ({_crossings_sql("p", "e", "cid, crawl_seq, x, y")})
SELECT DISTINCT cid, crawl_seq FROM s WHERE inside""")
def sphere_region_filter_q(spark, base):
    """F5 + G2 on the sphere: posts with a point in the concave region, its edges being great circles."""
    return SP.sphere_polygon_filter(P.with_points(fx.posts(spark, base)), [REGION]).select("cid", "crawl_seq")


_m, _l, _a = (projected_sql(crs, "lon", "lat") for crs in (3857, 3035, 3310))


@register("project_points", views=("fires",), sql=f"""
SELECT fire_id, round({_m[0]}, 3) AS x3857, round({_m[1]}, 3) AS y3857, round({_l[0]}, 3) AS x3035,
  round({_l[1]}, 3) AS y3035, round({_a[0]}, 3) AS x3310, round({_a[1]}, 3) AS y3310 FROM fires""")
def project_points_q(spark, base):
    """G1: fire points in EPSG:3857, 3035 and 3310 (closed-form projections)."""
    f = fx.fires(spark, base)
    cols = []
    for crs, tag in (("EPSG:3857", "3857"), ("EPSG:3035", "3035"), ("EPSG:3310", "3310")):
        x, y = G.project("lon", "lat", crs)
        cols += [F.round(x, 3).alias(f"x{tag}"), F.round(y, 3).alias(f"y{tag}")]
    return f.select("fire_id", *cols)


# ------------------------------------------------------------------ step 4 --
@register("describe_distance", views=("grid", "fires"), sql=f"""
WITH {NEAR_FIRE_SQL}
SELECT level, count(min_distance) AS count, round(avg(min_distance), 3) AS mean, round(stddev_samp(min_distance), 3) AS std,
  round(min(min_distance), 3) AS min, round(quantile_cont(min_distance, 0.25), 3) AS p25,
  round(quantile_cont(min_distance, 0.5), 3) AS p50, round(quantile_cont(min_distance, 0.75), 3) AS p75,
  round(max(min_distance), 3) AS max FROM nf GROUP BY level""")
def describe_distance_q(spark, base):
    """describe() of the nearest-fire distance per grid level."""
    d = S.describe(nearest_fire(spark, base), "min_distance", keys=["level"])
    return d.select("level", "count", *[F.round(c, 3).alias(c) for c in d.columns if c not in ("level", "count")])


@register("pearson_count_distance", views=("posts", "grid", "fires"), sql=f"""
WITH {PP_SQL}, {PC_SQL}, {COUNTS_SQL}, {NEAR_FIRE_SQL}
SELECT cc.level, count(*) AS n,
  round(CASE WHEN count(*) > 1 AND var_pop(cc.count) > 0 AND var_pop(nf.min_distance) > 0
             THEN corr(cc.count, nf.min_distance) END, 6) AS r
FROM cc JOIN nf ON cc.level = nf.level AND cc.cell_id = nf.cell_id
WHERE nf.min_distance IS NOT NULL GROUP BY cc.level""")
def pearson_count_distance_q(spark, base):
    """A13 + F7: Pearson r between posts per cell and distance to the nearest fire, per level."""
    joined = cell_counts(spark, base).join(nearest_fire(spark, base).select("level", "cell_id", "min_distance"),
                                           ["level", "cell_id"])
    out = S.pearson(joined, "count", "min_distance", keys=["level"])
    return out.select("level", "n", F.round("r", 6).alias("r"))


@register("pearson_p_value")
def pearson_p_value_q(spark, base):
    """The two-sided p of each level's r (DuckDB has no such distribution; known values are tested)."""
    joined = cell_counts(spark, base).join(nearest_fire(spark, base).select("level", "cell_id", "min_distance"),
                                           ["level", "cell_id"])
    return S.pearson_p(S.pearson(joined, "count", "min_distance", keys=["level"])).select("level", "n", "r", "p_value")


@register("describe_numeric", views=("posts", "grid"), sql=f"""
WITH {PP_SQL}, {PC_SQL}, {COUNTS_SQL},
l AS (SELECT 'count' AS "column", CAST(count AS DOUBLE) AS v FROM cc
      UNION ALL SELECT 'count_related', CAST(count_related AS DOUBLE) FROM cc)
SELECT "column", count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min,
  quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, max(v) AS max FROM l GROUP BY 1""")
def describe_numeric_q(spark, base):
    """describe() of every numeric column of the cell counts."""
    d = S.describe_columns(cell_counts(spark, base).select("count", "count_related"))
    return d.select("column", "count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "p25", "p50",
                    "p75", "max")


def _crosstab_sql(edges, labels, counts_cte, count_col, flags_cte):
    e = "[" + ", ".join(str(x) for x in edges) + "]"
    lab = "[" + ", ".join(f"'{x}'" for x in labels) + "]"
    return f"""
d AS (SELECT c.level, c.{count_col} AS cnt, f.intersects FROM {counts_cte} c JOIN {flags_cte} f
      ON c.level = f.level AND c.cell_id = f.cell_id),
e AS (SELECT level, list_concat(list_filter({e}, x -> x <= max(cnt)), [max(cnt) + 1]) AS edges FROM d GROUP BY level),
b AS (SELECT level, i - 1 AS bin, {lab}[i] AS count_bin, edges[i] AS lower, edges[i + 1] AS upper
      FROM (SELECT level, edges, unnest(range(1, len(edges))) AS i FROM e) WHERE i <= {len(labels)}),
x AS (SELECT d.level, b.bin, count(*) FILTER (WHERE NOT d.intersects) AS no_hazard,
        count(*) FILTER (WHERE d.intersects) AS hazard
      FROM d JOIN b ON d.level = b.level AND d.cnt >= b.lower AND d.cnt < b.upper GROUP BY ALL)
SELECT b.level, CAST(b.bin AS INTEGER) AS bin, b.count_bin, CAST(b.lower AS BIGINT) AS lower,
  CAST(b.upper AS BIGINT) AS upper, CAST(coalesce(x.no_hazard, 0) AS BIGINT) AS no_hazard,
  CAST(coalesce(x.hazard, 0) AS BIGINT) AS hazard
FROM b LEFT JOIN x ON b.level = x.level AND b.bin = x.bin"""


@register("binned_crosstab_flood", views=("posts", "grid", "floods"), sql=f"""
WITH {PP_SQL}, {PC_SQL}, {COUNTS_SQL}, {FLAGS_SQL},
{_crosstab_sql(S.FLOOD_EDGES, S.FLOOD_LABELS, 'cc', 'count_related', 'ff')}""")
def binned_crosstab_flood_q(spark, base):
    """M3 + A10 + F12: related posts per cell binned with the flood edges x flood flag, per level."""
    d = cell_counts(spark, base).join(flood_flags(spark, base).select("level", "cell_id", "intersects"),
                                      ["level", "cell_id"])
    return S.binned_crosstab(d, "count_related", "intersects", S.FLOOD_EDGES, S.FLOOD_LABELS, keys=["level"])


@register("binned_crosstab_fire", views=("posts", "grid", "fires"), sql=f"""
WITH {PP_SQL}, {PC_SQL}, {COUNTS_SQL}, {FIREFLAGS_SQL},
{_crosstab_sql(S.FIRE_EDGES, S.FIRE_LABELS, 'cc', 'count', 'fi')}""")
def binned_crosstab_fire_q(spark, base):
    """M3 + A10: posts per cell binned with the fire edges x fire flag, per level."""
    d = cell_counts(spark, base).join(fire_flags(spark, base).select("level", "cell_id", "intersects"),
                                      ["level", "cell_id"])
    return S.binned_crosstab(d, "count", "intersects", S.FIRE_EDGES, S.FIRE_LABELS, keys=["level"])


@register("describe_by_flag", views=("posts", "grid", "floods"), sql=f"""
WITH {PP_SQL}, {PC_SQL}, {COUNTS_SQL}, {FLAGS_SQL},
w AS (SELECT c.level, f.intersects, CAST(count(c.count_related) AS DOUBLE) AS count, avg(c.count_related) AS mean,
  stddev_samp(c.count_related) AS std, CAST(min(c.count_related) AS DOUBLE) AS min,
  quantile_cont(CAST(c.count_related AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(c.count_related AS DOUBLE), 0.75) AS p75,
  quantile_cont(CAST(c.count_related AS DOUBLE), 0.9) AS p90, quantile_cont(CAST(c.count_related AS DOUBLE), 0.95) AS p95,
  quantile_cont(CAST(c.count_related AS DOUBLE), 0.99) AS p99,
  quantile_cont(CAST(c.count_related AS DOUBLE), 0.999) AS p99_9, CAST(max(c.count_related) AS DOUBLE) AS max
  FROM cc c JOIN ff f ON c.level = f.level AND c.cell_id = f.cell_id GROUP BY ALL)
SELECT level, intersects, stat, round(value, 6) AS value
FROM w UNPIVOT INCLUDE NULLS (value FOR stat IN (count, mean, std, min, p50, p75, p90, p95, p99, p99_9, max))""")
def describe_by_flag_q(spark, base):
    """Grouped describe (tail percentiles) of related posts per cell by flood flag, transposed."""
    d = cell_counts(spark, base).join(flood_flags(spark, base).select("level", "cell_id", "intersects"),
                                      ["level", "cell_id"])
    out = S.describe_by(d, ["level", "intersects"], "count_related")
    return out.select("level", "intersects", "stat", F.round("value", 6).alias("value"))


@register("mode_frequency", views=("posts",), sql="""
SELECT round(max(n)::DOUBLE / sum(n), 6) AS mode_frequency FROM (SELECT language, count(*) AS n FROM (
  SELECT CASE WHEN len(langs) = 0 THEN NULL ELSE substr(langs[1], 1, 2) END AS language FROM posts)
  WHERE language IS NOT NULL GROUP BY 1)""")
def mode_frequency_q(spark, base):
    """Relative frequency of the most common language."""
    out = S.mode_frequency(P.with_language(fx.posts(spark, base)), "language")
    return out.select(F.round("mode_frequency", 6).alias("mode_frequency"))
