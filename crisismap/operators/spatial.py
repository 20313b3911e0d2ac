"""Spatial joins without a spatial library.

Every theta join becomes an equi join on the nodes of a split tree (``splits``), plus an exact residual test, so
Spark plans a hash join instead of a nested loop. The tree is fitted on a bounded sample of the hazard or cell
side, so its leaves hold about equally many shapes wherever they lie. A shape is kept at a few nodes
that cover its box: a small one at a leaf, one of a continent's size at inner nodes. A pair is
reported at the one node that holds a reference point of both boxes.

The shape side is broadcast only after its size is proven; otherwise both sides shuffle on the node, and a
node that many rows of the other side meet (one city, or one spot, with a third of all points) is split by as many
salts as it has rows for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crisismap.functions import geometry as G
from crisismap.functions import sphere as SPH
from crisismap.operators.splits import SplitTree, sample_points
from crisismap.session import keep, maybe_broadcast, stored

LEAF_SHAPES = 4  # shapes of a leaf in a join of boxes, about
LEAF_HAZARDS = 16  # hazards of a leaf in a search for the nearest
SHAPE_NODES = 16  # nodes that a shape is kept at, at the most
SAMPLE_SHAPES = 262_144
MOST_LEAVES = 65_536
ROWS_PER_SALT = 100_000  # rows of one side that meet a node's rows in one task


def with_bbox(df: DataFrame, ring: str = "ring", prefix: str = "_") -> DataFrame:
    bb = G.ring_bbox(ring)
    return df.select("*", *[F.expr(v).alias(prefix + k) for k, v in bb.items()])


def _salted_join(left: DataFrame, right: DataFrame, key: str, row: Column) -> DataFrame:
    """Equi join on ``key``: the right side is broadcast if proven small, else the left one is salted by its counts.

    ``row`` tells equal rows apart, so that a single spot's rows are spread too.
    """
    small, is_small = maybe_broadcast(right)
    if is_small:
        return left.join(small, key)
    left = left.withColumn("_row", row)
    salts = left.groupBy(key).agg(F.ceil(F.count("*") / ROWS_PER_SALT).cast("int").alias("_salts"))
    salts = stored(salts, "salts")
    spread = left.join(salts, key).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.col("_salts")).cast("int"))
    fanned = right.join(salts, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return spread.drop("_salts").join(fanned, [key, "_salt"]).drop("_salt", "_row")


AT = "array<struct<node:int,up:boolean,x0:double,x1:double,y0:double,y1:double>>"
_BOX = ("xmin", "ymin", "xmax", "ymax")


def _boxes(columns: tuple[pa.Array, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, box) of the boxes without a missing side."""
    box = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1).reshape(-1, 4)
    fine = np.flatnonzero(~np.isnan(box).any(axis=1))
    return fine, box[fine]


def _sample_boxes(df: DataFrame, box: tuple[str, ...]) -> tuple[np.ndarray, int]:
    """Boxes of ``df`` (those without a missing side), all of them if there are no more than ``SAMPLE_SHAPES``, and their number."""
    columns = [F.col(c).cast("double") for c in box]
    whole = df
    for c in columns:
        whole = whole.where(c.isNotNull() & ~F.isnan(c))
    return sample_points(whole, columns, F.struct(*box), SAMPLE_SHAPES)


def box_join(left: DataFrame, right: DataFrame, left_box: tuple[str, ...], right_box: tuple[str, ...],
             points: bool = False) -> DataFrame:
    """Rows of both sides whose boxes (xmin, ymin, xmax, ymax columns) share a place, each pair once.

    ``points``: the left boxes are points. Boxes with a missing side share nothing.
    """
    spark = left.sparkSession
    shapes, total = _sample_boxes(right, right_box)
    tree = SplitTree.fit((shapes[:, :2] + shapes[:, 2:]) / 2, -(-total // LEAF_SHAPES), MOST_LEAVES) if len(shapes) else SplitTree()
    held = tree.nodes(2)
    nodes = spark.sparkContext.broadcast(held)

    def at(other: set[int] | None) -> Column:
        """Own nodes of a box and, as ``up``, those above them that are the own ones of ``other`` boxes."""

        @F.arrow_udf(AT)
        def place(xmin: pa.Array, ymin: pa.Array, xmax: pa.Array, ymax: pa.Array) -> pa.Array:
            held = nodes.value
            fine, box = _boxes((xmin, ymin, xmax, ymax))
            which, own = held.cover(box[:, :2], box[:, 2:], SHAPE_NODES)
            which = fine[which]
            rows, at, of = [which], [own], [own]
            if other:
                above = {int(n): [u for u in held.ups(int(n)) if u in other] for n in np.unique(own)}
                up = np.array([len(above[int(n)]) for n in own], np.int64)
                rows.append(np.repeat(which, up))
                at.append(np.array([u for n in own for u in above[int(n)]], np.int64))
                of.append(np.repeat(own, up))
            up = np.repeat([False, True], [len(own), sum(map(len, at)) - len(own)])
            rows, at, of = np.concatenate(rows), np.concatenate(at), np.concatenate(of)
            order = np.argsort(rows, kind="stable")
            rows, at, of, up = rows[order], at[order], of[order], up[order]
            starts = np.searchsorted(rows, np.arange(len(xmin) + 1)).astype(np.int32)
            places = pa.StructArray.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(up), *[pa.array(side[of, axis]) for axis in (0, 1) for side in (held.low, held.high)]],
                names=["node", "up", "x0", "x1", "y0", "y1"])
            return pa.ListArray.from_arrays(pa.array(starts), places)

        return place

    def own_nodes(df: DataFrame, box: tuple[str, ...], whole: np.ndarray | None) -> set[int]:
        """Inner nodes at which shapes are kept: at most as many as the tree has."""
        if whole is not None:
            return {int(n) for n in held.cover(whole[:, :2], whole[:, 2:], SHAPE_NODES)[1] if n < held.inner}
        found = df.select(F.explode(at(None)(*box)).alias("p")).select("p.node").distinct().where(F.col("node") < held.inner)
        return {r["node"] for r in found.collect()}

    kept = own_nodes(right, right_box, shapes if total == len(shapes) else None)
    above = set()
    if not points and held.inner:
        boxes, count = _sample_boxes(left, left_box)
        above = own_nodes(left, left_box, boxes if count == len(boxes) else None)
    one = left.withColumn("_l", F.explode(at(kept)(*left_box))).withColumn("_node", F.col("_l.node"))
    two = right.withColumn("_r", F.explode(at(above)(*right_box))).withColumn("_node", F.col("_r.node"))
    met = _salted_join(one, two, "_node", F.monotonically_increasing_id())
    x, y = F.greatest(left_box[0], right_box[0]), F.greatest(left_box[1], right_box[1])
    share = (F.col(left_box[0]) <= F.col(right_box[2])) & (F.col(right_box[0]) <= F.col(left_box[2])) & (
        F.col(left_box[1]) <= F.col(right_box[3])) & (F.col(right_box[1]) <= F.col(left_box[3]))
    deeper = lambda side: F.when(F.col("_r.up"), F.col(f"_r.{side}")).otherwise(F.col(f"_l.{side}"))
    once = (x >= deeper("x0")) & (x < deeper("x1")) & (y >= deeper("y0")) & (y < deeper("y1"))
    return met.where(share & ~(F.col("_l.up") & F.col("_r.up")) & once).drop("_l", "_r", "_node")


def points_in_cells(points: DataFrame, cells: DataFrame, lon: str = "lon", lat: str = "lat", ring: str = "ring") -> DataFrame:
    """Inner point-in-polygon join with 'intersects' semantics (a boundary point matches every
    touching cell). Output: all point columns + all cell columns."""
    shapes = with_bbox(cells, ring)
    met = box_join(points, shapes, (lon, lat, lon, lat), tuple(f"_{c}" for c in _BOX), points=True)
    return met.where(F.expr(G.point_in_polygon(f"`{lon}`", f"`{lat}`", f"`{ring}`"))).drop(*[f"_{c}" for c in _BOX])


def cell_counts(pairs: DataFrame, keys: list[str], related: str = "disaster_related") -> DataFrame:
    """A1: points per cell, all and related, in one pass (the reference joined twice)."""
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.coalesce(F.col(related) == 1, F.lit(False))).alias("count_related"))


def fill_grid(cells: DataFrame, counts: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Every cell of the grid, missing counts -> 0 (left equi join)."""
    out = cells.join(counts, keys, "left")
    return out.fillna(0, subset=measures)


def weekly_cell_counts(pairs: DataFrame, all_points: DataFrame, cells: DataFrame, ts: str = "ts",
                       keys: tuple[str, ...] = ("level", "cell_id")) -> DataFrame:
    """A2: points per cell per ISO week, zero-filled over every week present in *all* points.

    The week list is bounded by the time span; it is attached to each cell as
    a one-row scalar join and exploded, then the per-(week, cell) counts join in.
    """
    wk = [F.extract(F.lit("YEAROFWEEK"), F.col(ts)).alias("iso_year"), F.weekofyear(ts).alias("week")]
    counts = pairs.where(F.col(ts).isNotNull()).groupBy(*keys, *wk).agg(F.count(F.lit(1)).alias("count"))
    weeks = (all_points.where(F.col(ts).isNotNull()).select(*wk).distinct()
             .agg(F.collect_list(F.struct("iso_year", "week")).alias("_weeks")))
    frame = (cells.select(*keys).crossJoin(weeks)
             .select(*keys, F.explode("_weeks").alias("_w"))
             .select(*keys, F.col("_w.iso_year").alias("iso_year"), F.col("_w.week").alias("week")))
    return fill_grid(frame, counts, [*keys, "iso_year", "week"], ["count"])


def intersects_any(cells: DataFrame, hazards: DataFrame, key: str | tuple[str, ...] = "cell_id", ring: str = "ring",
                   hazard_ring: str = "hazard_ring", flag: str = "intersects") -> DataFrame:
    """Does each cell intersect any hazard polygon (boxes that meet -> exact G4 -> distinct cell)."""
    keys = [key] if isinstance(key, str) else list(key)
    h = with_bbox(hazards.select(F.col(hazard_ring).alias("_hring")), "_hring", "_h")
    c = with_bbox(cells.select(*keys, ring), ring, "_c")
    cand = box_join(c, h, tuple(f"_c{b}" for b in _BOX), tuple(f"_h{b}" for b in _BOX))
    hits = (cand.where(F.expr(G.polygons_intersect(f"`{ring}`", "_hring"))).select(*keys).distinct()
            .withColumn(flag, F.lit(True)))
    return cells.join(hits, keys, "left").fillna(False, subset=[flag])


def valid_hazards(hazards: DataFrame, polygons: str = "polygons", ring: str = "ring") -> DataFrame:
    """F8 + S5: the hazards whose polygons are valid, each as one vertex array (holes and parts included) in ``ring``,
    the form in which every join and distance takes them."""
    return hazards.where(G.valid_polygons(polygons)).withColumn(ring, G.flat_rings(polygons)).drop(polygons)


def delineations_with_footprints(d: DataFrame, f: DataFrame, keys: list[str], ring: str = "ring",
                                 f_ring: str = "footprint_ring") -> DataFrame:
    """Left join on attribute equality with intersects as residual, then full-row dedupe.

    The equi keys have few values (continent, tile, date), so a shuffle on them
    would skew; footprints are broadcast when proven small, else AQE splits the
    skewed partitions of the sort-merge join.
    """
    fr = f.select(*[F.col(k).alias(f"_f_{k}") for k in keys], *[c for c in f.columns if c not in keys])
    small, _ = maybe_broadcast(fr)
    cond = [d[k] == small[f"_f_{k}"] for k in keys]
    cond.append(F.expr(G.polygons_intersect(f"`{ring}`", f"`{f_ring}`")))
    joined = d.join(small, cond, "left").drop(*[f"_f_{k}" for k in keys])
    return joined.dropDuplicates()


def nearest_distance(cells: DataFrame, hazards: DataFrame, crs: str, key: str = "cell_id", ring: str = "ring",
                     hazard_ring: str | None = None, hazard_lon: str = "lon", hazard_lat: str = "lat") -> DataFrame:
    """Distance from each cell polygon to the nearest hazard, in metres of ``crs``; NULL without hazards.

    Hazards lie in the leaves of a split tree, each with the box that holds its hazards. A
    cell first meets the leaf whose box is nearest; then only leaves nearer than the best distance found
    there, usually none or a few. A cell far from everything costs no more than any other.
    """
    pc = cells.select(key, G.project_ring(ring, crs).alias("_pring"))
    if hazard_ring:
        ph = hazards.select(G.project_ring(hazard_ring, crs).alias("_hgeom"))
        dist = G.polygon_polygon_distance("_pring", "_hgeom")
    else:
        x, y = G.project(hazard_lon, hazard_lat, crs)
        pts = hazards.where(F.col(hazard_lon).isNotNull() & F.col(hazard_lat).isNotNull())
        ph = pts.select(F.array(F.struct(x.alias("lon"), y.alias("lat"))).alias("_hgeom"))
        dist = G.point_polygon_distance("element_at(_hgeom, 1).lon", "element_at(_hgeom, 1).lat", "_pring")
    # the distance depends on the distinct geometries only (repeat detections at one spot are common)
    ph = keep(with_bbox(ph.dropDuplicates(["_hgeom"]), "_hgeom", "_h").where("_hxmin IS NOT NULL AND _hymin IS NOT NULL"))
    pc = keep(with_bbox(pc, "_pring", "_c"))
    middle = [(F.col(f"_h{a}min") + F.col(f"_h{a}max")) / 2 for a in "xy"]
    centres, total = sample_points(ph, middle, F.struct(*[f"_h{b}" for b in _BOX]))
    if not total:
        for table in (pc, ph):
            table.unpersist()
        return cells.withColumn("min_distance", F.lit(None).cast("double"))
    tree = SplitTree.fit(centres, -(-total // LEAF_HAZARDS))

    @F.arrow_udf("int")
    def leaf_of(x: pa.Array, y: pa.Array) -> pa.Array:
        at = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in (x, y)], axis=1)
        return pa.array(tree.leaf_of(at).astype(np.int32))

    ph = ph.withColumn("_leaf", leaf_of(*middle))
    rows = ph.groupBy("_leaf").agg(*[f(f"_h{b}").alias(b) for b, f in zip(_BOX, (F.min, F.min, F.max, F.max), strict=True)]).collect()
    number = np.array([r["_leaf"] for r in rows], np.int32)
    low, high = (np.array([[r[b] for b in part] for r in rows], float) for part in (_BOX[:2], _BOX[2:]))

    def near(box: np.ndarray) -> np.ndarray:
        """Least distance of each box to anything in each leaf."""
        apart = np.maximum(0.0, np.maximum(low[None] - box[:, None, 2:], box[:, None, :2] - high[None]))
        return np.sqrt((apart ** 2).sum(axis=2)) * (1 - 1e-9)

    def blocks(count: int) -> list[slice]:
        step = max(1, (1 << 20) // len(number))
        return [slice(i, i + step) for i in range(0, count, step)]

    @F.arrow_udf("int")
    def nearest(xmin: pa.Array, ymin: pa.Array, xmax: pa.Array, ymax: pa.Array) -> pa.Array:
        fine, box = _boxes((xmin, ymin, xmax, ymax))
        found = np.full(len(xmin), -1, np.int32)
        for block in blocks(len(box)):
            found[fine[block]] = number[near(box[block]).argmin(axis=1)]
        return pa.array(found, mask=found < 0)

    @F.arrow_udf("array<int>")
    def others(xmin: pa.Array, ymin: pa.Array, xmax: pa.Array, ymax: pa.Array, best: pa.Array, first: pa.Array) -> pa.Array:
        _, box = _boxes((xmin, ymin, xmax, ymax))
        out, best, first = [], best.to_numpy(), first.to_numpy()
        for block in blocks(len(box)):
            left = (near(box[block]) < best[block][:, None]) & (number[None, :] != first[block][:, None])
            out += [number[row] for row in left]
        return pa.array(out, pa.list_(pa.int32()))

    corners = [f"_c{b}" for b in _BOX]
    hosts = ph.select("_leaf", "_hgeom")
    asking = pc.withColumn("_leaf", nearest(*corners)).where(F.col("_leaf").isNotNull())
    first = keep(_salted_join(asking, hosts, "_leaf", F.col(key)).groupBy(key).agg(F.min(F.expr(dist)).alias("_best"), F.first("_leaf").alias("_first")))
    more = asking.drop("_leaf").join(first, key).withColumn("_leaf", F.explode(others(*corners, "_best", "_first")))
    second = _salted_join(more, hosts, "_leaf", F.col(key)).groupBy(key).agg(F.min(F.expr(dist)).alias("_more"))
    out = stored(first.join(second, key, "left").select(key, F.least("_best", "_more").alias("min_distance")), "nearest")
    for table in (pc, ph, first):
        table.unpersist()
    return cells.join(out, key, "left")


def polygon_filter(df: DataFrame, ring_points: list[tuple[float, float]], points: str = "points") -> DataFrame:
    """keep rows with any point inside (or on) a literal polygon."""
    lit = "array(" + ", ".join(f"named_struct('lon', {x!r}D, 'lat', {y!r}D)" for x, y in ring_points) + ")"
    pip = G.point_in_polygon("pp.lon", "pp.lat", lit)
    return df.where(F.coalesce(F.expr(f"exists({points}, pp -> {pip})"), F.lit(False)))


def sphere_polygon_filter(df: DataFrame, rings: list[list[tuple[float, float]]], points: str = "points") -> DataFrame:
    """F5 on the sphere: keep rows with any point inside (or on) a literal polygon with great-circle edges."""
    return df.where(SPH.any_inside(points, rings))
