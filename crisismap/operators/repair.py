"""Validity and repair of polygons (F8, F5, G3): self-intersections, spikes, overlapping parts, misplaced holes.

All edges of a geometry are cut where they meet; an edge that lies on itself an even number of times
goes. What is left parts odd from even ground, and its loops are put together again as outer rings and holes. Tests and
distances of this library follow the same even-odd rule, so a repaired geometry covers just what they took
the broken one to cover. A geometry is valid if repair leaves its polygons' rings as they are.

Meeting edges are found by a sweep over their x ranges in numpy, in blocks of bounded size; geometries are independent rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIRS_A_BLOCK = 1 << 20
# All points lie on a grid of this share of the largest coordinate (rounded to a power of two), some micrometres on a map in
# degrees; a vertex no further than a step from an edge is on it.
GRID_BITS = 40
# Rounded cuts may bend edges into each other; then they are cut again.
CUT_ROUNDS = 20
POINT = "struct<lon:double,lat:double>"
REPAIRED = f"struct<valid:boolean,polygons:array<array<array<{POINT}>>>>"

Ring = np.ndarray  # vertices by (x, y)


def _cross(ax, ay, bx, by):
    return ax * by - ay * bx


def _step(points: np.ndarray) -> float:
    most = float(np.abs(points).max(initial=0.0))
    return 2.0 ** (np.frexp(most)[1] - GRID_BITS) if most > 0 else 1.0


def _meetings(edges: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (as x1, y1, x2, y2) and points inside them, their ends left out, where other edges meet them."""
    low, high = np.minimum(edges[:, :2], edges[:, 2:]) - step, np.maximum(edges[:, :2], edges[:, 2:]) + step
    order = np.argsort(low[:, 0], kind="stable")
    reach = np.searchsorted(low[order, 0], high[order, 0], "right") - np.arange(len(edges)) - 1
    where, points = [np.zeros(0, np.int64)], [np.zeros((0, 2))]
    bounds, start = np.concatenate([[0], np.cumsum(reach)]), 0
    while start < len(edges):
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + PAIRS_A_BLOCK, "right")) - 1)
        some = reach[start:stop]
        first = np.repeat(np.arange(start, stop), some)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(some) - some, some)
        a, b = order[first], order[second]
        near = (low[a, 1] <= high[b, 1]) & (low[b, 1] <= high[a, 1])
        a, b = a[near], b[near]
        start = stop
        da, db = edges[a, 2:] - edges[a, :2], edges[b, 2:] - edges[b, :2]
        sides, clear = [], np.ones(len(a), bool)
        for one, two, d in ((a, b, da), (b, a, db)):  # ends of two against the line of one
            length = np.hypot(d[:, 0], d[:, 1])
            for end in (edges[two, :2], edges[two, 2:]):
                to = end - edges[one, :2]
                side, along = _cross(d[:, 0], d[:, 1], to[:, 0], to[:, 1]) / length, (d * to).sum(axis=1) / length
                on = (np.abs(side) <= step) & (along > step) & (along < length - step)
                where.append(one[on])
                points.append(end[on])
                sides.append(side)
                clear &= np.abs(side) > step
        through = np.flatnonzero(clear & (sides[0] * sides[1] < 0) & (sides[2] * sides[3] < 0))
        a, b = a[through], b[through]
        share = (sides[2][through] / (sides[2][through] - sides[3][through]))[:, None]
        at = np.round((edges[a, :2] + share * da[through]) / step) * step
        for one in (a, b):
            inner = (at != edges[one, :2]).any(axis=1) & (at != edges[one, 2:]).any(axis=1)
            where.append(one[inner])
            points.append(at[inner])
    return np.concatenate(where), np.concatenate(points)


def cut_edges(edges: np.ndarray, step: float) -> np.ndarray | None:
    """Edges cut at all meetings, as (x1, y1, x2, y2) with the smaller end first; None if they don't settle."""
    edges = edges[(edges[:, :2] != edges[:, 2:]).any(axis=1)]
    for _ in range(CUT_ROUNDS):
        where, points = _meetings(edges, step)
        if not where.size:
            swap = (edges[:, 0] > edges[:, 2]) | ((edges[:, 0] == edges[:, 2]) & (edges[:, 1] > edges[:, 3]))
            return np.where(swap[:, None], edges[:, [2, 3, 0, 1]], edges)
        every = np.arange(len(edges))
        number = np.concatenate([every, where, every])
        place = np.concatenate([edges[:, :2], points, edges[:, 2:]])
        d = (edges[:, 2:] - edges[:, :2])[number]
        along = ((place - edges[number, :2]) * d).sum(axis=1)
        kind = np.repeat([0, 1, 2], [len(edges), len(where), len(edges)])
        order = np.lexsort((along, kind, number))
        number, place = number[order], place[order]
        joined = np.flatnonzero(number[1:] == number[:-1])
        edges = np.concatenate([place[joined], place[joined + 1]], axis=1)
        edges = edges[(edges[:, :2] != edges[:, 2:]).any(axis=1)]
    return None


def _odd(edges: np.ndarray, x: float, y: float, axis: int) -> bool:
    """Whether a ray from a point along +x (axis 0) or +y (axis 1) crosses an odd number of edges."""
    u, v = axis, 1 - axis
    here = (x, y)
    over = (edges[:, v] > here[v]) != (edges[:, 2 + v] > here[v])
    e = edges[over]
    at = e[:, u] + (here[v] - e[:, v]) * (e[:, 2 + u] - e[:, u]) / (e[:, 2 + v] - e[:, v])
    return bool(np.count_nonzero(at > here[u]) % 2)


def _area(ring: Ring) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2


def _loops(edges: np.ndarray) -> list[np.ndarray]:
    """Simple loops of vertices with odd ground to their left; every edge is in one."""
    nodes, ends = np.unique(edges.reshape(-1, 2), axis=0, return_inverse=True)
    ends = ends.reshape(-1, 2)
    m = len(edges)
    tail, head = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
    twin = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    d = nodes[head] - nodes[tail]
    order = np.lexsort((np.arctan2(d[:, 1], d[:, 0]), tail))
    rank = np.empty(2 * m, np.int64)
    rank[order] = np.arange(2 * m)
    first = np.searchsorted(tail[order], np.arange(len(nodes)))
    last = np.searchsorted(tail[order], np.arange(len(nodes)), "right") - 1
    back = rank[twin]  # the first way clockwise from the way back keeps the same ground to the left
    follow = order[np.where(back == first[head], last[head], back - 1)].tolist()
    seen, loops = np.zeros(2 * m, bool), []
    for h in range(2 * m):
        if seen[h]:
            continue
        walk, at = [], h
        while not seen[at]:
            seen[at] = True
            walk.append(at)
            at = follow[at]
        dx, dy = d[h]
        x, y = (nodes[tail[h]] + nodes[head[h]]) / 2
        others = edges[np.arange(m) != h % m]
        left = _odd(others, x, y, 0) != (dy > 0) if dy != 0 else _odd(others, x, y, 1) != (dx < 0)
        if not left:
            continue
        path, place = [], {}
        for v in tail[walk].tolist():  # a walk that comes back to a vertex is cut there
            if v in place:
                loop = path[place[v]:]
                for w in loop:
                    del place[w]
                del path[-len(loop):]
                loops.append(nodes[loop])
            place[v] = len(path)
            path.append(v)
        loops.append(nodes[path])
    return loops


def _closed(ring: Ring) -> Ring:
    """From the smallest vertex on, without vertices in the middle of a straight line, closed."""
    ahead, behind = np.roll(ring, -1, axis=0) - ring, ring - np.roll(ring, 1, axis=0)
    ring = ring[_cross(behind[:, 0], behind[:, 1], ahead[:, 0], ahead[:, 1]) != 0]
    ring = np.roll(ring, -int(np.lexsort((ring[:, 1], ring[:, 0]))[0]), axis=0)
    return np.concatenate([ring, ring[:1]])


def _edges_of(ring: Ring) -> np.ndarray:
    return np.concatenate([ring, np.roll(ring, -1, axis=0)], axis=1)


def repair_polygons(polygons: list[list[Ring]]) -> tuple[bool, list[list[Ring]] | None]:
    """(valid, repaired polygons) of polygons as lists of rings, outer ring first; None if edges can't be cut apart.

    Outer rings run counter-clockwise, holes clockwise; each starts at its smallest vertex, and polygons are in the order of
    these. Open rings are closed and missing vertices left out, which makes a geometry invalid; so does a ring of
    no area. Without any area there are no polygons.
    """
    sound, rings = True, []
    for p, polygon in enumerate(polygons):
        for ring in polygon:
            whole = ring[np.isfinite(ring).all(axis=1)]
            sound &= len(whole) == len(ring) >= 4 and bool((ring[0] == ring[-1]).all())
            if len(whole):
                rings.append((p, whole))
        sound &= len(polygon) > 0
    if not rings:
        return False, []
    step = _step(np.concatenate([r for _, r in rings]))
    rings = [(p, np.round(r / step) * step) for p, r in rings]
    cut = cut_edges(np.concatenate([_edges_of(r) for _, r in rings]), step)
    if cut is None:
        return False, None
    unique, times = np.unique(cut, axis=0, return_counts=True)
    sound &= bool((times == 1).all())
    kept = unique[times % 2 == 1]
    if not len(kept):
        return False, []
    loops = [(loop, _area(loop)) for loop in _loops(kept)]
    shells = sorted(((loop, area) for loop, area in loops if area > 0), key=lambda s: s[1])
    out: list[list[Ring]] = [[loop] for loop, _ in shells]
    for loop, area in loops:
        if area < 0:
            x, y = (loop[0] + loop[1]) / 2
            inside = [i for i, (shell, size) in enumerate(shells) if size > -area and _odd(_edges_of(shell), x, y, 0)]
            if inside:
                out[inside[0]].append(loop)
    out = [[_closed(r) for r in polygon] for polygon in out]
    out = sorted(([p[0], *sorted(p[1:], key=lambda r: r[0].tolist())] for p in out), key=lambda p: (p[0][0].tolist(), p[0][1].tolist()))
    return bool(sound) and _alike([[r for q, r in rings if q == p] for p in range(len(polygons))], out), out


def _alike(before: list[list[Ring]], after: list[list[Ring]]) -> bool:
    """The same polygons of the same rings, but for the order, direction and start of rings and straight vertices."""
    def shape(ring: Ring) -> tuple:
        ring = ring[:-1]
        ring = ring[(ring != np.roll(ring, 1, axis=0)).any(axis=1)]
        if len(ring) < 3 or (area := _area(ring)) == 0:
            return ()
        return tuple(map(tuple, _closed(ring if area > 0 else ring[::-1]).tolist()))

    def shapes(polygons: list[list[Ring]]) -> list:
        return sorted((shape(p[0]), *sorted(map(shape, p[1:]))) for p in polygons)

    return shapes(before) == shapes(after)


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of a list column, from zero, and its flat values; a NULL is an empty list."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), column.flatten()


def repair(polygons: str) -> Column:
    """A struct of ``valid`` and the repaired ``polygons`` (arrays of polygons of rings of (lon, lat)); NULL stays NULL."""

    @F.arrow_udf(REPAIRED)
    def run(column: pa.Array) -> pa.Array:
        of_row, parts = _lists(column)
        of_part, rings = _lists(parts)
        of_ring, points = _lists(rings)
        xy = np.stack([points.field(i).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1)
        if points.null_count:
            xy[~points.is_valid().to_numpy(zero_copy_only=False)] = np.nan
        valid, known, counts, flat = [], [], ([], [], []), [np.zeros((0, 2))]
        for i in range(len(column)):
            given = [[xy[of_ring[r]:of_ring[r + 1]] for r in range(of_part[p], of_part[p + 1])] for p in range(of_row[i], of_row[i + 1])]
            ok, new = repair_polygons(given)
            valid.append(ok)
            known.append(new is not None)
            counts[0].append(len(new or ()))
            for polygon in new or ():
                counts[1].append(len(polygon))
                for ring in polygon:
                    counts[2].append(len(ring))
                    flat.append(ring)
        place = np.concatenate(flat)
        level = pa.StructArray.from_arrays([pa.array(place[:, 0]), pa.array(place[:, 1])], ["lon", "lat"])
        for sizes, missing in ((counts[2], None), (counts[1], None), (counts[0], [not k for k in known])):
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))
            level = pa.ListArray.from_arrays(offsets, level, mask=pa.array(missing, pa.bool_()) if missing is not None else None)
        return pa.StructArray.from_arrays([pa.array(valid, pa.bool_()), level], ["valid", "polygons"])

    return F.when(F.col(polygons).isNotNull(), run(F.col(polygons)))


def make_valid(df: DataFrame, polygons: str = "polygons", valid: str = "valid") -> DataFrame:
    """F8 + G3: polygons that are valid stay as they are, others are repaired; ``valid`` says which were.

    What can't be repaired, and a NULL, is NULL; a geometry without area has no polygons.
    """
    fixed = df.withColumn("_fixed", repair(polygons))
    return fixed.withColumn(valid, F.col("_fixed.valid")).withColumn(
        polygons, F.when(F.col("_fixed.valid"), F.col(polygons)).otherwise(F.col("_fixed.polygons"))).drop("_fixed")
