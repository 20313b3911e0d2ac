"""Hierarchical density clustering (HDBSCAN) over distributed points.

1. Equal vectors become one weighted point, so a spot with any number of copies costs one row.
2. A split tree deals points into leaves, a leaf's points into cells. Cells ask the leaves that their points' balls reach for
   the points inside, so that a leaf's task sees all it needs: first the balls of the radius found at home, which
   give the core distances (to the ``min_samples``-th neighbour), then those of the core distances.
3. The minimum spanning tree of the mutual reachability distances grows by Boruvka rounds. An edge as light as
   its point's core distance is sure at once. The components that these make keep the least known link to each other one; a
   round looks for lighter ones only from points whose core distance is less than their component's least link,
   no further than that, and not among points of the same component. Least links of pairs alone leave a task.
4. Tree edges are merged in ascending order, in bands of bounded size, into the condensed tree: splits
   with at least ``min_cluster_size`` rows on both sides. Stabilities and the choice of clusters (excess of mass) come
   along on the way up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crisismap.operators.splits import MAX_LEAVES, SplitTree, sample_points
from crisismap.session import maybe_broadcast, stored

LEAF_POINTS = 2048
CELL_POINTS = 64
FEW_POINTS = 16  # points of a cell that are compared at a time
VISITORS = 8192  # boxes of other leaves' cells that one task group compares with a leaf
BAND_EDGES = 1 << 20
CELLS = 1 << 21  # numbers in a block of a distance matrix
SMALLEST = 1e-10  # distances below count as this much when densities are compared


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _blocks(rows: int, columns: int) -> Iterator[slice]:
    step = max(1, CELLS // max(columns, 1))
    for start in range(0, rows, step):
        yield slice(start, min(start + step, rows))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, the same number for a pair whichever side and block it is in: squares are added axis by axis."""
    total = np.zeros((len(a), len(b)))
    for axis in range(a.shape[1]):
        total += (a[:, None, axis] - b[None, :, axis]) ** 2
    return np.sqrt(total)


class Leaves:
    """Tight boxes, weights and core distances of all leaves, as arrays (bounded by ``MAX_LEAVES``)."""

    def __init__(self, rows: list):
        self.number = np.array([r["leaf"] for r in rows], np.int64)
        self.low, self.high = (np.array([r[c] for r in rows], float).reshape(len(rows), -1) for c in ("low", "high"))
        self.weight = np.array([r["weight"] for r in rows], float)
        self.least_core = np.array([r["least_core"] for r in rows], float)
        self.most_core = np.array([r["most_core"] for r in rows], float)

    def near(self, points: np.ndarray) -> np.ndarray:
        """Least distance of each point to anything in each leaf."""
        total = np.zeros((len(points), len(self.number)))
        for axis in range(points.shape[1]):
            x = points[:, None, axis]
            total += np.maximum(0.0, np.maximum(self.low[None, :, axis] - x, x - self.high[None, :, axis])) ** 2
        return np.sqrt(total) * (1 - 1e-12)

    def far(self, points: np.ndarray) -> np.ndarray:
        """Largest distance of each point to anything in each leaf."""
        total = np.zeros((len(points), len(self.number)))
        for axis in range(points.shape[1]):
            x = points[:, None, axis]
            total += np.maximum(np.abs(x - self.low[None, :, axis]), np.abs(x - self.high[None, :, axis])) ** 2
        return np.sqrt(total) * (1 + 1e-12)


def _leaf_table(points: DataFrame, dims: int) -> Leaves:
    aggregates = [F.array(*[f(F.col("x")[i]) for i in range(dims)]).alias(name) for name, f in (("low", F.min), ("high", F.max))]
    core = F.col("core") if "core" in points.columns else F.lit(0.0)
    rows = points.groupBy("leaf").agg(*aggregates, F.sum("weight").cast("double").alias("weight"), F.min(core).alias("least_core"),
                                      F.max(core).alias("most_core")).collect()
    return Leaves(rows)


def _within(ordered: np.ndarray, weights: np.ndarray, need: float) -> np.ndarray:
    """First place in each row of sorted weights where their running sum reaches ``need``; the row's length if never."""
    reached = np.cumsum(weights, axis=1) >= need
    return np.where(reached.any(axis=1), reached.argmax(axis=1), ordered.shape[1])


def _halved(x: np.ndarray, rows: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """``rows`` of ``x`` in parts: halved at their widest axis until ``most`` are left."""
    todo = [rows]
    while todo:
        part = todo.pop()
        if len(part) <= most:
            yield part
            continue
        order = part[np.argsort(x[part, np.ptp(x[part], axis=0).argmax()], kind="stable")]
        todo += [order[:len(order) // 2], order[len(order) // 2:]]


def _cells(x: np.ndarray) -> np.ndarray:
    """Cell number of each point of a leaf; a cell has ``CELL_POINTS`` at most."""
    cell = np.zeros(len(x), np.int32)
    for number, part in enumerate(_halved(x, np.arange(len(x)), CELL_POINTS)):
        cell[part] = number
    return cell


def _apart(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """Least distance of anything in each box to anything in each other box."""
    total = np.zeros((len(low), len(other_low)))
    for axis in range(low.shape[1]):
        total += np.maximum(0.0, np.maximum(other_low[None, :, axis] - high[:, None, axis], low[:, None, axis] - other_high[None, :, axis])) ** 2
    return np.sqrt(total) * (1 - 1e-12)


def _with_halo(points: DataFrame, leaves: Leaves, dims: int, work, schema: str, alone: np.ndarray | None = None) -> DataFrame:
    """``work(points of a leaf, points of other leaves)``: of the others all that lie within ``radius`` of a point of the leaf.

    ``points``: row, x, leaf, cell, radius (below 0: asks for nothing) and others. The boxes of cells ask at the leaves that
    they reach, which hand over the points in question, each once for a leaf. With a column ``comp``, a cell of one
    component asks for points of others only, and not at all at leaves that hold nothing else (``alone``).
    """
    columns = [c for c in points.columns if c not in ("leaf", "cell", "radius")]
    comp = "comp" in columns
    bounds = [F.array(*[f(F.col("x")[i]) for i in range(dims)]).alias(name) for name, f in (("low", F.min), ("high", F.max))]
    only = F.when(F.min("comp") == F.max("comp"), F.min("comp")).otherwise(-2) if comp else F.lit(-2)
    asking = points.where("radius >= 0").groupBy("leaf", "cell").agg(*bounds, F.max("radius").alias("radius"), only.cast("long").alias("only"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = (_matrix(batch.column(c), batch.num_rows) for c in ("low", "high"))
            radius, own, one = (batch.column(c).to_numpy() for c in ("radius", "leaf", "only"))
            for block in _blocks(len(low), len(leaves.number)):
                reached = _apart(low[block], high[block], leaves.low, leaves.high) <= radius[block][:, None]
                reached &= own[block][:, None] != leaves.number[None, :]
                if alone is not None:
                    reached &= alone[None, :] != one[block][:, None]
                i, at = np.nonzero(reached)
                yield batch.take(pa.array(i + block.start)).append_column("at", pa.array(leaves.number[at]))

    asked = stored(asking.mapInArrow(ask, "leaf long, cell int, low array<double>, high array<double>, radius double, only long, at long"), "density")
    salts = asked.groupBy("at").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("salts"))
    asked = asked.join(salts, "at").withColumn("salt", F.pmod(F.xxhash64("leaf"), F.col("salts")).cast("int")).drop("salts")
    hosts = points.select("leaf", *columns).join(salts.withColumnRenamed("at", "leaf"), "leaf").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def give(here: pa.Table, boxes: pa.Table) -> pa.Table:
        given = here.select(columns)
        if not here.num_rows or not boxes.num_rows:
            return given.slice(0, 0).append_column("to", pa.array([], pa.int64()))
        x, own = _matrix(here["x"], here.num_rows), here["comp"].to_numpy() if comp else None
        low, high = (_matrix(boxes[c], boxes.num_rows) for c in ("low", "high"))
        radius, one, leaf = (boxes[c].to_numpy() for c in ("radius", "only", "leaf"))
        rows, to = [], []
        for number in np.unique(leaf):
            some = np.flatnonzero(leaf == number)
            for block in _blocks(len(x), len(some)):
                wanted = _apart(x[block], x[block], low[some], high[some]) <= radius[some][None, :]
                if comp:
                    wanted &= own[block][:, None] != one[some][None, :]
                i = np.flatnonzero(wanted.any(axis=1)) + block.start
                rows.append(i)
                to.append(np.full(len(i), number))
        return given.take(pa.array(np.concatenate(rows))).append_column("to", pa.array(np.concatenate(to)))

    kinds = dict(points.dtypes)
    halo = hosts.groupBy("leaf", "salt").cogroup(asked.groupBy("at", "salt")).applyInArrow(
        give, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", to long")
    return points.groupBy("leaf").cogroup(halo.groupBy("to")).applyInArrow(work, schema)


def _both(own: pa.Table, given: pa.Table, *columns: str) -> list[np.ndarray]:
    """Columns of a leaf's points, followed by those of the points around it."""
    x = _matrix(own["x"], own.num_rows)
    if given.num_rows:
        x = np.concatenate([x, _matrix(given["x"], given.num_rows)])
    return [x, *(np.concatenate([own[c].to_numpy(), given[c].to_numpy()]) for c in columns)]


def _reached(x: np.ndarray, part: np.ndarray, radius: float, of: np.ndarray) -> np.ndarray:
    """Those of the points ``of`` that lie within ``radius`` of the box of ``part``."""
    low, high = x[part].min(axis=0)[None], x[part].max(axis=0)[None]
    return of[_apart(low, high, x[of], x[of])[0] <= radius]


def _around(own: pa.Table, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A few of the leaf's points that ask at a time, of one cell, and all points in reach of any of them."""
    cell, radius = own["cell"].to_numpy(), own["radius"].to_numpy()
    for number in np.unique(cell[radius >= 0]):
        mine = np.flatnonzero((cell == number) & (radius >= 0))
        reached = _reached(x, mine, radius[mine].max(), np.arange(len(x)))
        for part in _halved(x, mine, FEW_POINTS):  # a smaller box reaches less, all of it in reach of the cell
            at = _reached(x, part, radius[part].max(), reached)
            for block in _blocks(len(part), len(at)):
                yield part[block], at


def core_distances(points: DataFrame, dims: int, min_samples: int) -> DataFrame:
    """``points`` (row, x, weight, leaf) with ``core``: the least radius that holds ``min_samples`` other rows; and their ``cell``.

    Infinite if there are no so many. The radius that a point finds at home bounds what it asks other leaves for.
    """
    leaves, need = _leaf_table(points, dims), min_samples + 1.0

    def least(apart: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Distance at which the running sum of weights (1 at least) reaches ``need`` in each row."""
        held = min(int(np.ceil(need)), apart.shape[1])
        first = np.argpartition(apart, held - 1, axis=1)[:, :held]
        ordered = np.take_along_axis(apart, first, axis=1)
        order = np.argsort(ordered, axis=1)
        ordered = np.take_along_axis(ordered, order, axis=1)
        end = _within(ordered, weight[np.take_along_axis(first, order, axis=1)], need)
        return np.where(end < held, ordered[np.arange(len(ordered)), np.minimum(end, held - 1)], np.inf)

    def home(group: pa.Table) -> pa.Table:
        x, weight = _matrix(group["x"], group.num_rows), group["weight"].to_numpy()
        radius = np.empty(len(x))
        for block in _blocks(len(x), max(len(x), len(leaves.number))):
            far = leaves.far(x[block])  # whole leaves count as reached at their far corner
            by_far = np.argsort(far, axis=1)
            sure = _within(by_far, leaves.weight[by_far], need)
            limit = np.where(sure < far.shape[1], np.take_along_axis(far, by_far[np.arange(len(far)), np.minimum(sure, far.shape[1] - 1)][:, None],
                                                                     axis=1)[:, 0], np.inf)
            radius[block] = np.minimum(least(distances(x[block], x), weight), limit)
        return group.append_column("cell", pa.array(_cells(x))).append_column("radius", pa.array(radius))

    def compare(own: pa.Table, given: pa.Table) -> pa.Table:
        x, weight = _both(own, given, "weight")
        core = np.full(own.num_rows, np.inf)
        for mine, at in _around(own, x):
            core[mine] = least(distances(x[mine], x[at]), weight[at])
        return own.drop_columns(["radius"]).append_column("core", pa.array(core))

    kinds = "row long, x array<double>, weight long, leaf long, cell int"
    homes = stored(points.select("row", "x", "weight", "leaf").groupBy("leaf").applyInArrow(home, f"{kinds}, radius double"), "density")
    return stored(_with_halo(homes, leaves, dims, compare, f"{kinds}, core double"), "density")


EDGE = "a long, b long, w double"


def _lower(w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order of edges: by weight, then by their two rows, the same in every task, so that no cycle can arise."""
    return np.lexsort((np.maximum(a, b), np.minimum(a, b), w))


def _edges(columns: dict) -> pa.Table:
    kinds = {"a": pa.int64(), "b": pa.int64(), "w": pa.float64(), "comp": pa.int64(), "to": pa.int64()}
    return pa.table({c: pa.array(v, kinds[c]) for c, v in columns.items()})


def _climbs(own: pa.Table, given: pa.Table) -> pa.Table:
    """The least edge of each point whose weight is its core distance: as none can be less, it is sure."""
    x, core, row = _both(own, given, "core", "row")
    out = {"comp": [], "to": [], "a": [], "b": [], "w": []}
    for mine, at in _around(own, x):
        fits = (distances(x[mine], x[at]) <= core[mine][:, None]) & (core[at][None, :] <= core[mine][:, None])
        fits &= row[mine][:, None] != row[at][None, :]
        one, two = row[mine][:, None], row[at][None, :]
        # all of a point's weigh the same: the smallest pair of rows
        first = np.where(fits, np.minimum(one, two), np.iinfo(np.int64).max)
        fits &= first == first.min(axis=1)[:, None]
        second = np.where(fits, np.maximum(one, two), np.iinfo(np.int64).max)
        some = np.flatnonzero(fits.any(axis=1) & np.isfinite(core[mine]))
        a, b, chooser = first.min(axis=1)[some], second.min(axis=1)[some], row[mine][some]
        for c, v in (("comp", chooser), ("to", np.where(a == chooser, b, a)), ("a", a), ("b", b), ("w", core[mine][some])):
            out[c].append(v)
    return _edges({c: np.concatenate(v) if v else [] for c, v in out.items()})


def _links(own: pa.Table, given: pa.Table) -> pa.Table:
    """The least edge of each pair of components, of the edges from asking points to foreign points within their radius."""
    x, core, row, comp = _both(own, given, "core", "row", "comp")
    radius = own["radius"].to_numpy()
    found = []
    for mine, at in _around(own, x):
        mine = mine[np.argsort(comp[mine], kind="stable")]
        at = at[np.argsort(comp[at], kind="stable")]
        if comp[mine[0]] == comp[mine[-1]]:
            at = at[comp[at] != comp[mine[0]]]
        if not at.size:
            continue
        apart = distances(x[mine], x[at])
        w = np.maximum(apart, np.maximum(core[mine][:, None], core[at][None, :]))
        w[(apart > radius[mine][:, None]) | (comp[mine][:, None] == comp[at][None, :])] = np.inf
        heads = [np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))) for c in (comp[mine], comp[at])]
        least = np.minimum.reduceat(np.minimum.reduceat(w, heads[1], axis=1), heads[0], axis=0)
        sizes = [np.diff(h, append=n) for h, n in zip(heads, w.shape)]
        i, j = np.nonzero((w == np.repeat(np.repeat(least, sizes[0], axis=0), sizes[1], axis=1)) & np.isfinite(w))
        found.append((row[mine[i]], row[at[j]], w[i, j], comp[mine[i]], comp[at[j]]))
    a, b, w, one, two = (np.concatenate(v) for v in zip(*found)) if found else [np.array([])] * 5
    swap = one > two
    one, two, a, b = np.where(swap, two, one), np.where(swap, one, two), np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a, w, two, one))
    first = order[np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))] if len(order) else []
    return _edges({c: v[first] if len(order) else [] for c, v in (("comp", one), ("to", two), ("a", a), ("b", b), ("w", w))})


def _renamed(best: DataFrame) -> DataFrame:
    """(comp, new) of the components that join another one along their least edges (comp, to).

    Edges have a total order, so components that follow their least edges run in trees, each with one pair at its root that
    chose the same edge; the smaller one names them all. Steps double in each round.
    """
    back = best.select(F.col("comp").alias("to"), F.col("to").alias("again"))
    root = (F.col("comp") < F.col("to")) & F.coalesce(F.col("again") == F.col("comp"), F.lit(False))
    up = stored(best.select("comp", "to").join(back, "to", "left").where(~root).select("comp", F.col("to").alias("new")), "density")
    while True:
        further = up.select(F.col("comp").alias("new"), F.col("new").alias("end"))
        longer = stored(up.join(further, "new", "left").select("comp", "new", "end"), "density")
        if longer.where(F.col("end").isNotNull()).isEmpty():
            return up
        up = longer.select("comp", F.coalesce("end", "new").alias("new"))


def _named(df: DataFrame, names: DataFrame, column: str = "comp") -> DataFrame:
    named = df.join(names.withColumnRenamed("comp", column), column, "left")
    return named.withColumn(column, F.coalesce("new", column)).drop("new")


def spanning_tree(points: DataFrame, dims: int) -> DataFrame:
    """Edges (a, b, w) of the minimum spanning tree of mutual reachability over ``points`` (row, x, core, leaf, cell)."""
    leaves = _leaf_table(points, dims)
    state = points.select("row", "x", "core", "leaf", "cell")
    near = state.withColumn("radius", F.col("core"))
    best = stored(_with_halo(near, leaves, dims, _climbs, f"comp long, to long, {EDGE}"), "density")
    tree = [best.select("a", "b", "w").distinct()]
    state = stored(_named(state.withColumn("comp", F.col("row")), _renamed(best)), "density")
    # the least edges known between components: first those within core distances
    known = stored(_least_links(_found(state, leaves, dims, F.col("core"))), "density")
    while (ends := state.agg(F.min("comp").alias("one"), F.max("comp").alias("two")).first())["one"] != ends["two"]:
        upper = _upper_bounds(state, leaves, known)
        radius = F.when(F.col("core") < F.col("bound"), F.col("bound")).otherwise(-1.0)
        asking = stored(state.join(upper, "comp").withColumn("radius", radius).drop("bound"), "density")
        known = stored(_least_links(known.unionByName(_found(asking, leaves, dims, F.col("radius")))), "density")
        best = stored(_sides(known).groupBy("comp").agg(F.min("e").alias("e")).select("comp", "e.to", "e.a", "e.b", "e.w"), "density")
        tree.append(best.select("a", "b", "w").distinct())
        names = _renamed(best)
        state = stored(_named(state, names), "density")
        known = _named(_named(known, names), names, "to").where("comp != to")
        known = stored(_least_links(known.select(F.least("comp", "to").alias("comp"), F.greatest("comp", "to").alias("to"), "a", "b", "w")), "density")
    whole = tree[0]
    for part in tree[1:]:
        whole = whole.unionByName(part)
    return stored(whole, "density")


def _least_links(links: DataFrame) -> DataFrame:
    return links.groupBy("comp", "to").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("comp", "to", "e.a", "e.b", "e.w")


def _sides(links: DataFrame) -> DataFrame:
    """comp, e: each link as seen from either component."""
    seen = lambda one, two: links.select(F.col(one).alias("comp"), F.struct("w", "a", "b", F.col(two).alias("to")).alias("e"))
    return seen("comp", "to").unionByName(seen("to", "comp"))


def _alone(state: DataFrame, leaves: Leaves) -> np.ndarray:
    """The component of each leaf that holds a single one, else -1."""
    pure = {r["leaf"]: r["one"] for r in state.groupBy("leaf").agg(F.min("comp").alias("one"), F.max("comp").alias("two"))
            .where("one = two").collect()}
    return np.array([pure.get(int(n), -1) for n in leaves.number], np.int64)


def _found(state: DataFrame, leaves: Leaves, dims: int, radius) -> DataFrame:
    """comp, to, a, b, w: links within ``radius`` of each point."""
    asking = state.withColumn("radius", radius).select("row", "x", "core", "comp", "leaf", "cell", "radius")
    return _with_halo(asking, leaves, dims, _links, f"comp long, to long, {EDGE}", _alone(state, leaves))


def _upper_bounds(state: DataFrame, leaves: Leaves, known: DataFrame) -> DataFrame:
    """comp, bound: no component's least edge weighs more; by the links known, by boxes where there are none."""
    sure = _sides(known).groupBy("comp").agg(F.min("e.w").alias("bound"))
    rest = state.join(sure, "comp", "left_anti").select("leaf", "comp")
    if rest.isEmpty():
        return sure
    alone = _alone(state, leaves)

    def bounds(group: pa.Table) -> pa.Table:
        """From boxes alone: a leaf of the component and one with others."""
        own = leaves.number == group["leaf"][0].as_py()
        comps = np.unique(group["comp"].to_numpy())
        reach = np.zeros(len(own))
        for axis in range(leaves.low.shape[1]):
            reach += np.maximum(np.abs(leaves.high[own, axis] - leaves.low[:, axis]), np.abs(leaves.high[:, axis] - leaves.low[own, axis])) ** 2
        reach = np.maximum(np.sqrt(reach) * (1 + 1e-12), np.maximum(leaves.most_core, leaves.most_core[own]))
        order = np.argsort(reach, kind="stable")
        least = [reach[order[(alone[order] != c).argmax()]] if (alone != c).any() else np.inf for c in comps]
        return pa.table({"comp": comps, "bound": np.array(least, float)})

    return sure.unionByName(rest.groupBy("leaf").applyInArrow(bounds, "comp long, bound double").groupBy("comp").agg(
        F.min("bound").alias("bound")))


class Forest:
    """Components while edges are added in ascending order, with the condensed clusters that they belong to."""

    def __init__(self, least: int):
        self.least, self.up, self.data = least, {}, {}
        self.home: dict[int, int] = {}  # component as it was -> cluster that its points came into then
        self.went: dict[int, int] = {}  # component -> the one it joined
        self.closed: list[tuple] = []

    def add(self, comp: int, size: int, cluster: int, mass: float, inner: float) -> None:
        self.up[comp], self.data[comp] = comp, [size, cluster, mass, inner]

    def root(self, comp: int) -> int:
        top = comp
        while self.up[top] != top:
            top = self.up[top]
        while self.up[comp] != top:
            self.up[comp], comp = top, self.up[comp]
        return top

    def close(self, comp: int, parent: int, birth: float) -> float:
        """Stability of a cluster that ends (seen from below) when it joins another one; the better of it and its parts."""
        size, cluster, mass, inner = self.data[comp]
        own = mass - size * birth
        self.closed.append((cluster, parent, birth, own, own >= inner))
        return max(own, inner)

    def join(self, a: int, b: int, w: float, number: int) -> None:
        """Add an edge; ``number`` names the cluster that it may begin. A point's cluster is the first it lies in."""
        one, two = sorted((self.root(a), self.root(b)), key=lambda c: (-self.data[c][0], c))
        dense, (m, ca, mass, inner), (n, cb, _, _) = 1.0 / max(w, SMALLEST), self.data[one], self.data[two]
        if ca >= 0 and cb >= 0:  # a true split: both end, another cluster holds them
            inner = self.close(one, number, dense) + self.close(two, number, dense)
            self.data[one] = [m + n, number, (m + n) * dense, inner]
        elif ca >= 0:  # the smaller part leaves the cluster at this density
            self.home[two] = ca
            self.data[one] = [m + n, ca, mass + n * dense, inner]
        elif m + n >= self.least:
            self.home[one] = self.home[two] = number
            self.data[one] = [m + n, number, (m + n) * dense, 0.0]
        else:
            self.data[one] = [m + n, -1, 0.0, 0.0]
        self.up[two] = self.went[two] = one

    def first_cluster(self, comp: int) -> int:
        """The cluster that a component's points came into first in this band; -1 if none."""
        while comp not in self.home:
            if comp not in self.went:
                return -1
            comp = self.went[comp]
        return self.home[comp]


CLIMBED = ("kind string, comp long, top long, size long, cluster long, mass double, inner double, parent long, birth double, "
           "stability double, better boolean, home long")
CLUSTERS = "cluster long, parent long, birth double, stability double, better boolean"


def condensed_tree(edges: DataFrame, points: DataFrame, min_cluster_size: int, band_edges: int = BAND_EDGES) -> tuple[DataFrame, DataFrame]:
    """Clusters (cluster, parent, birth, stability, better) and each row's first cluster (row, cluster; -1: none).

    Edges go up in bands of about ``band_edges`` by weight, one after another; a
    task holds one band and the components that it touches, and tells where each of them has gone.
    ``better``: a cluster is at least as stable as the best choice among its parts. The root has no parent.
    """
    spark, total = edges.sparkSession, edges.count()
    bands = max(1, -(-total // band_edges))
    banded = stored(edges.repartitionByRange(bands, "w", "a", "b").withColumn("band", F.spark_partition_id()), "density")
    # a point of a weight above the least size is a cluster of its own, which no edge begins; its rows leave at its core distance
    heavy = F.col("weight") >= min_cluster_size
    dense = 1.0 / F.greatest("core", F.lit(SMALLEST))
    lone = F.when(heavy, F.col("row") + F.lit(1 << 60)).otherwise(-1)
    comps = stored(points.select(
        F.col("row").alias("comp"), F.col("weight").alias("size"), lone.alias("cluster"),
        F.when(heavy, F.col("weight") * dense).otherwise(0.0).alias("mass"), F.lit(0.0).alias("inner")), "density")
    where = stored(points.select("row", F.col("row").alias("comp"), lone.alias("cluster")), "density")
    clusters = spark.createDataFrame([], CLUSTERS)

    for band in range(bands):
        now = banded.where(F.col("band") == band).select("a", "b", "w")
        ends = where.select(F.col("row"), F.col("comp"))
        met = now.join(ends.withColumnRenamed("row", "a").withColumnRenamed("comp", "ca"), "a").join(
            ends.withColumnRenamed("row", "b").withColumnRenamed("comp", "cb"), "b")
        touched = met.select(F.col("ca").alias("comp")).unionByName(met.select(F.col("cb").alias("comp"))).distinct()
        held = comps.join(touched, "comp").select(F.lit(0).alias("one"), "comp", "size", "cluster", "mass", "inner")
        given = met.select(F.lit(0).alias("one"), "a", "b", "w", "ca", "cb")

        def climb(parts: pa.Table, links: pa.Table) -> pa.Table:
            forest = Forest(min_cluster_size)
            columns = (parts[c].to_pylist() for c in ("comp", "size", "cluster", "mass", "inner"))
            for part in zip(*columns):
                forest.add(*part)
            a, b, w = (links[c].to_numpy() for c in ("a", "b", "w"))
            order = _lower(w, a, b)
            ends = links["ca"].to_numpy()[order].tolist(), links["cb"].to_numpy()[order].tolist()
            for i, (one, two, weight) in enumerate(zip(*ends, w[order].tolist())):
                forest.join(one, two, weight, (band << 40) + i)  # an edge's place names the cluster that it begins
            rows = []
            for comp in forest.up:
                top = forest.root(comp)
                data = forest.data[top] if top == comp else [None] * 4
                rows.append(("comp", comp, top, *data, None, None, None, None, forest.first_cluster(comp)))
            rows += [("cluster", None, None, None, cluster, None, None, parent, birth, own, better, None)
                     for cluster, parent, birth, own, better in forest.closed]
            kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
            fields = [(name, kinds[kind]) for name, kind in (f.split() for f in CLIMBED.split(", "))]
            return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

        out = stored(held.groupBy("one").cogroup(given.groupBy("one")).applyInArrow(climb, CLIMBED), "density")
        clusters = clusters.unionByName(out.where("kind = 'cluster'").select("cluster", "parent", "birth", "stability", "better"))
        moved = out.where("kind = 'comp'")
        comps = stored(comps.join(moved.select("comp"), "comp", "left_anti").unionByName(
            moved.where("comp = top").select("comp", "size", "cluster", "mass", "inner")), "density")
        went = moved.select(F.col("comp").alias("from"), "top", "home")
        where = stored(where.join(went, F.col("comp") == F.col("from"), "left").select(
            "row", F.coalesce("top", "comp").alias("comp"),
            F.when((F.col("cluster") == -1) & (F.coalesce("home", F.lit(-1)) >= 0), F.col("home")).otherwise(F.col("cluster")).alias("cluster")), "density")
    # what is left is the root, or several of them if some points can't be reached
    none = F.lit(None)
    roots = comps.where("cluster >= 0").select("cluster", none.cast("long").alias("parent"), F.lit(0.0).alias("birth"),
                                               F.col("mass").alias("stability"), F.lit(False).alias("better"))
    return stored(clusters.unionByName(roots), "density"), where.select("row", "cluster")


def chosen_clusters(clusters: DataFrame) -> DataFrame:
    """(cluster, chosen): the topmost cluster at or above each one that is better than all choices among its parts.

    Links to parents double in each round, so rounds are logarithmic in the tree's height. The root is never chosen.
    """
    picked = F.when(F.col("better") & F.col("parent").isNotNull(), F.col("cluster"))
    state = stored(clusters.select("cluster", F.col("parent").alias("up"), picked.alias("chosen")), "density")
    while not state.where(F.col("up").isNotNull()).isEmpty():
        above = state.select(F.col("cluster").alias("up"), F.col("up").alias("further"), F.col("chosen").alias("higher"))
        state = stored(state.join(above, "up", "left").select("cluster", F.col("further").alias("up"),
                                                                    F.coalesce("higher", "chosen").alias("chosen")), "density")
    return state.select("cluster", "chosen")


def weighted_points(df: DataFrame, vec: str, leaf_points: int) -> tuple[DataFrame, int, int]:
    """row, x, weight, leaf: one row for each distinct vector; with the rows' number and the vectors' length."""
    x = F.transform(F.col(vec), lambda v: v.cast("double") + F.lit(0.0))  # -0.0 is 0.0
    fine = F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    each = df.select(x.alias("x")).where(fine).groupBy("x").agg(F.count("*").alias("weight"))
    each = stored(each.withColumn("row", F.monotonically_increasing_id()), "density")
    found = each.agg(F.count("*").alias("n"), F.sum("weight").alias("rows"), F.min(F.size("x")).alias("short"),
                     F.max(F.size("x")).alias("long")).first()
    if found["short"] != found["long"]:
        raise ValueError("vectors of different lengths can't be clustered")
    if not found["n"]:
        return each.withColumn("leaf", F.lit(0).cast("long")), 0, 0
    tree = SplitTree.fit(sample_points(each, [F.col("x")], F.col("row"))[0], min(-(-found["n"] // leaf_points), MAX_LEAVES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("leaf", pa.array(tree.leaf_of(_matrix(batch.column("x"), batch.num_rows))))

    dealt = each.select("row", "x", "weight").mapInArrow(deal, "row long, x array<double>, weight long, leaf long")
    return stored(dealt, "density"), found["rows"], found["long"]


def cluster_hdbscan(df: DataFrame, key: str, vec: str, min_cluster_size: int = 100, min_samples: int | None = None,
                    out: str = "topic_id", leaf_points: int = LEAF_POINTS, band_edges: int = BAND_EDGES) -> DataFrame:
    """``df`` with the cluster of each row in ``out`` (from 0, largest first, ties by ``key``); -1 is noise.

    ``min_samples`` neighbours (the row itself not counted; ``min_cluster_size`` if not given) set a row's core
    distance. Rows whose vector is NULL or holds a NULL or non-finite component are noise. If no split has enough
    rows on both sides, all rows are noise. Rows of equal vectors have the same cluster.
    """
    points, rows, dims = weighted_points(df, vec, leaf_points)
    if rows < 2 or not dims:
        return df.withColumn(out, F.lit(-1))
    points = core_distances(points, dims, min(min_samples or min_cluster_size, rows - 1))
    clusters, first = condensed_tree(spanning_tree(points, dims), points, min_cluster_size, band_edges)
    chosen = chosen_clusters(clusters)
    label = points.select("row", "x").join(first, "row").join(chosen, "cluster", "left").select("x", F.col("chosen").alias("_cluster"))
    x = F.transform(F.col(vec), lambda v: v.cast("double") + F.lit(0.0))
    tagged = df.withColumn("_x", x).join(label.where(F.col("_cluster").isNotNull()).withColumnRenamed("x", "_x"), "_x", "left").drop("_x")
    tagged = stored(tagged, "density")
    sizes = tagged.where(F.col("_cluster").isNotNull()).groupBy("_cluster").agg(F.count("*").alias("_n"), F.min(key).alias("_k"))
    ids = sizes.select(F.col("_cluster"), (F.row_number().over(Window.orderBy(F.desc("_n"), "_k")) - 1).cast("int").alias(out))
    return tagged.drop(*[out]).join(maybe_broadcast(ids)[0], "_cluster", "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1))).drop("_cluster")
