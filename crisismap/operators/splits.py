"""Split trees: space cut into leaves of equal load, fitted on a bounded sample.

A tree's nodes halve the sample at the median of their widest axis, so dense places get small leaves
and empty ones large ones. Trees are small (a few numbers a leaf) and travel to the executors in closures.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points that a tree is fitted on, and leaves it may have: both bounded at any size of the data.
SAMPLE_POINTS = 65_536
MAX_LEAVES = 16_384


@dataclass
class SplitTree:
    """Inner nodes hold an axis, a cut and two children; a child below 0 is leaf ``-1 - child``."""

    axis: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    below: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    root: int = -1
    leaves: int = 1

    @classmethod
    def fit(cls, points: np.ndarray, leaves: int, most: int = MAX_LEAVES) -> SplitTree:
        """Split the part with most points until there are ``leaves`` parts (``most`` at the most) or only equal points are left."""
        tree = cls()
        parts = [(-len(points), 0, np.arange(len(points)), None)]  # size, leaf, points, place of its link
        while parts and tree.leaves < min(leaves, most):
            _, leaf, rows, link = heapq.heappop(parts)
            part = points[rows]
            spread = part.max(axis=0) - part.min(axis=0) if len(rows) > 1 else np.zeros(1)
            wide = int(spread.argmax())
            if not spread[wide] > 0:
                continue
            values = part[:, wide]
            cut = float(np.median(values))
            cut = cut if (values < cut).any() else float(values[values > cut].min())  # both sides get points
            node, other = len(tree.axis), tree.leaves
            tree.leaves += 1
            tree.axis.append(wide)
            tree.cut.append(cut)
            tree.below.append(-1 - leaf)
            tree.above.append(-1 - other)
            if link is None:
                tree.root = node
            else:
                getattr(tree, link[0])[link[1]] = node
            low = rows[values < cut]
            high = rows[values >= cut]
            heapq.heappush(parts, (-len(low), leaf, low, ("below", node)))
            heapq.heappush(parts, (-len(high), other, high, ("above", node)))
        return tree

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """Leaf number of each point."""
        at = np.full(len(points), self.root, np.int64)
        axis, cut, below, above = (np.array(v) for v in (self.axis, self.cut, self.below, self.above))
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            at[inner] = np.where(points[inner, axis[node]] < cut[node], below[node], above[node])
        return -1 - at

    def nodes(self, dims: int) -> Nodes:
        """All nodes with their regions and links, inner ones first (leaf l is node ``inner + l``)."""
        inner = len(self.axis)
        place = lambda link: link if link >= 0 else inner - 1 - link
        low, high = np.full((inner + self.leaves, dims), -np.inf), np.full((inner + self.leaves, dims), np.inf)
        parent = np.full(inner + self.leaves, -1, np.int64)
        children = np.full((inner + self.leaves, 2), -1, np.int64)
        todo = [place(self.root)]
        for node in todo:
            if node < inner:
                for side, link in enumerate((self.below[node], self.above[node])):
                    child = place(link)
                    parent[child], children[node, side] = node, child
                    low[child], high[child] = low[node], high[node]
                    (high if side == 0 else low)[child, self.axis[node]] = self.cut[node]
                    todo.append(child)
        return Nodes(self, inner, low, high, parent, children)


@dataclass
class Nodes:
    """Nodes of a split tree: regions are [low, high) on each axis."""

    tree: SplitTree
    inner: int
    low: np.ndarray
    high: np.ndarray
    parent: np.ndarray
    children: np.ndarray

    def cover(self, low: np.ndarray, high: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(box, node) pairs: for each box (low, high corner) at most ``limit`` nodes that together hold all of it.

        No node of a box lies in another, so a place in the box is in exactly one of
        them. All nodes of a box are parted into those below that it touches, level by level from the root, for as long
        as the limit allows: a small box ends at a leaf, a large one at nodes further up.
        """
        boxes, nodes = np.arange(len(low)), np.zeros(len(low), np.int64)
        out = [(boxes[:0], nodes[:0])]
        while boxes.size:
            parts = self.children[nodes]
            touch = (parts >= 0) & (low[boxes, None, :] < self.high[parts]).all(axis=2) & (high[boxes, None, :] >= self.low[parts]).all(axis=2)
            leaf = parts[:, 0] < 0
            size = np.bincount(boxes, np.where(leaf, 1, touch.sum(axis=1)), len(low))
            ends = (np.bincount(boxes, ~leaf, len(low)) == 0) | (size > limit)  # nothing to part, or too many parts
            done = ends[boxes]
            out.append((boxes[done], nodes[done]))
            boxes, nodes, parts, touch, leaf = boxes[~done], nodes[~done], parts[~done], touch[~done], leaf[~done]
            row, side = np.nonzero(touch)
            boxes, nodes = np.concatenate([boxes[leaf], boxes[row]]), np.concatenate([nodes[leaf], parts[row, side]])
        boxes, nodes = (np.concatenate(part) for part in zip(*out))
        order = np.lexsort((nodes, boxes))
        return boxes[order], nodes[order]

    def ups(self, node: int) -> list[int]:
        """The nodes above a node, up to the root."""
        found = []
        while (node := int(self.parent[node])) >= 0:
            found.append(node)
        return found


def sample_points(df: DataFrame, columns: list[Column], key: Column, most: int = SAMPLE_POINTS) -> tuple[np.ndarray, int]:
    """Values of ``columns`` (numbers or arrays of them) as a matrix, and how many rows the table has.

    All rows of a table of at most ``most``, read in one job; of a larger one about as many, chosen by a hash of ``key``.
    """
    rows = df.select(*columns).limit(most + 1).toPandas().to_numpy()
    total = len(rows)
    if total > most:
        total = df.count()
        share = int(most / total * (1 << 20)) + 1
        rows = df.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 20)) < share).select(*columns).limit(2 * most).toPandas().to_numpy()
    if not len(rows):
        return np.zeros((0, len(columns))), total
    return np.array([np.concatenate([np.atleast_1d(v) for v in row]) for row in rows], float).reshape(len(rows), -1), total
