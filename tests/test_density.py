import numpy as np
import pytest

from crisismap.operators import density as D


def brute_tree(x, min_samples):
    """Sorted spanning-tree edges (w, a, b) by Kruskal over all pairs."""
    n = len(x)
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(apart, axis=1)[:, min(min_samples, n - 1)]
    reach = np.maximum(apart, np.maximum(core[:, None], core[None]))
    pairs = sorted((reach[a, b], a, b) for a in range(n) for b in range(a + 1, n))
    parent, tree = list(range(n)), []

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for w, a, b in pairs:
        if root(a) != root(b):
            parent[root(a)] = root(b)
            tree.append((w, a, b))
    return tree


def brute_labels(x, least, min_samples):
    """Top-down: cut the heaviest edge of a cluster, keep parts of enough points, choose by excess of mass."""
    tree = brute_tree(x, min_samples)
    labels = np.full(len(x), -1)

    def parts(edges, members):
        around = {m: [] for m in members}
        for _, a, b in edges:
            around[a].append(b)
            around[b].append(a)
        seen, out = set(), []
        for m in members:
            if m not in seen:
                group, todo = set(), [m]
                while todo:
                    i = todo.pop()
                    if i not in group:
                        group.add(i)
                        todo += around[i]
                seen |= group
                out.append(group)
        return out

    def grow(edges, members, birth):
        """(stability of the best choice, chosen sets of members)."""
        whole, mass, edges = set(members), 0.0, sorted(edges)
        while edges:
            w, *_ = edges.pop()
            dense = 1 / max(w, 1e-10)
            groups = parts(edges, members)
            large = [g for g in groups if len(g) >= least]
            if len(large) == 2:
                mass += (dense - birth) * len(members)
                inner = [grow([e for e in edges if e[1] in g], g, dense) for g in large]
                below = sum(v for v, _ in inner)
                return (mass, [whole]) if mass >= below else (below, [c for _, chosen in inner for c in chosen])
            stay = large[0] if large else set()
            mass += (dense - birth) * (len(members) - len(stay))
            members, edges = stay, [e for e in edges if e[1] in stay]
        return mass, [whole]

    _, chosen = grow(tree, set(range(len(x))), 0.0)
    if len(chosen) > 1 or len(chosen[0]) < len(x):
        for i, group in enumerate(chosen):
            labels[list(group)] = i
    return labels


def partition(labels):
    groups = {}
    for i, label in enumerate(labels):
        groups.setdefault(int(label), set()).add(i)
    return groups.pop(-1, set()), sorted(map(sorted, groups.values()))


def found(spark, x, least, min_samples, **sizes):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)
    rows = D.cluster_hdbscan(df, "id", "vec", least, min_samples, **sizes).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(len(x)))
    return [r.topic_id for r in rows]


def densities(rng, n=300):
    """A tight and a wide cluster side by side, a third far off, and noise: no one radius tells them apart."""
    return np.concatenate([rng.normal([0, 0, 0], 0.05, (n // 3, 3)), rng.normal([1.5, 0, 0], 0.4, (n // 3, 3)),
                           rng.normal([8, 8, 0], 1.0, (n // 4, 3)), rng.uniform(-10, 15, (n - 2 * (n // 3) - n // 4, 3))])


@pytest.mark.parametrize("leaf_points, band_edges", [(2048, 1 << 20), (25, 40)])
def test_labels_equal_brute_force_hierarchy(spark, leaf_points, band_edges):
    x = densities(np.random.default_rng(1))
    labels = found(spark, x, 12, 5, leaf_points=leaf_points, band_edges=band_edges)
    assert partition(labels) == partition(brute_labels(x, 12, 5))
    assert len({labels[10], labels[150], labels[230], -1}) == 4  # the clusters are told apart


def test_spanning_tree_equals_brute_force(spark):
    x = np.random.default_rng(2).normal(0, 1, (250, 2)).round(2)
    df = spark.createDataFrame([(v.tolist(),) for v in np.unique(x, axis=0)], "vec array<double>")
    points, rows, dims = D.weighted_points(df, "vec", 20)
    points = D.core_distances(points, dims, 4)
    edges = D.spanning_tree(points, dims).collect()
    want = brute_tree(np.unique(x, axis=0), 4)
    assert np.allclose(sorted(e.w for e in edges), [w for w, _, _ in want], rtol=0, atol=1e-12) and len(edges) == rows - 1


def test_leaves_get_only_points_within_reach_and_each_once(spark):
    """Around a leaf lie those points that a ball of one of its points holds, not a row for every visit."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.uniform(0, 1, (150, 2)), rng.uniform(50, 51, (150, 2))])
    points, _, dims = D.weighted_points(spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>"), "vec", 80)
    asking = points.withColumn("cell", F.lit(0)).withColumn("radius", F.lit(0.2))

    def met(own, given):
        import pyarrow as pa

        return pa.table({"leaf": own["leaf"][:1], "rows": [given["row"].to_pylist()]})

    halo = {r.leaf: r.rows for r in D._with_halo(asking, D._leaf_table(points, dims), dims, met, "leaf long, rows array<long>").collect()}
    rows = points.collect()
    at, leaf = np.array([r.x for r in rows]), np.array([r.leaf for r in rows])
    for number, got in halo.items():
        assert len(got) == len(set(got))
        apart = D.distances(at[leaf != number], at[leaf == number]).min(axis=1)
        others = np.array([r.row for r in rows])[leaf != number]
        assert set(others[apart <= 0.2]) <= set(got) and len(got) < 150  # nothing of the far half
    assert sum(map(len, halo.values())) > 0


def test_copies_odd_rows_and_ties(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.1, (60, 2)), rng.normal(3, 0.3, (60, 2)), np.tile([[9.0, 9.0]], (70, 1))])  # a third on one spot
    assert partition(found(spark, x, 10, 4, leaf_points=30)) == partition(brute_labels(x, 10, 4))
    grid = np.array([[i, j] for i in range(8) for j in range(8)], float)
    assert len(found(spark, grid, 5, 3, leaf_points=10)) == 64  # nothing but ties: they are broken by row number
    odd = spark.createDataFrame([(1, None), (2, [0.0, None]), (3, [float("nan"), 1.0]), (4, [0.0, 1.0])], "id long, vec array<double>")
    assert {r.topic_id for r in D.cluster_hdbscan(odd, "id", "vec", 2).collect()} == {-1}
    assert D.cluster_hdbscan(odd.limit(0), "id", "vec", 2).count() == 0


def test_split_tree_holds_equal_loads():
    from crisismap.operators.splits import SplitTree

    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(0, 0.01, (3000, 2)), rng.uniform(-50, 50, (1000, 2)), np.zeros((2000, 2))])
    tree = SplitTree.fit(points, 40)
    loads = np.bincount(tree.leaf_of(points), minlength=tree.leaves)
    assert tree.leaves == 40 and loads.sum() == 6000 and np.sort(loads)[:-1].max() < 300  # one spot can't be split
    low, high = points[::50] - 1, points[::50] + 1
    held = tree.nodes(2)
    boxes, nodes = held.cover(low, high, 1000)  # enough for leaves alone
    leaves = nodes - held.inner
    leaf = tree.leaf_of(points)
    for i in range(len(low)):
        inside = ((points >= low[i]) & (points <= high[i])).all(axis=1)
        assert set(leaf[inside]) <= set(leaves[boxes == i])
