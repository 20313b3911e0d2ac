import duckdb
import numpy as np
import pytest
from llm_fixtures import SF_SMALL
from pyspark.sql import functions as F

from crisismap.llm import hard_negatives as N
from crisismap.llm.exact import products

BIG = 1 << 63


def brute(rows):
    """Plain loops over all pairs: the definition, in Python integers."""
    taken = []
    for at, (i, label, vector) in enumerate(rows):
        if label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        taken.append((at, i, label, [int(np.floor(256 * float(x))) for x in vector]))
    out = []
    for at, i, label, u in taken:
        if i is None or i % 100:
            continue
        scored = [(max(-BIG, min(BIG - 1, sum(x * y for x, y in zip(u, v)))), j is None, j or 0, b, j, other)
                  for b, j, other, v in taken if b != at and len(v) == len(u)]
        scored.sort(key=lambda s: (-s[0], *s[1:4]))
        for p, *_, positive, _ in [s for s in scored if s[5] == label][:5]:
            window = [s for s in scored if s[5] != label and 80 * p <= 100 * s[0] <= 100 * p][:5]
            out += [(i, positive, rank, s[4], p, s[0]) for rank, s in enumerate(window, 1)]
    return sorted(out, key=str)


def mined(spark, rows, **sizes):
    df = spark.createDataFrame([(i, v, label) for i, label, v in rows], "vec_id long, embedding array<double>, label int")
    df = df.withColumn("row", F.lit("x")).withColumn("score", F.lit("x")).withColumn("cluster", F.lit(1)).coalesce(1)
    return sorted((tuple(r) for r in N.hard_negatives(df, F.col("vec_id") % 100 == 0, **sizes).collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"block_components": 128, "shard_components": 3200}])
def test_query_equals_sql(spark, sizes):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF_SMALL}/embeddings.parquet'")
    want = sorted(con.execute(N.ORACLE["op13_hard_negatives"]).fetchall())
    got = N.hard_negatives(spark.read.parquet(f"{SF_SMALL}/embeddings.parquet"), F.col("vec_id") % 100 == 0, **sizes).collect()
    assert len(want) > 50 and sorted(map(tuple, got)) == want


def test_ties_clusters_and_a_hot_vector(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (6, 5))
    vectors = np.round(centres[rng.integers(0, 6, 500)] * rng.uniform(0.2, 2, (500, 1)) + rng.normal(0, 0.2, (500, 5)), 1)
    vectors[rng.permutation(500)[:170]] = vectors[0]  # a third of all rows
    vectors[:5] = 0
    ids = rng.permutation(500) * 10
    rows = [(int(i), int(rng.integers(0, 4)), v.tolist()) for i, v in zip(ids, vectors)]
    assert mined(spark, rows, block_components=20, shard_components=200) == brute(rows)


def test_edges(spark):
    nan = float("nan")
    rows = [(0, 1, [1.0, 0.0]), (100, 2, [1.0, 1.0]), (1, None, [1.0, 1.0]), (2, 1, None), (3, 1, [None, 1.0]), (4, 1, [nan, 1.0]),
            (5, 1, [float("inf"), 0.0]), (None, 2, [1.0, 0.0]), (6, 2, [1.0]), (8, 2, []), (9, 3, [0.9, 0.0]), (9, 3, [0.9, 0.0]),
            (200, 4, [-1.0, -1.0]), (10, 4, [1.0, 0.5]), (11, 5, [-0.4, -0.5]), (300, 5, [0.0, 0.0]), (12, 5, [0.0, 0.1])]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, block_components=1, shard_components=1) == brute(rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert N.hard_negatives(empty, F.col("vec_id") % 100 == 0).count() == 0


def test_large_components_are_not_left_out(spark):
    rows = [(0, 1, [1e5, 1.0]), (1, 1, [3e4, 2.0]), (2, 3, [2.9e4, 1.0]), (3, 3, [2.5e4, 0.0]), (100, 3, [1e30, 1.0]),
            (5, 3, [1e12, 2.0]), (6, 4, [9e11, -2.0]), (200, 6, [-1e30, 0.0]), (8, 6, [1e30, 1.0]), (9, 7, [1e30, 0.0])]
    assert mined(spark, rows) == brute(rows)


def test_products_are_exact_at_any_size():
    rng = np.random.default_rng(5)
    for top in (300, 1 << 24, 1 << 29, 1 << 52):
        a, b = (np.floor(rng.uniform(-top, top, (4, 9))) for _ in range(2))
        want = [[max(-BIG, min(BIG - 1, sum(int(x) * int(y) for x, y in zip(u, v)))) for v in b] for u in a]
        assert products(a, b).tolist() == want


def test_bounds_hold():
    rng = np.random.default_rng(6)
    anchors, candidates = rng.normal(0, 3, (40, 6)) + 2, rng.normal(0, 3, (300, 6))
    shard = {"vector": candidates, "place": np.arange(300), "label": np.zeros(300), "row": np.arange(300)}
    shared = N.SharedList.sort(anchors, shard)
    assert (np.diff(shared.reach) <= 0).all()
    assert (anchors @ shared.vectors.T <= N.lengths(anchors)[:, None] * shared.reach + 1e-6).all()
