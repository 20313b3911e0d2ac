import numpy as np
import pytest
from llm_fixtures import SF_SMALL  # noqa: F401
from pyspark.sql import functions as F

from crisismap.llm import kd_search as K


def brute(vectors, ids, queries, top):
    out = []
    for i in queries:
        scores = vectors @ vectors[i]
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:top]
        out += [(int(ids[i]), rank, int(ids[j]), int(scores[j])) for rank, j in enumerate(order, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(4096, 2048), (40, 2)])
def test_query_equals_brute_force(spark, sizes):
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    vectors = np.floor(np.array([r.embedding for r in rows], float) * 1024).astype(np.int64)
    got = K.top_k(spark.read.parquet(f"{SF_SMALL}/embeddings.parquet"), F.col("vec_id") % 100 == 0, shard_rows=sizes[0],
                  block_queries=sizes[1]).collect()
    assert sorted(map(tuple, got)) == brute(vectors, ids, np.flatnonzero(ids % 100 == 0), 10)


def test_ties_and_a_hot_vector(spark):
    rng = np.random.default_rng(2)
    vectors = np.round(rng.normal(0, 1, (400, 6)), 1)
    vectors[rng.permutation(400)[:200]] = vectors[0]
    ids = rng.permutation(400)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>")
    whole = np.floor(vectors.astype(np.float32).astype(float) * 1024).astype(np.int64)
    got = K.top_k(df, F.col("vec_id") % 20 == 0, shard_rows=60).collect()
    assert sorted(map(tuple, got)) == brute(whole, ids, np.flatnonzero(ids % 20 == 0), 10)


def test_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 1.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [float("inf"), 0.0]),
            (None, [1.0, 1.0]), (5, [1.0]), (6, []), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (8, [1e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("row", F.lit(1))
    got = [tuple(r) for r in K.top_k(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    one, most = 1024 * 1024, (1 << 63) - 1  # a score beyond 64 bits counts as the largest one
    assert got == [(0, 1, 8, most), (0, 2, 100, one), (0, 3, None, one), (0, 4, 7, one // 2), (0, 5, 7, one // 2),
                   (100, 1, 8, most), (100, 2, None, 2 * one), (100, 3, 0, one), (100, 4, 7, one), (100, 5, 7, one)]
    assert K.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_large_components_are_not_left_out(spark):
    rows = [(0, [1.0, 0.0]), (1, [70000.0, 0.0]), (2, [1.0, 1.0]), (100, [66000.0, 1.0]), (3, [-1e12, 5.0]), (4, [3e9, -7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    want = []
    for q in (0, 100):
        scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(whole[q], v)))), i) for i, v in whole.items() if i != q)
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    for shard in (4096, 2):
        got = K.top_k(df, F.col("vec_id") % 100 == 0, shard_rows=shard).orderBy("query_id", "rank").collect()
        assert [tuple(r) for r in got] == want
