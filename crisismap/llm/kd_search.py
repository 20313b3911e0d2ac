"""Operator 8: exact top-k by inner product, with a KD-tree for each shard of the candidates."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crisismap.llm.common import stored, table
from crisismap.llm.exact import LONG_MAX, LONG_MIN, products

TOP = 10
SCALE = 1024
SHARD_ROWS = 4096
BLOCK_QUERIES = 2048
LEAF_ROWS = 32
NOTHING = (LONG_MIN - 1, LONG_MAX)  # score and id of a k-th hit that isn't there
EXACT = 1 << 53  # whole numbers up to here, and their sums, are exact in doubles


class KDTree:
    """Median splits of the widest dimension down to small leaves; each node has the tight box of its rows."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS):
        self.points, self.ids = points, ids  # whole numbers in doubles
        self.reach = points.shape[1] * int(np.abs(points).max(initial=0.0))
        self.low, self.high, self.least_id = [], [], []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        pending = [(np.arange(len(ids)), -1)]
        while pending:
            rows, parent = pending.pop()
            box = points[rows]
            low, high = box.min(axis=0), box.max(axis=0)
            node = len(self.rows)
            self.low.append(low)
            self.high.append(high)
            self.least_id.append(int(ids[rows].min()))
            self.children.append(None)
            self.rows.append(rows)
            if parent >= 0:
                self.children[parent] = (*(self.children[parent] or ()), node)
            wide = int((high - low).argmax()) if low.size else 0
            if len(rows) > leaf and low.size and high[wide] > low[wide]:
                order = rows[np.argpartition(box[:, wide], len(rows) // 2)]
                pending += [(order[:len(rows) // 2], node), (order[len(rows) // 2:], node)]
                self.rows[node] = rows[:0]  # only leaves hold rows
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product that each query can have with a point in each node's box; widened by more than its
        rounding where numbers are too large to be exact."""
        with np.errstate(over="ignore", invalid="ignore"):
            found = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
            if self.reach * int(np.abs(queries).max(initial=0.0)) >= EXACT:
                found += 1e-9 * (np.abs(queries) @ np.maximum(np.abs(self.low), np.abs(self.high)).T) + 1
        return np.maximum(np.where(np.isnan(found), np.inf, found), LONG_MIN)  # scores end there

    def scores(self, at: np.ndarray, query: np.ndarray, small: bool) -> np.ndarray:
        if small:
            return (self.points[at] @ query).astype(np.int64)
        return products(self.points[at], query[None, :])[:, 0]

    def search(self, query: np.ndarray, bounds: list[int], own: int, rows: np.ndarray, top: int,
               kth: tuple[int, int] = NOTHING) -> list[tuple[int, int]]:
        """Best hits (score, id), at most ``top``, no worse than ``kth``; row ``own`` is left out.

        Best first: the node with the highest bound is opened next, and the
        search ends when no open node can hold a hit better than the k-th.
        """
        best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
        floor = (kth[0], -kth[1])
        frontier = [(-bounds[0], self.least_id[0], 0)]
        small = self.reach * int(np.abs(query).max(initial=0.0)) < EXACT
        while frontier:
            bound, least, node = heapq.heappop(frontier)
            worst = max(floor, best[0]) if len(best) == top else floor
            if -bound < worst[0]:
                break
            if (-bound, -least) < worst:
                continue
            if (children := self.children[node]) is not None:
                for child in children:
                    if bounds[child] >= worst[0]:
                        heapq.heappush(frontier, (-bounds[child], self.least_id[child], child))
                continue
            at = self.rows[node]
            scores = self.scores(at, query, small)
            for i in np.flatnonzero(scores >= worst[0]):
                hit = (int(scores[i]), -int(self.ids[at[i]]))
                if rows[at[i]] == own or hit < floor:
                    continue
                if len(best) < top:
                    heapq.heappush(best, hit)
                elif hit > best[0]:
                    heapq.heapreplace(best, hit)
        return [(score, -i) for score, i in best]


@dataclass(frozen=True)
class Layout:
    """How rows are dealt: shards of the candidates, blocks of the queries."""

    shards: int
    blocks: int


HITS = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _search(candidates: pa.Table, queries: pa.Table, top: int) -> pa.Table:
    """Hits of some queries among one shard; both tables have vectors of one length."""
    out: list[tuple[int, int, int, int]] = []
    if candidates.num_rows and queries.num_rows:
        rows = candidates["row"].to_numpy()
        ids = candidates["vec_id"].fill_null(LONG_MAX).to_numpy()
        tree = KDTree(_matrix(candidates["vector"], len(rows)), ids)
        vectors = _matrix(queries["query_vector"], queries.num_rows)
        columns = (queries[c].to_pylist() for c in ("query_row", "query_vec_id", "kth_score", "kth_id"))
        for i, (own, query_id, score, at) in enumerate(zip(*columns, strict=True)):
            bounds = tree.bounds(vectors[i:i + 1])[0].tolist()
            kth = NOTHING if score is None else (score, at)
            out += [(own, query_id, vec_id, s) for s, vec_id in
                    tree.search(vectors[i], bounds, own, rows, top, kth)]
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=HITS)


def integer_vectors(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """row, vec_id, vector: floor(scale * component), in doubles, of every vector that takes part.

    Vectors that are NULL or hold a NULL or non-finite component take no part,
    nor do those of which a scaled component isn't finite any more.
    """
    def whole(x):  # doubles from 2^53 are whole numbers as they are
        y = x.cast("double") * scale
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    scaled = F.transform(F.col(column), whole)
    fine = F.forall(F.col(column), lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < float("inf")))
    return (vectors.where(F.col(column).isNotNull()).where(fine)
            .select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
                    scaled.alias("vector"), F.size(F.col(column)).alias("length")))


def top_k(vectors: DataFrame, is_query: F.Column, top: int = TOP, column: str = "embedding",
          scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` highest integer inner products of each query row.

    Candidates are all rows but the query's own; ties go to the smaller
    vec_id, NULL after all others (as is, in effect, the largest 64-bit id, which is given back as NULL); fewer
    candidates give fewer rows. Vectors of different lengths have no product. A repeated vec_id stands
    for itself in each of its rows. Scores that no 64-bit integer holds count as the nearest one.

    Candidates are dealt into shards of bounded size by a hash of the row, so
    equal vectors are spread; each shard has its own KD-tree. A query is first
    searched in the shard of its own row. The k-th hit found there goes along
    to all other shards, in blocks of queries, and ends their searches early.
    """
    every = stored(integer_vectors(vectors, column, scale), "kd-vectors")
    asked = every.where(is_query)
    n, q = every.count(), asked.count()
    plan = Layout(max(1, -(-n // shard_rows)), max(1, -(-q // block_queries)))
    shard = F.pmod(F.xxhash64("row"), F.lit(plan.shards)).cast("int")
    block = F.pmod(F.xxhash64(F.col("row"), F.lit(1)), F.lit(plan.blocks)).cast("int")
    candidates = every.withColumn("shard", shard)
    queries = asked.withColumn("home", shard).withColumn("block", block)

    def find(left: DataFrame, right: DataFrame) -> DataFrame:
        keys = ["length", "shard", "block"]
        own = ["row", "vec_id", "vector"]
        asking = right.select(*[F.col(c).alias(f"query_{c}") for c in (*keys, *own)], "kth_score", "kth_id")
        return left.select(*keys, *own).groupBy(*keys).cogroup(
            asking.groupBy(*[f"query_{c}" for c in keys])).applyInArrow(
            lambda a, b: _search(a, b, top), "query_row long, query_id long, vec_id long, score long")

    none = F.lit(None).cast("long")
    first = stored(find(candidates.withColumn("block", F.lit(0)),
                        queries.withColumn("shard", F.col("home")).withColumn("block", F.lit(0))
                        .withColumn("kth_score", none).withColumn("kth_id", none)), "kd-home")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    kth = (first.withColumn("at", F.row_number().over(order)).where(F.col("at") == top)
           .select(F.col("query_row").alias("row"), F.col("score").alias("kth_score"), F.col("vec_id").alias("kth_id")))
    hits = first
    if plan.shards > 1:
        elsewhere = F.array_except(F.sequence(F.lit(0), F.lit(plan.shards - 1)), F.array("home"))
        away = queries.join(kth, "row", "left").withColumn("shard", F.explode(elsewhere))
        blocks = F.explode(F.sequence(F.lit(0), F.lit(plan.blocks - 1)))
        hits = first.unionByName(find(candidates.withColumn("block", blocks), away))
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif("vec_id", F.lit(LONG_MAX)).alias("vec_id"), "score"))


def op8_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors of every hundredth vector."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op8_kd_search": op8_kd_search}
ORACLE = {"op8_kd_search": """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id
        WHERE q.vec_id % 100 = 0),
    r AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""}
