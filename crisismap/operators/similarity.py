"""Vector similarity operators.

Query vectors are gathered into blocks, arrays of bounded length with their norms beside them. Each text
row is scored against a whole block with higher-order functions, and only the hits above the
threshold are exploded. The blocks are broadcast if their bytes are counted and small; beyond that
texts meet blocks by a join on block and salt, so a task holds one block at a time. Exact in both cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crisismap.session import bounded_rows, maybe_broadcast

MAX_QUERIES_PER_BLOCK = 4096
# Of one block, so many parts of the texts are scored side by side where blocks aren't broadcast.
SALTS_A_BLOCK = 64


def dot_expr(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, v) -> s + v)"


def norm_expr(a: str) -> str:
    return f"sqrt(aggregate({a}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"


def cosine(a: str, b: str) -> Column:
    """M4: cosine similarity in double precision; a zero vector gives 0."""
    den = f"({norm_expr(a)} * {norm_expr(b)})"
    return F.expr(f"CASE WHEN {den} = 0 THEN 0D ELSE {dot_expr(a, b)} / {den} END")


def _query_blocks(queries: DataFrame, qkey: str, qvec: str) -> tuple[DataFrame, int]:
    """Query vectors and norms gathered into arrays of about MAX_QUERIES_PER_BLOCK (one row per block), and how many."""
    q = queries.select(F.col(qkey).alias("qid"), F.col(qvec).alias("qv"), F.expr(norm_expr(f"`{qvec}`")).alias("qn"))
    blocks = 1 if bounded_rows(q, MAX_QUERIES_PER_BLOCK) else -(-q.count() // MAX_QUERIES_PER_BLOCK)
    q = q.withColumn("_blk", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int") if blocks > 1 else F.lit(0))
    return q.groupBy("_blk").agg(F.collect_list(F.struct("qid", "qv", "qn")).alias("_qs")), blocks


def _with_blocks(texts: DataFrame, queries: DataFrame, key: str, vec: str, qkey: str, qvec: str) -> DataFrame:
    """``(key, _tv, _tn, _qs)``: every text with every block of queries."""
    t = texts.select(F.col(key), F.col(vec).alias("_tv")).withColumn("_tn", F.expr(norm_expr("_tv")))
    gathered, blocks = _query_blocks(queries, qkey, qvec)
    small, proven = maybe_broadcast(gathered)
    if proven:
        return t.crossJoin(small.select("_qs"))
    numbers = F.sequence(F.lit(0), F.lit(blocks - 1))
    salted = t.withColumn("_blk", F.explode(numbers)).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS_A_BLOCK)))
    spread = gathered.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS_A_BLOCK - 1).cast("long"))))
    return salted.join(spread, ["_blk", "_salt"]).drop("_blk", "_salt")


SIM = (f"CASE WHEN _tn * q.qn = 0 THEN 0D ELSE {dot_expr('_tv', 'q.qv')} / (_tn * q.qn) END")


def similarities(texts: DataFrame, queries: DataFrame, key: str, vec: str, qkey: str = "query_id",
                 qvec: str = "embedding", threshold: float = 0.7) -> DataFrame:
    """``(key, qid, sim)`` for every text x query with sim > threshold."""
    scored = _with_blocks(texts, queries, key, vec, qkey, qvec).select(key, F.expr(
        f"filter(transform(_qs, q -> named_struct('qid', q.qid, 'sim', {SIM})), s -> s.sim > {float(threshold)!r}D)").alias("_s"))
    return scored.select(key, F.explode("_s").alias("_x")).select(key, F.col("_x.qid").alias("qid"),
                                                                   F.col("_x.sim").alias("sim"))


def best_match(texts: DataFrame, queries: DataFrame, key: str, vec: str, qkey: str = "query_id",
               qvec: str = "embedding", threshold: float = 0.7) -> DataFrame:
    """Argmax query per text (first query id wins ties); -1 when the best is <= threshold."""
    scored = _with_blocks(texts, queries, key, vec, qkey, qvec).select(key, F.expr(
        f"array_max(transform(_qs, q -> named_struct('sim', {SIM}, 'neg', -q.qid, 'qid', q.qid)))").alias("_b"))
    # several blocks: combine per text (max over structs keeps the same tie rule)
    best = scored.groupBy(key).agg(F.max("_b").alias("_b"))
    return best.select(key, F.col("_b.sim").alias("best_sim"),
                       F.when(F.col("_b.sim") > F.lit(threshold), F.col("_b.qid")).otherwise(F.lit(-1))
                       .alias("prediction"))


def retrieve(texts: DataFrame, queries: DataFrame, key: str, vec: str, qkey: str = "query_id",
             qvec: str = "embedding", threshold: float = 0.7, n: int = 10) -> DataFrame:
    """N22 + W2: per query, the first ``n`` texts in text order with cosine > threshold.

    Queries without a hit keep an empty list. ``row_number() <= n`` is planned
    with a partial window-group limit, so a query matching a third of all
    texts ships at most n rows per task to its final partition.
    """
    hits = similarities(texts, queries, key, vec, qkey, qvec, threshold)
    w = Window.partitionBy("qid").orderBy(key)
    first = hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    lists = first.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(key, "sim"))).alias("_l"))
    allq = queries.select(F.col(qkey).alias("qid"))
    out = allq.join(lists, "qid", "left")
    return out.select(F.col("qid").alias(qkey),
                      F.coalesce(F.expr(f"transform(_l, x -> x.{key})"), F.expr("array()").cast(
                          f"array<{texts.schema[key].dataType.simpleString()}>")).alias("samples"))


def lookup_reduced(embs: DataFrame, reduced: DataFrame, vec: str = "embedding", out: str = "reduced",
                   seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Exact-vector lookup of a precomputed reduced vector (later duplicates win).

    Returns ``(joined, missing)``; the reference raised on a missing key, here
    the unmatched rows come back as a second table to check or raise on.
    """
    dedup = reduced.groupBy(vec).agg(F.max_by(out, seq).alias(out))
    joined = embs.join(dedup, vec, "left")
    return joined.where(F.col(out).isNotNull()), joined.where(F.col(out).isNull()).drop(out)
