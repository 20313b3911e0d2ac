"""Connected components of an edge table, in rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crisismap.llm.common import stored


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Of pairs u > v: connect every larger neighbour of a node with the node's smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Of pairs u > v: connect a node and its smaller neighbours with the smallest of these."""
    near = _least(edges)
    moved = edges.join(near, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node with an edge and root < node; the root is its component's smallest node.

    ``edges`` has columns u and v of one orderable type, in any direction.
    Rounds run until the stars no longer change (logarithmically many), with
    no cap. Each round groups with map-side minima and joins on the node, and
    its result is written to the shared folder, so a hub with very many
    neighbours is pre-aggregated and its join can be split by the engine.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or not mark["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        now = stored(_small_star(_large_star(now)), "edges")
