"""Clustering for topic building.

* KMeans is Spark ML's distributed k-means|| with a fixed seed.
* Density clustering is re-aimed as grid density clustering: points fall in
  cells of side eps / sqrt(d) (any two points of a cell are within eps); a
  cell whose 3^d neighbourhood holds >= min_pts points is dense (a
  cell-level stand-in for the eps-ball count); dense cells that touch (3^d
  neighbourhood) form one cluster, found by hooking trees of cells and
  doubling the hooks, with a reliable checkpoint per round; points of sparse cells
  next to a dense cell join it as border points; the rest and clusters
  below ``min_cluster_size`` are noise (-1). No point pairs are ever formed,
  so a dense region costs its cell count, not its squared point count.
* Topic merging joins topics that are each other's most similar one (cosine
  of summed vectors), all such pairs at once, until ``n`` remain.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crisismap.session import cut_lineage, maybe_broadcast, stored


def _vectors(df: DataFrame, vec: str):
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))


def kmeans_model(df: DataFrame, k: int, vec: str = "embedding", seed: int = 42, max_iter: int = 20):
    from pyspark.ml.clustering import KMeans

    return KMeans(k=k, seed=seed, featuresCol="_v", maxIter=max_iter).fit(_vectors(df, vec))


def kmeans_labels(model, df: DataFrame, vec: str = "embedding", out: str = "topic_id") -> DataFrame:
    return model.setPredictionCol(out).transform(_vectors(df, vec)).drop("_v").withColumn(out, F.col(out).cast("int"))


def cluster_kmeans(df: DataFrame, k: int, vec: str = "embedding", seed: int = 42, out: str = "topic_id",
                   max_iter: int = 20) -> DataFrame:
    """KMeans with ``k`` clusters and a fixed seed."""
    return kmeans_labels(kmeans_model(df, k, vec, seed, max_iter), df, vec, out)


def _offsets(d: int) -> str:
    combos = itertools.product((-1, 0, 1), repeat=d)
    return "array(" + ", ".join("array(" + ", ".join(f"{x}L" for x in c) + ")" for c in combos) + ")"


def cluster_density(df: DataFrame, key: str, vec: str, eps: float, min_pts: int, min_cluster_size: int,
                    out: str = "topic_id", dims: int | None = None) -> DataFrame:
    """N14 (re-aimed): grid density clustering; noise and small clusters get -1.

    ``dims`` is the vectors' length, if known (else one row is read to learn it).
    """
    first = None if dims else df.select(vec).first()
    if not dims and first is None:
        return df.withColumn(out, F.lit(-1))
    d = dims or len(first[0])
    side = eps / math.sqrt(d)
    pts = df.withColumn("_cell", F.transform(vec, lambda x: F.floor(x.cast("double") / side)))
    cell_n = pts.groupBy("_cell").agg(F.count(F.lit(1)).alias("_own"))
    offs = F.expr(_offsets(d))

    def neighbours(cells: DataFrame) -> DataFrame:
        return cells.select("_cell", F.explode(offs).alias("_o")).select(
            "_cell", F.zip_with("_cell", "_o", lambda a, b: a + b).alias("_nb"))

    # neighbourhood count of every occupied cell (cell-level join, no point pairs)
    counts = (neighbours(cell_n.select("_cell")).join(cell_n.select(F.col("_cell").alias("_nb"), "_own"), "_nb")
              .groupBy("_cell").agg(F.sum("_own").alias("_n")))
    counts = cut_lineage(counts)
    dense = counts.where(F.col("_n") >= min_pts).select("_cell")

    edges = neighbours(dense).join(dense.select(F.col("_cell").alias("_nb")), "_nb").select("_cell", "_nb")
    labels = connected_labels(dense, edges)
    # border points: a sparse cell takes the smallest label among its dense neighbours
    sparse = counts.where(F.col("_n") < min_pts).select("_cell")
    border = (neighbours(sparse).join(labels.select(F.col("_cell").alias("_nb"), "_label"), "_nb")
              .groupBy("_cell").agg(F.min("_label").alias("_label")))
    cell_label = labels.unionByName(border)
    tagged = pts.join(cell_label, "_cell", "left")
    sizes = tagged.where(F.col("_label").isNotNull()).groupBy("_label").agg(F.count(F.lit(1)).alias("_size"))
    keep = sizes.where(F.col("_size") >= min_cluster_size).select("_label")
    # cluster ids 0..c-1 in label order; the component table has one row per cluster
    ids = keep.withColumn(out, (F.dense_rank().over(Window.orderBy("_label")) - 1).cast("int"))
    res = tagged.join(ids, "_label", "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1)))
    return res.drop("_cell", "_label")


def connected_labels(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(_cell, _label): the smallest cell that each cell is connected with, by edges (_cell, _nb).

    In a round every tree of cells hooks onto the smallest neighbouring tree,
    and the hooks are then followed to their ends by doubling, so at least half
    of all trees that still have a neighbour vanish. Rounds end when nothing hooks,
    logarithmically many however long a chain of cells is.
    """
    labels = cells.select("_cell", F.col("_cell").alias("_label"))
    while True:
        mine = labels.select("_cell", F.col("_label").alias("_root"))
        theirs = labels.select(F.col("_cell").alias("_nb"), F.col("_label").alias("_up"))
        hooks = stored(edges.join(mine, "_cell").join(theirs, "_nb").where(F.col("_up") < F.col("_root"))
                            .groupBy("_root").agg(F.min("_up").alias("_up")), "components")
        if hooks.isEmpty():
            return labels
        while True:
            further = hooks.select(F.col("_root").alias("_up"), F.col("_up").alias("_end"))
            longer = stored(hooks.join(further, "_up", "left").select("_root", "_up", "_end"), "components")
            if longer.where(F.col("_end").isNotNull()).isEmpty():
                break
            hooks = longer.select("_root", F.coalesce("_end", "_up").alias("_up"))
        labels = stored(labels.join(hooks.withColumnRenamed("_root", "_label"), "_label", "left")
                             .select("_cell", F.coalesce("_up", "_label").alias("_label")), "components")


def topic_vectors(df: DataFrame, vec: str = "embedding", label: str = "topic_id") -> DataFrame:
    """Size and summed vector per topic (noise excluded)."""
    dims = df.where(F.col(label) >= 0).select(label, F.posexplode(vec).alias("_d", "_x"))
    sums = dims.groupBy(label, "_d").agg(F.sum(F.col("_x").cast("double")).alias("_x"))
    vecs = sums.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("_d", "_x"))).alias("_s"))
    size = df.where(F.col(label) >= 0).groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    return vecs.select(label, F.expr("transform(_s, e -> e._x)").alias("vec")).join(size, label)


def relabelled(df: DataFrame, mapping: DataFrame, label: str = "topic_id") -> DataFrame:
    """Topics renamed by ``mapping`` (old, new), -1 where it has none. Rows stay where they are if the mapping is small."""
    new = maybe_broadcast(mapping.select(F.col("old").alias(label), F.col("new").alias("_new")))[0]
    return df.join(new, label, "left").withColumn(label, F.coalesce("_new", F.lit(-1)).cast("int")).drop("_new")


def reduce_topics(df: DataFrame, n: int, vec: str = "embedding", label: str = "topic_id") -> tuple[DataFrame, DataFrame]:
    """N18 (re-aimed): merge topics that are each other's most similar one until ``n`` remain.

    Returns ``(relabelled rows, mapping old -> new)``. A round merges all mutual
    nearest pairs, the most similar first if fewer are needed, so rounds are few
    even for many topics; one such pair always exists, as ties are broken alike
    from both sides. Summed vectors stay in tables; the driver sees counts only.
    Topic ids are renumbered 0..n-1 by size (largest first) at the end.
    """
    mapping = reduced(topic_vectors(df, vec, label), n, label)
    return relabelled(df, mapping, label), mapping


def reduced(vectors: DataFrame, n: int, label: str = "topic_id") -> DataFrame:
    """The mapping (old, new) of ``reduce_topics``, from ``topic_vectors``."""
    from crisismap.operators.similarity import cosine

    tv = cut_lineage(vectors)
    mapping = tv.select(F.col(label).alias("old"), F.col(label).alias("new"))
    while (left := tv.count()) > max(n, 1):
        one = tv.select(F.col(label).alias("_a"), F.col("vec").alias("_va"))
        two = tv.select(F.col(label).alias("_b"), F.col("vec").alias("_vb"))
        sims = one.crossJoin(two).where("_a <> _b").withColumn("_sim", F.coalesce(cosine("_va", "_vb"), F.lit(-1.0)))
        rank = F.struct("_sim", -F.least("_a", "_b"), -F.greatest("_a", "_b"))
        near = sims.groupBy("_a").agg(F.max_by("_b", rank).alias("_b"), F.max("_sim").alias("_sim"))
        back = near.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))
        merges = cut_lineage(near.join(back, ["_a", "_b"]).where("_a < _b").orderBy(F.desc("_sim"), "_a").limit(left - n)
                             .select(F.col("_b").alias("_loser"), F.col("_a").alias("_into")))
        moved = tv.join(merges, F.col(label) == F.col("_loser"), "left").select(
            F.coalesce("_into", label).alias(label), "vec", "size")
        both = moved.groupBy(label).agg(F.collect_list("vec").alias("_v"), F.sum("size").alias("size"))
        zero = F.transform(F.get("_v", F.lit(0)), lambda x: x * 0)
        tv = cut_lineage(both.select(label, F.aggregate("_v", zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y)).alias("vec"),
                                     "size"))
        mapping = cut_lineage(mapping.join(merges, F.col("new") == F.col("_loser"), "left")
                              .select("old", F.coalesce("_into", "new").alias("new")))
    order = tv.select(label, (F.row_number().over(Window.orderBy(F.desc("size"), label)) - 1).alias("_rank"))
    mapping = mapping.join(order.withColumnRenamed(label, "new"), "new").select("old", F.col("_rank").alias("new"))
    return stored(mapping, "topic-map")


def merge_alike(df: DataFrame, vec: str = "embedding", label: str = "topic_id") -> DataFrame:
    """N18, 'auto': topics whose mean vectors (at length 1) lie in one dense group of two or more become one topic.

    Groups come from hierarchical density clustering of the topics with a least size of 2; a topic
    outside of all groups stays. Topics are numbered anew by size, the largest first.
    """
    return relabelled(df, alike(topic_vectors(df, vec, label), label), label)


def alike(topics: DataFrame, label: str = "topic_id") -> DataFrame:
    """The mapping (old, new) of ``merge_alike``, from ``topic_vectors``."""
    from crisismap.operators.density import cluster_hdbscan

    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    unit = topics.withColumn("_n", length).withColumn("_u", F.transform("vec", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(0.0)))
    grouped = stored(cluster_hdbscan(unit.select(F.col(label).alias("_t"), "size", "_u"), "_t", "_u", 2, out="_group"), "topic-groups")
    first = Window.partitionBy("_group").orderBy(F.desc("size"), "_t")
    into = F.when(F.col("_group") >= 0, F.first("_t").over(first)).otherwise(F.col("_t"))
    merged = grouped.withColumn("_into", into)
    order = merged.groupBy("_into").agg(F.sum("size").alias("_s")).select(
        "_into", (F.row_number().over(Window.orderBy(F.desc("_s"), "_into")) - 1).cast("int").alias("_new"))
    return stored(merged.select("_t", "_into").join(order, "_into").select(F.col("_t").alias("old"), F.col("_new").alias("new")), "topic-map")
