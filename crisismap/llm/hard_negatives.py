"""Operator 13: hard negatives for contrastive training, from candidate lists that clusters of anchors share.

Anchors are clustered by direction. For a cluster with centre c and widest angle w to a member, no member u has
a larger product with a candidate v than |u| |v| cos(max(0, angle(c, v) - w)). The candidates of a shard are sorted by
that bound once for all members of a cluster, each of which walks down the list until it is certain of its result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crisismap.llm.common import stored, table
from crisismap.llm.exact import products

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LEAST_PERCENT = 80  # a negative scores at least this share of its positive
# Anchors that the clusters' centres are fitted on, and centres: both bounded at any size of the table.
SAMPLE_ANCHORS = 16_384
MAX_CENTRES = 256
ANCHORS_PER_CENTRE = 256  # or more: the candidates cross the shuffle once for each block of anchors
ROUNDS = 8
# Components that a block of anchors and a shard of candidates hold, or thereabouts (4,096 and 32,768 vectors of 64).
BLOCK_COMPONENTS = 1 << 18
SHARD_COMPONENTS = 1 << 21
CHUNK = 512  # candidates that members of a cluster look at together
# Angles are rounded; bounds are widened by more than their error.
ANGLE_SLACK, SHARE_SLACK = 1e-6, 1e-9
NO_ID = (1 << 63) - 1  # place of a NULL vec_id among ids (after all others)
LOWEST = -(1 << 63)


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths without overflow on the way."""
    most = np.abs(vectors).max(axis=1, initial=0.0)
    with np.errstate(over="ignore"):
        return most * np.sqrt(((vectors / np.where(most, most, 1.0)[:, None]) ** 2).sum(axis=1))


def directions(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; a zero vector stays zero."""
    most = np.abs(vectors).max(axis=1, initial=0.0)
    small = vectors / np.where(most, most, 1.0)[:, None]
    size = np.sqrt((small ** 2).sum(axis=1))
    return small / np.where(size, size, 1.0)[:, None]


def angles(units: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Angle of each unit vector to the centre; a right angle for zero vectors (their products are 0 anyway)."""
    return np.arccos(np.clip(units @ centre, -1.0, 1.0))


def centre_of(units: np.ndarray) -> np.ndarray:
    total = units.sum(axis=0)
    size = np.sqrt((total ** 2).sum())
    return total / size if size > 1e-9 else units[np.abs(units).any(axis=1).argmax()]


def bound(length_u, length_v, apart, wide):
    """Upper bound of the products of vectors with these lengths, ``apart`` in angle but for ``wide``."""
    with np.errstate(over="ignore", invalid="ignore"):
        share = np.cos(np.clip(apart - wide - ANGLE_SLACK, 0.0, np.pi))
        found = length_u * length_v * (share + SHARE_SLACK)
    return np.where(np.isnan(found), np.inf, found)


@dataclass
class SharedList:
    """Candidates of a shard in the order of their bound for one cluster of anchors."""

    vectors: np.ndarray
    places: np.ndarray  # rank of (vec_id, row): ties go to the smaller
    labels: np.ndarray
    rows: np.ndarray
    reach: np.ndarray  # bound of each candidate for a member of length 1, descending

    @classmethod
    def sort(cls, anchors: np.ndarray, shard: dict[str, np.ndarray]) -> SharedList:
        units = directions(anchors)
        centre = centre_of(units)
        wide = float(angles(units, centre).max())
        reach = bound(1.0, lengths(shard["vector"]), angles(directions(shard["vector"]), centre), wide)
        order = np.argsort(-reach, kind="stable")
        return cls(shard["vector"][order], shard["place"][order], shard["label"][order], shard["row"][order], reach[order])


def walk(members: dict[str, np.ndarray], anchor_of: np.ndarray, shared: SharedList, top: int, least: np.ndarray,
         most: np.ndarray | None) -> Iterator[tuple[int, int, int]]:
    """(member, candidate of the list, score) of each member's ``top`` best candidates, or more of them in ties.

    A member is an anchor (``anchor_of`` gives its number) with a window of scores from ``least`` to ``most``;
    without ``most`` candidates have the anchor's label, otherwise another one.
    All members look at the list in chunks from its top. One ends when the bound of
    the next chunk is below its worst kept score, or below its window: nothing further down can count.
    """
    size = lengths(members["vector"])
    floor = least.astype(np.int64).copy()  # scores below don't count any more
    kept: list[list[tuple[int, int, int]]] = [[] for _ in anchor_of]  # (score, -place, candidate)
    active = np.arange(len(anchor_of))
    for start in range(0, len(shared.rows), CHUNK):
        reach = shared.reach[start]
        with np.errstate(over="ignore", invalid="ignore"):
            most_left = np.maximum(size[anchor_of[active]] * reach, LOWEST)  # scores end there
        active = active[~(most_left + 1.0 + SHARE_SLACK * np.abs(most_left) < floor[active])]
        if not active.size:
            break
        part = slice(start, start + CHUNK)
        asked, back = np.unique(anchor_of[active], return_inverse=True)
        scores = products(members["vector"][asked], shared.vectors[part])
        equal = members["label"][asked][:, None] == shared.labels[None, part]
        fits = (equal & (members["row"][asked][:, None] != shared.rows[None, part]) if most is None else ~equal)[back]
        scores = scores[back]
        fits &= scores >= floor[active][:, None]
        if most is not None:
            fits &= scores <= most[active][:, None]
        for i in np.flatnonzero(fits.any(axis=1)):
            at, member = np.flatnonzero(fits[i]), active[i]
            if len(at) > top:  # only the best of the chunk can stay
                at = at[np.lexsort((shared.places[start + at], -scores[i, at]))[:top]]
            best = kept[member] + [(int(scores[i, j]), -int(shared.places[start + j]), start + int(j)) for j in at]
            best.sort(reverse=True)
            kept[member] = best[:top]
            if len(kept[member]) == top:
                floor[member] = max(floor[member], kept[member][-1][0])
    for member, best in enumerate(kept):
        for score, _, at in best:
            yield member, at, score


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _arrays(rows: pa.Table, prefix: str = "") -> dict[str, np.ndarray]:
    """Columns as arrays; ``place`` orders a table's rows by (vec_id, row), NULL ids last."""
    found = {c: rows[prefix + c].to_numpy() for c in ("row", "label")}
    found["vector"] = _matrix(rows[f"{prefix}vector"], rows.num_rows)
    ids = rows[f"{prefix}vec_id"].combine_chunks()
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    found["place"] = np.empty(rows.num_rows, np.int64)
    found["place"][np.lexsort((found["row"], ids.fill_null(NO_ID).to_numpy(), missing))] = np.arange(rows.num_rows)
    return found


FOUND = "anchor_row long, anchor_id long, positive long, row long, vec_id long, score long"
FOUND_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in FOUND.split(", ")])


def _mine(shard: pa.Table, asking: pa.Table, top: int) -> pa.Table:
    """Hits of one block of anchors in one shard. Each row of ``asking`` is a member, of which several may share an anchor."""
    out: list[tuple] = []
    if shard.num_rows and asking.num_rows:
        candidates, members = _arrays(shard), _arrays(asking, "ask_")
        unique, first, anchor_of = np.unique(members["row"], return_index=True, return_inverse=True)
        anchors = {c: members[c][first] for c in ("row", "label", "vector")}
        least, most = (asking[c].to_numpy(zero_copy_only=False) for c in ("ask_least", "ask_most"))
        windows = asking["ask_positive"].null_count == 0
        shared = SharedList.sort(anchors["vector"], candidates)
        names, positives = asking["ask_vec_id"].to_pylist(), asking["ask_positive"].to_pylist()
        ids = shard["vec_id"].to_pylist()
        by_row = {int(r): i for i, r in enumerate(candidates["row"])}
        for member, at, score in walk(anchors, anchor_of, shared, top, least, most if windows else None):
            row = int(shared.rows[at])
            out.append((int(members["row"][member]), names[member], positives[member], row, ids[by_row[row]], score))
    columns = list(zip(*out, strict=True)) if out else [[]] * len(FOUND_ARROW)
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=FOUND_ARROW)


def whole_vectors(vectors: DataFrame, column: str = "embedding", scale: int = SCALE, shift_every: int = 7,
                  labels: int = 10) -> DataFrame:
    """row, vec_id, label, vector (whole numbers in doubles), dims of every row that takes part.

    Rows with a NULL label, a NULL vector, or a NULL or non-finite component take
    no part, nor those of which a scaled component isn't finite any more. A row without an id does, as
    the last among ties. Where ``shift_every`` divides the id, the label moves on by one.
    """
    fine = F.forall(F.col(column), lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < float("inf")))
    shifted = F.when(F.col("vec_id") % shift_every == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(labels))).otherwise(
        F.col("label").cast("long"))
    whole = vectors.where(F.col("label").isNotNull() & F.col(column).isNotNull()).where(fine).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), shifted.alias("label"),
        F.transform(F.col(column), lambda x: x.cast("double") * scale).alias("vector"), F.size(column).alias("dims"))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            flat = pa.array(np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(float)))
            offsets = pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py())
            yield batch.set_column(3, "vector", pa.ListArray.from_arrays(offsets, flat))

    return whole.mapInArrow(floors, "row long, vec_id long, label long, vector array<double>, dims int")


def fit_centres(anchors: DataFrame, total: int, sample: int = SAMPLE_ANCHORS, most: int = MAX_CENTRES) -> dict[int, np.ndarray]:
    """Centres (unit vectors) by vector length, by spherical k-means on a sample by hash of at most about ``sample`` anchors.

    They only say which rows are dealt together: results are the same with any others.
    """
    share = min(1.0, sample / max(total, 1))
    picked = anchors.where(F.pmod(F.xxhash64("row", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * sample)
    by_dims: dict[int, list] = {}
    for row in picked.select("dims", "vector").toLocalIterator():
        by_dims.setdefault(row["dims"], []).append(row["vector"])
    centres = {}
    for dims, rows in by_dims.items():
        if dims:
            units = directions(np.array(rows, float))
            k = max(1, min(most, len(units), total // ANCHORS_PER_CENTRE))
            found = units[np.linspace(0, len(units) - 1, k).astype(int)].copy()
            for _ in range(ROUNDS):
                near = (units @ found.T).argmax(axis=1)
                for j in np.unique(near):
                    found[j] = centre_of(units[near == j])
            centres[dims] = found
    return centres


def dealt(rows: DataFrame, centres: dict[int, np.ndarray], components: int, label: str) -> DataFrame:
    """``rows`` with their cluster and ``piece``: parts of a cluster of about so many components, by hash."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            cluster = np.zeros(batch.num_rows, np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d in centres:
                    vectors = _matrix(pa.chunked_array([batch.column("vector").take(pa.array(at))]), len(at))
                    cluster[at] = (directions(vectors) @ centres[d].T).argmax(axis=1)
            yield batch.append_column("cluster", pa.array(cluster))

    near = stored(rows.mapInArrow(nearest, "row long, vec_id long, label long, vector array<double>, dims int, cluster int"), label)
    counts = near.groupBy("dims", "cluster").agg(F.ceil(F.count("*") * F.col("dims") / components).cast("int").alias("pieces"))
    return near.join(counts, ["dims", "cluster"]).withColumn(
        "piece", F.pmod(F.xxhash64("row", F.lit(5)), F.greatest("pieces", F.lit(1))).cast("int")).drop("pieces")


CONE = "dims int, cluster int, piece int, centre array<double>, wide double, longest double, shortest double"


def cones(rows: DataFrame) -> DataFrame:
    """One row for each part of a cluster: its centre, widest angle to it, longest and shortest vector."""

    def cone(group: pa.Table) -> pa.Table:
        vectors = _matrix(group["vector"], group.num_rows)
        units, size = directions(vectors), lengths(vectors)
        centre = centre_of(units) if vectors.shape[1] else np.zeros(0)
        wide = float(angles(units, centre).max()) if vectors.shape[1] else 0.0
        return pa.table({"dims": group["dims"][:1], "cluster": group["cluster"][:1], "piece": group["piece"][:1],
                         "centre": pa.array([centre], pa.list_(pa.float64())), "wide": [wide],
                         "longest": [float(size.max())], "shortest": [float(size.min())]})

    return rows.groupBy("dims", "cluster", "piece").applyInArrow(cone, CONE)


PART = ("dims", "cluster", "piece")


def reaches(blocks: DataFrame, shards: DataFrame) -> DataFrame:
    """Pairs of a block and a shard with ``reach``: no member of length 1 has a larger product with any candidate in it.

    The tables have a row for each part, i.e. one for thousands of vectors.
    """
    one = blocks.select("dims", *[F.col(c).alias(f"b_{c}") for c in ("cluster", "piece", "centre", "wide")])
    two = shards.select("dims", *[F.col(c).alias(f"s_{c}") for c in ("cluster", "piece", "centre", "wide", "longest", "shortest")])
    dot = F.aggregate(F.zip_with("b_centre", "s_centre", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) - F.col("b_wide") - F.col("s_wide") - 3 * ANGLE_SLACK
    share = F.cos(F.greatest(F.lit(0.0), apart)) + SHARE_SLACK
    reach = F.when(share >= 0, F.col("s_longest")).otherwise(F.col("s_shortest")) * share
    return one.join(two, "dims").select("dims", "b_cluster", "b_piece", "s_cluster", "s_piece",
                                        F.when(F.isnan(reach), float("inf")).otherwise(reach).alias("reach"))


def _find(shards: DataFrame, blocks: DataFrame, pairs: DataFrame, top: int) -> DataFrame:
    """Hits of the members of ``blocks`` (ask_... columns) in the shards that ``pairs`` names for their block."""
    ask = ["row", "vec_id", "label", "vector", "least", "most", "positive"]
    given = pairs.select("dims", "b_cluster", "b_piece", "s_cluster", "s_piece")
    keys = ["dims", "b_cluster", "b_piece", "s_cluster", "s_piece"]
    theirs = shards.select("dims", F.col("cluster").alias("s_cluster"), F.col("piece").alias("s_piece"), "row", "vec_id", "label",
                           "vector").join(given, ["dims", "s_cluster", "s_piece"]).select(*keys, "row", "vec_id", "label", "vector")
    mine = blocks.select("dims", F.col("cluster").alias("b_cluster"), F.col("piece").alias("b_piece"), *ask).join(
        given, ["dims", "b_cluster", "b_piece"]).select(*[F.col(c).alias(f"ask_{c}") for c in (*keys, *ask)])
    return theirs.groupBy(*keys).cogroup(mine.groupBy(*[f"ask_{c}" for c in keys])).applyInArrow(
        lambda a, b: _mine(a, b, top), FOUND)


def _best(hits: DataFrame, top: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _open_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs whose shard can hold something for some member of the block, by its length and lowest useful score."""
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    need = members.groupBy("dims", F.col("cluster").alias("b_cluster"), F.col("piece").alias("b_piece")).agg(
        F.min("least").cast("double").alias("least"), F.max(size).alias("longest"), F.min(size).alias("shortest"))
    # a bound below zero is least strict for the shortest member
    size = F.when(F.col("reach") >= 0, F.col("longest")).otherwise(F.col("shortest"))
    most = F.greatest(F.col("reach") * size, F.lit(float(LOWEST)))
    return pairs.join(need, ["dims", "b_cluster", "b_piece"]).where(
        F.isnan(most) | (most + 1.0 + SHARE_SLACK * F.abs(most) >= F.col("least"))).drop("least", "longest", "shortest")


def hard_negatives(vectors: DataFrame, is_anchor: Column, column: str = "embedding", scale: int = SCALE,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = LEAST_PERCENT,
                   block_components: int = BLOCK_COMPONENTS, shard_components: int = SHARD_COMPONENTS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: whole and exact.

    An anchor's positives are the ``positives`` best other rows of its label; for each of them the ``negatives``
    best rows of another label with a score of ``percent`` to 100 % of the positive's are returned, ties
    to the smaller vec_id, then (repeated rows, each of which stands for itself) to the earlier row. Vectors of
    different lengths have no product, empty ones the product 0. Scores that no 64-bit integer holds count as
    the nearest one. An empty table, one without anchors or a label of its own gives no rows.

    Rows are dealt into blocks of anchors and shards of candidates by cluster, both of bounded size. Anchors
    first walk the shards of their own cluster; the worst positive found there closes most other pairs of block and
    shard by the bound of whole cones, and ends the walks in the others early.
    """
    every = stored(whole_vectors(vectors, column, scale), "hard-vectors")
    anchors = every.where(is_anchor)
    centres = fit_centres(anchors, anchors.count())
    shards = dealt(every, centres, shard_components, "hard-shards")
    blocks = dealt(anchors, centres, block_components, "hard-blocks")
    pairs = stored(reaches(cones(blocks), cones(shards)), "hard-pairs")
    none, lowest = F.lit(None).cast("long"), F.lit(LOWEST).cast("long")
    home = F.col("b_cluster") == F.col("s_cluster")

    first = blocks.withColumn("least", lowest).withColumn("most", none).withColumn("positive", none)
    near = stored(_find(shards, first, pairs.where(home), positives), "hard-home")
    known = _best(near, positives, "anchor_row").where(F.col("rank") == positives).select(F.col("anchor_row").alias("row"),
                                                                                          F.col("score").alias("known"))
    second = stored(first.join(known, "row", "left").withColumn("least", F.coalesce("known", "least")).drop("known"), "hard-asking")
    far = _find(shards, second, _open_pairs(pairs.where(~home), second), positives)
    chosen = stored(_best(near.unionByName(far), positives, "anchor_row").select(
        F.col("anchor_row").alias("of"), F.col("rank").cast("long").alias("positive"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score")), "hard-positives")

    # percent * p <= 100 * n for whole n: n is at least the next whole number up, in decimals, which can't overflow
    least = F.ceil(F.col("positive_score").cast("decimal(22,0)") * percent / 100).cast("decimal(22,0)")
    window = blocks.join(chosen.withColumnRenamed("of", "row"), "row").withColumn("most", F.col("positive_score")).withColumn(
        "least", F.greatest(least, lowest.cast("decimal(22,0)")).cast("long")).where("least <= most").drop("positive_id", "positive_score")
    window = stored(window, "hard-windows")
    hits = _find(shards, window, _open_pairs(pairs, window), negatives)
    best = _best(hits, negatives, "anchor_row", "positive")
    return best.join(chosen, (F.col("anchor_row") == F.col("of")) & (best["positive"] == chosen["positive"])).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of the five positives of every hundredth vector."""
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLE = {"op13_hard_negatives": """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE embedding IS NOT NULL AND label IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id,
               CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v a JOIN v c ON a.vec_id <> c.vec_id
        WHERE a.vec_id % 100 = 0),
    p AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score
        FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (
        SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
        WHERE 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""}
