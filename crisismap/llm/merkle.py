"""Operator 12: Merkle manifest of a dataset, its proofs climbed by a recursive query.

Leaves of one source make a tree, the subroots of all sources another one above them. Built levels are stored
as node rows that link to their parent; a recursive query ascends from every run of leaves.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crisismap.llm.common import shared_path, stored, table

FAN = 16
TAMPER_EVERY = 5
# Runs of leaves that one copy of a node serves: a node above more of them is there in several copies.
RUNS_PER_COPY = 1024
TOP = -1  # tree number of the tree above the sources
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(value: Column) -> Column:
    """``-`` for NULL, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(columns: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*[framed(c) for c in columns]), 256)


def leaves(docs: DataFrame, tamper_every: int = TAMPER_EVERY) -> DataFrame:
    """doc_id, source, leaf, tampered: the leaf hash, and the other one of a tampered row (else NULL)."""
    fields = [F.col(c) for c in FIELDS]
    lower = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % tamper_every == 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       leaf_hash(fields).alias("leaf"), F.when(hit, leaf_hash([*fields[:-1], lower])).alias("tampered"))


def placed(rows: DataFrame, group: str, order: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Stored ``rows`` in ranges of equal load, and what the ranges hold of each group.

    The rows, sorted by group and order (NULLs first, ties by row number, so
    that equal rows may be parted), have their range ``part`` and number ``at``; a
    row's place in its group is ``at - first + before`` of the second table,
    which has one row for each range and group, with the group's ``size``. No task
    gets more rows for a large group, and only counts are added up in windows.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "tie")]
    dealt = stored(rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys)
                   .sortWithinPartitions(*keys).drop("tie").withColumn("part", F.spark_partition_id())
                   .withColumn("at", F.monotonically_increasing_id()), label)
    counts = dealt.groupBy("part", group).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return dealt, counts.select("part", group, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
                                F.sum("n").over(whole).alias("size"))


def numbered_leaves(rows: DataFrame) -> DataFrame:
    """doc_id, leaf, tampered, pos, size, tree: a leaf's place in its source, the source's size and its own place."""
    dealt, starts = placed(rows, "source", ["doc_id", "leaf"], "merkle-leaves")
    starts = stored(starts, "merkle-starts")
    sources, ranges = placed(starts.where("before = 0").select("source", F.lit(0).alias("all")), "all", ["source"], "merkle-sources")
    trees = sources.join(ranges, ["part", "all"]).select(F.col("source").alias("named"),
                                                         (F.col("at") - F.col("first") + F.col("before")).alias("tree"))
    starts = starts.join(trees, F.col("source").eqNullSafe(F.col("named"))).select(
        F.col("part").alias("of"), F.col("source").alias("whose"), "first", "before", "size", "tree")
    return stored(dealt.join(starts, (F.col("part") == F.col("of")) & F.col("source").eqNullSafe(F.col("whose"))).select(
        "doc_id", "leaf", "tampered", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "size", "tree"), "merkle-bottom")


def height(size: Column) -> Column:
    """Level of the node that remains of a tree of so many leaves."""
    level = F.lit(0)
    for k in range(16):
        level += (size > FAN ** k).cast("int")
    return level


def build_levels(bottom: DataFrame, largest: int, label: str) -> list[DataFrame]:
    """Levels above ``bottom`` (tree, pos, hash, size, leaves), each stored; no tree has more than ``largest`` nodes.

    Runs of ``FAN`` nodes become one, which keeps its children's hashes; a tree
    of which one node is left goes no further. Logarithmically many rounds.
    """
    levels, nodes, width = [], bottom, largest
    while width > 1:
        width = -(-width // FAN)
        runs = nodes.where(height(F.col("size")) > len(levels)).groupBy(
            "tree", "size", F.floor(F.col("pos") / FAN).cast("long").alias("pos")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("kids"), F.sum("leaves").alias("leaves"))
        nodes = stored(runs.select("tree", F.lit(len(levels) + 1).alias("level"), "pos", "size", "leaves", F.col("kids.hash").alias("kids"))
                       .withColumn("hash", F.sha2(F.concat_ws("", "kids"), 256)), f"{label}-{len(levels) + 1}")
        levels.append(nodes)
    return levels


def subroots(bottom: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """tree, hash, leaves of the one node that remains of each tree."""
    tops = bottom.where("size = 1").select("tree", "hash", "leaves")
    for level in levels:
        tops = tops.unionByName(level.where(F.col("level") == height(F.col("size"))).select("tree", "hash", "leaves"))
    return tops


def way_up(tree: Column, level: Column, pos: Column, size: Column, many: bool) -> dict[str, Column]:
    """Link of a node to its parent (up_tree, up_level, up_pos) and its slot there; NULL for the root.

    A source's subroot is a leaf of the tree above the sources (``many``: there are several).
    """
    inner, sub = level < height(size), (tree != TOP) & F.lit(many)
    up = {"up_tree": (tree, F.lit(TOP)), "up_level": (level + 1, F.lit(1)), "up_pos": (F.floor(pos / FAN), F.floor(tree / FAN)),
          "slot": (pos % FAN, tree % FAN)}
    kinds = {"up_tree": "long", "up_level": "int", "up_pos": "long", "slot": "int"}
    return {name: F.when(inner, own.cast(kinds[name])).when(sub, above.cast(kinds[name])) for name, (own, above) in up.items()}


CLIMB = """
WITH RECURSIVE climb(run, spread, up_tree, up_level, up_pos, slot, folded, subroot, proof) AS (
    SELECT run, spread, up_tree, up_level, up_pos, slot, folded, subroot, '' FROM {start}
    UNION ALL
    SELECT c.run, c.spread, n.up_tree, n.up_level, n.up_pos, n.slot,
           transform(c.folded, h -> sha2(concat(array_join(slice(n.kids, 1, c.slot), ''), h,
                                                array_join(slice(n.kids, c.slot + 2, {fan}), '')), 256)),
           coalesce(c.subroot, CASE WHEN n.tree <> {top} AND n.level = n.height THEN n.hash END),
           concat(c.proof, array_join(slice(n.kids, 1, c.slot), ''), array_join(slice(n.kids, c.slot + 2, {fan}), ''))
    FROM climb c JOIN {nodes} n
      ON c.up_tree = n.tree AND c.up_level = n.level AND c.up_pos = n.pos AND c.spread % n.copies = n.copy)
SELECT run, folded, subroot, proof FROM climb WHERE up_tree IS NULL"""


def climb(start: DataFrame, nodes: DataFrame) -> DataFrame:
    """run, folded, subroot, proof at the root, for each run of leaves that share their way up (``start``).

    In a step every run meets the node that it ascends into, appends the hashes
    of that node's other children to its proof and folds its leaves' hashes with
    them. A node above many runs is there in copies, each for at most
    ``RUNS_PER_COPY`` or so of them, so that no key of the join is hot.
    """
    spark = start.sparkSession
    copies = F.ceil(F.col("leaves") / (FAN * RUNS_PER_COPY)).cast("int")
    dealt = nodes.withColumn("copies", copies).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    names = {}
    for role, df in (("start", start), ("nodes", stored(dealt, "merkle-nodes"))):
        names[role] = shared_path(spark, f"merkle_{role}").rsplit("/", 1)[1].replace("-", "_")
        df.createOrReplaceTempView(names[role])
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # a row per run and level; levels stay below the level limit
    try:
        return stored(spark.sql(CLIMB.format(fan=FAN, top=TOP, **names)), "merkle-climb")
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
        for name in names.values():
            spark.catalog.dropTempView(name)


def manifest(docs: DataFrame, tamper_every: int = TAMPER_EVERY) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves of a source ascend by doc_id (NULL first; equal ids by their hash).
    NULL in a field is ``-``; a NULL doc_id is never tampered. Repeated rows are leaves
    of their own. An empty table gives no row. Whole texts are hashed where they are read; from
    there on only digests travel.
    """
    numbered = numbered_leaves(leaves(docs, tamper_every))
    one = F.lit(1).cast("long")
    bottom = numbered.select("tree", "pos", F.col("leaf").alias("hash"), "size", one.alias("leaves"))
    most = numbered.agg(F.max("size").alias("size"), F.max("tree").alias("tree")).first()
    trees = 0 if most["tree"] is None else most["tree"] + 1
    levels = build_levels(bottom, most["size"] or 0, "merkle-level")
    above = stored(subroots(bottom, levels).select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "hash",
                                                   F.lit(trees).cast("long").alias("size"), "leaves"), "merkle-subroots")
    top_levels = build_levels(above, trees, "merkle-top")
    root = subroots(above, top_levels).select(F.col("hash").alias("root"))
    link = lambda level, pos: [c.alias(name) for name, c in way_up(
        F.col("tree"), level, pos, F.col("size"), trees > 1).items()]

    # a run: at most FAN leaves with one parent, which fold here; a lone leaf is its source's subroot
    runs = numbered.groupBy("tree", "size", F.floor(F.col("pos") / FAN).cast("long").alias("at")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "doc_id", "leaf", F.coalesce("tampered", "leaf").alias("own")))).alias("items"))
    left = lambda i: F.concat_ws("", F.slice(F.col("items.leaf"), 1, i))
    right = lambda i: F.concat_ws("", F.slice(F.col("items.leaf"), i + 2, FAN))
    alone = F.col("size") == 1
    runs = stored(runs.select(
        F.concat_ws(":", "tree", "at").alias("run"), "tree", "size", "at", "items",
        F.transform("items", lambda x, i: F.when(alone, x["own"]).otherwise(F.sha2(F.concat(left(i), x["own"], right(i)), 256))).alias("folded"),
        F.when(alone, F.col("items.leaf")[0]).when(F.col("size") <= FAN, F.sha2(F.concat_ws("", "items.leaf"), 256)).alias("subroot")),
        "merkle-runs")
    start = runs.select("run", F.pmod(F.xxhash64("run"), F.lit(1 << 30)).alias("spread"),
                        *link(F.when(alone, 0).otherwise(1), F.col("at")), "folded", "subroot")
    every = [*levels, *top_levels]
    if every:
        nodes = every[0]
        for level in every[1:]:
            nodes = nodes.unionByName(level)
        done = climb(start, nodes.select("tree", "level", "pos", "kids", "hash", "leaves", height(F.col("size")).alias("height"),
                                         *link(F.col("level"), F.col("pos"))))
    else:
        done = start.select("run", "folded", "subroot", F.lit("").alias("proof"))
    near = F.transform("items", lambda x, i: F.concat(left(i), right(i)))
    met = done.join(runs.select("run", "items"), "run").crossJoin(F.broadcast(root))  # one row
    each = met.select("subroot", "root", "proof", F.explode(F.arrays_zip("items", near.alias("near"), "folded")).alias("x"))
    return each.select(F.col("x.items.doc_id").alias("doc_id"), F.col("x.items.leaf").alias("leaf"), "subroot", "root",
                       F.sha2(F.concat("x.near", "proof"), 256).alias("proof_sha256"), F.col("x.folded").alias("folded_root"),
                       (F.col("x.folded") == F.col("root")).alias("verified"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and the check of a tampered fifth, for every document."""
    return manifest(table(spark, sf_dir, "documents"))


QUERIES = {"op12_merkle": op12_merkle}
# crc32 is folded bit by bit over the decimal digits of the id.
ORACLE = {"op12_merkle": """
    WITH RECURSIVE f AS (
        SELECT doc_id, source, text,
               concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END,
                      CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
                      CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
                      CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END) AS head,
               xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, 1 + length(CAST(doc_id AS VARCHAR))),
                   lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT))),
                   lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
                       lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)),
                   CAST(4294967295 AS BIGINT)) AS crc
        FROM documents),
    h AS (
        SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
               CASE WHEN crc % 5 = 0 AND text IS NOT NULL THEN sha256(head || strlen(text) || ':' || translate(text,
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) END AS tampered
        FROM f),
    l AS (
        SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
               row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
               count(*) OVER (PARTITION BY source) AS size
        FROM h),
    up AS (
        SELECT tree, 0 AS level, pos, leaf AS hash, size FROM l
        UNION ALL
        SELECT tree, level + 1, pos // 16, sha256(string_agg(hash, '' ORDER BY pos)), (size + 15) // 16
        FROM up WHERE size > 1 GROUP BY tree, level, pos // 16, size),
    subs AS (
        SELECT tree, hash, level, count(*) OVER () AS size FROM up WHERE size = 1),
    top AS (
        SELECT 0 AS level, tree AS pos, hash, size FROM subs
        UNION ALL
        SELECT level + 1, pos // 16, sha256(string_agg(hash, '' ORDER BY pos)), (size + 15) // 16
        FROM top WHERE size > 1 GROUP BY level, pos // 16, size),
    root AS (SELECT hash FROM top WHERE size = 1),
    kids AS (
        SELECT tree, level, pos // 16 AS at, list(hash ORDER BY pos) AS hashes FROM up WHERE size > 1 GROUP BY ALL
        UNION ALL
        SELECT -1, level, pos // 16, list(hash ORDER BY pos) FROM top WHERE size > 1 GROUP BY ALL),
    climb AS (
        SELECT row_number() OVER () AS id, CASE WHEN size = 1 THEN -1 ELSE tree END AS tree, 0 AS level,
               CASE WHEN size = 1 THEN tree ELSE pos END AS pos, tree AS own, coalesce(tampered, leaf) AS folded, '' AS proof,
               doc_id, leaf, 0 AS steps
        FROM l
        UNION ALL
        SELECT c.id, CASE WHEN c.tree >= 0 AND c.level + 1 = s.level THEN -1 ELSE c.tree END,
               CASE WHEN c.tree >= 0 AND c.level + 1 = s.level THEN 0 ELSE c.level + 1 END,
               CASE WHEN c.tree >= 0 AND c.level + 1 = s.level THEN c.own ELSE c.pos // 16 END, c.own,
               sha256(concat(array_to_string(k.hashes[1:c.pos % 16], ''), c.folded, array_to_string(k.hashes[c.pos % 16 + 2:], ''))),
               concat(c.proof, array_to_string(k.hashes[1:c.pos % 16], ''), array_to_string(k.hashes[c.pos % 16 + 2:], '')),
               c.doc_id, c.leaf, c.steps + 1
        FROM climb c JOIN subs s ON s.tree = c.own
        JOIN kids k ON k.tree = c.tree AND k.level = c.level AND k.at = c.pos // 16),
    ends AS (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY steps DESC) AS back FROM climb)
    SELECT e.doc_id, e.leaf, s.hash AS subroot, r.hash AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root,
           e.folded = r.hash AS verified
    FROM ends e JOIN subs s ON s.tree = e.own CROSS JOIN root r WHERE e.back = 1"""}
