"""Operator 2: SimHash near-duplicates through a Gray-order hierarchical index."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crisismap.llm.common import own_columns, stored, table, text_slices
from crisismap.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
# Fingerprints that may share a key before the key takes in more bits.
GROUP_ROWS = 20_000
# Children of an index node.
FAN_OUT = 4
# Pairs of a query and an index node that a task holds at once.
FRONTIER = 1_500_000
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str, words: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each word shingle, repeats included; fewer words: of the whole sequence; none: nothing."""
    tokens = text.encode().lower().split()  # bytes: only A-Z and only U+0020, U+0009 to U+000D
    if not tokens:
        return []
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(itertools.accumulate(map(len, tokens), lambda a, n: a + n + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip([0, *(e + 1 for e in ends)], ends[words - 1:], strict=False)]


def fingerprints(texts: list[str], words: int = SHINGLE_WORDS) -> np.ndarray:
    """A bit is one if it is one in over half of the text's shingle hashes; no word: zero."""
    hashes = [shingle_hashes(text, words) for text in texts]
    counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
    flat = np.fromiter(itertools.chain.from_iterable(hashes), np.uint64, int(counts.sum()))
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    starts = np.cumsum(counts[some]) - counts[some]
    for i, row in enumerate(some):
        bits = np.unpackbits(flat[starts[i]:starts[i] + counts[row]].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        major = bits.sum(axis=0, dtype=np.int64) * 2 > counts[row]
        out[row] = np.packbits(major, bitorder="little").view("<u8")[0]
    return out


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the sequence of Gray codes: neighbours there differ in few bits."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each count, in one array."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - before, counts)


class GrayIndex:
    """Codes sorted by (group, Gray rank) under levels of nodes that hold the bits their children share.

    A node keeps the pattern common to all codes below it as bits and mask; its
    children test only the bits that it does not. A search starts at its group's
    root and adds up differing bits on the way down, so a whole subtree goes as
    soon as the patterns above it differ in too many bits.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        self.codes, self.group = codes, group
        bits, mask, owner = codes, np.full(codes.size, _ALL), group
        self.levels: list[tuple[np.ndarray, ...]] = []  # from the leaves: bits, mask that is left to test, children
        first, count = np.arange(codes.size), np.ones(codes.size, np.int64)
        while True:
            heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(heads, owner.size))
            if (sizes == 1).all():
                self.levels.append((bits, mask, first, count))
                break
            place = np.arange(owner.size) - np.repeat(heads, sizes)
            cut = np.flatnonzero(place % FAN_OUT == 0)
            both = np.bitwise_and.reduceat(mask, cut)
            differ = np.bitwise_or.reduceat(bits, cut) ^ np.bitwise_and.reduceat(bits, cut)
            shared = both & ~differ
            children = np.diff(np.append(cut, owner.size))
            self.levels.append((bits, mask & ~np.repeat(shared, children), first, count))
            bits, mask, owner, first, count = bits[cut] & shared, shared, owner[cut], cut, children
        self.root = np.repeat(np.arange(owner.size), np.diff(np.append(np.searchsorted(group, owner), group.size)))

    def near(self, limit: int, frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of pairs (i, j), i < j, of one group whose codes differ in at most ``limit`` bits."""
        heads = np.flatnonzero(np.concatenate(([True], self.group[1:] != self.group[:-1])))
        sizes = np.diff(np.append(heads, self.group.size))
        most = np.cumsum(np.repeat(sizes, sizes))  # a query meets at most its group at any level
        start = 0
        while start < self.codes.size:
            before = most[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(most, before + frontier, "right")))
            query = np.arange(start, stop)
            node, apart = self.root[start:stop], np.zeros(stop - start, np.uint8)
            for depth in range(len(self.levels) - 1, -1, -1):
                bits, mask, first, count = self.levels[depth]
                apart = apart + np.bitwise_count((self.codes[query] ^ bits[node]) & mask[node])
                stay = apart <= limit
                query, node, apart = query[stay], node[stay], apart[stay]
                if depth:
                    grown = count[node]
                    query, apart = np.repeat(query, grown), np.repeat(apart, grown)
                    node = _ragged(first[node], grown)
                    if depth == 1:  # leaves: each pair once
                        stay = node > query
                        query, node, apart = query[stay], node[stay], apart[stay]
            stay = node > query
            yield query[stay], node[stay]
            start = stop


def _find(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    while True:
        up = parent[at]
        if (up == at).all():
            return at
        at = up


def linked(codes: np.ndarray, group: np.ndarray, limit: int = MAX_BITS, frontier: int = FRONTIER) -> np.ndarray:
    """For each code (sorted by group and Gray rank) the first code of its component within its group."""
    parent = np.arange(codes.size)
    for a, b in GrayIndex(codes, group).near(limit, frontier) if codes.size else ():
        while a.size:
            a, b = _find(parent, a), _find(parent, b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        parent = _find(parent, parent)
    return parent


def key_masks(fixed: int, block_bits: int, limit: int) -> list[int]:
    """Masks that extend ``fixed``: codes that agree on it and differ in at most ``limit`` bits agree on one of them."""
    free = [i for i in range(64) if not fixed >> i & 1]
    blocks = [sum(1 << i for i in free[at:at + block_bits]) for at in range(0, len(free), block_bits)]
    return [fixed | sum(chosen) for chosen in itertools.combinations(blocks, len(blocks) - limit)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _keyed(codes: DataFrame, masks: list[int]) -> DataFrame:
    each = F.explode(F.array(*[F.lit(_signed(m)) for m in masks]))
    return codes.select("fp", each.alias("mask")).withColumn("key", F.expr("fp & mask"))


def link_edges(codes: DataFrame, limit: int = MAX_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that connect exactly those within ``limit`` bits.

    Fingerprints meet under keys of whole blocks of their bits: of limit + 2
    blocks, two that are alike. A key shared by more than ``group_rows`` of them
    is split by as many blocks of its remaining bits again, and so on, which loses
    no pair. Each key's codes are searched through a ``GrayIndex``, and only a
    spanning star of each component found there leaves the task.
    """
    level = key_masks(0, max(1, 64 // (limit + 2)), limit)
    rows, settled = _keyed(codes, level), []
    while True:
        free = 64 - bin(level[0]).count("1")
        hot = stored(rows.groupBy("mask", "key").count().where(F.col("count") > group_rows)
                     .select("mask", "key"), "simhash-hot")
        if free <= limit + 1 or hot.isEmpty():
            settled.append(rows)
            break
        settled.append(rows.join(hot, ["mask", "key"], "left_anti"))
        finer = {m: key_masks(m, max(1, free // (limit + 2)), limit) for m in level}
        step = F.create_map(*itertools.chain.from_iterable(
            (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in more])) for m, more in finer.items()))
        rows = (rows.join(hot, ["mask", "key"], "left_semi").select("fp", F.explode(step[F.col("mask")]).alias("mask"))
                .distinct().withColumn("key", F.expr("fp & mask")))
        level = sorted(set(itertools.chain.from_iterable(finer.values())))
    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more.select(every.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[], [], []]
        for batch in batches:
            for have, name in zip(columns, ("mask", "key", "fp"), strict=True):
                have.append(batch.column(name).to_numpy())
        if not columns[0]:
            return
        mask, key, codes = (np.concatenate(c) for c in columns)
        del columns
        codes = codes.view(np.uint64)
        order = np.lexsort((gray_rank(codes), key, mask))
        mask, key, codes = mask[order], key[order], codes[order]
        new = np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])))
        group = np.cumsum(new) - 1
        some = np.bincount(group)[group] > 1
        codes, group = codes[some], group[some]
        root = linked(codes, group, limit)
        other = root != np.arange(root.size)
        u, v = codes[other].view(np.int64), codes[root[other]].view(np.int64)
        for at in range(0, u.size, 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at:at + (1 << 16)]) for x in (u, v)], ["u", "v"])

    return every.select("mask", "key", "fp").repartition("mask", "key").mapInArrow(run, "u long, v long").distinct()


def fingerprint_rows(rows: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """Of (row, doc_id, text): row, doc_id and the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch, "text"):
                made = fingerprints(texts, words).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(start, len(texts)), batch.column("doc_id").slice(start, len(texts)),
                     pa.array(made)], ["row", "doc_id", "fp"])

    return rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "row long, doc_id long, fp long")


def near_groups(rows: DataFrame, words: int = SHINGLE_WORDS, limit: int = MAX_BITS,
                group_rows: int = GROUP_ROWS) -> DataFrame:
    """Of (row, doc_id, text) with unique rows: row, doc_id, fp, component_id, keep_row.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``limit`` bits, the document's own included (NULL ids count after all
    others); ``keep_row`` is the row that has it, the smallest if it repeats.
    NULL and empty texts have fingerprint zero and link like any other.

    Copies share a fingerprint and are collapsed before any link is looked for;
    only distinct fingerprints meet, and only stars of links leave a task.
    """
    marked = stored(fingerprint_rows(rows, words), "simhash-rows")
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row")
    codes = stored(marked.groupBy("fp").agg(F.min(best).alias("best")), "simhash-codes")
    root = components(link_edges(codes.select("fp"), limit, group_rows))
    member = codes.join(root.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "best", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("best").alias("least"))
    decided = member.select("fp", "root").join(least, "root").select(
        "fp", F.when(~F.col("least.no_id"), F.col("least.id")).alias("component_id"),
        F.col("least.row").alias("keep_row"))
    return marked.join(decided, "fp").select("row", "doc_id", "fp", "component_id", "keep_row")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, limit: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (see ``near_groups``)."""
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return near_groups(rows, words, limit).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, limit: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: one of each component."""
    row = "row_" + uuid.uuid4().hex  # clashes with no column
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    groups = near_groups(numbered.select(F.col(row).alias("row"), "doc_id", "text"), words, limit)
    gone = groups.where("row <> keep_row").select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*own_columns(docs))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_simhash": op2_simhash}
ORACLE: dict[str, str] = {}
