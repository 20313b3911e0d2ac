"""Operator 4: exact deduplication by Grace hashing on complete normalised contents."""

from __future__ import annotations

import hashlib
import itertools
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crisismap.llm.common import own_columns, stored, table

# White space that equality ignores: U+0020 and U+0009 to U+000D.
IGNORED = b" \t\n\x0b\x0c\r"
# Content bytes a task's table may hold before its records go to spill files.
MEMORY_BYTES = 64 << 20
FAN_OUT = 16
# Rows per Arrow batch that a task hands on.
ROWS_OUT = 4096
BATCH_BYTES = 8 << 20


class OpenTable:
    """Open addressing with linear probing; a slot matches only if the complete content is equal."""

    def __init__(self):
        self.slots = np.full(64, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def find(self, key: int, content: bytes, add: bool = True) -> tuple[int, bool]:
        """(entry, whether it is new) of a content with this 64-bit hash; entry -1 if it is neither there nor added."""
        if 2 * (len(self.contents) + 1) > self.slots.size:
            self._grow()
        mask = self.slots.size - 1
        slot = key & mask
        slots = self.slots
        while (entry := slots[slot]) >= 0:
            if self.hashes[entry] == key and self.contents[entry] == content:
                return int(entry), False
            slot = slot + 1 & mask
        if not add:
            return -1, False
        entry = len(self.contents)
        slots[slot] = entry
        self.hashes.append(key)
        self.contents.append(content)
        self.bytes += len(content) + 64
        return entry, True

    def _grow(self) -> None:
        self.slots = np.full(self.slots.size * 4, -1, np.int64)
        mask = self.slots.size - 1
        for entry, key in enumerate(self.hashes):
            slot = key & mask
            while self.slots[slot] >= 0:
                slot = slot + 1 & mask
            self.slots[slot] = entry


Record = tuple[bytes, bytes, tuple]  # digest, content, integers that belong to the record


def grace(records: Iterable[Record], memory: int = MEMORY_BYTES, folder: str | None = None, depth: int = 0,
          names: Iterator[int] | None = None) -> Iterator[tuple[int, Record]]:
    """(class, record) of each record; two records share a class number exactly if their contents are equal.

    Records go into an open-addressing table while it fits ``memory``. When it
    is full, records of contents that it does not hold are dealt by the next
    bits of their digest to spill files (a task's own scratch), each of which
    is then treated alike with the bits after those. A table keeps one copy of
    a content however often it occurs, so a group of copies of any size needs
    no more memory than one of them.
    """
    names = names or itertools.count()
    opened, classes, files = OpenTable(), [], {}
    for digest, content, numbers in records:
        key = int.from_bytes(digest[-8:], "little")
        full = opened.bytes > memory
        entry, new = opened.find(key, content, add=not full)
        if entry < 0:
            bucket = digest[depth % 16] % FAN_OUT if depth < 16 else digest[depth % 16] // FAN_OUT
            if bucket not in files:
                files[bucket] = tempfile.TemporaryFile(dir=folder)  # has no name: gone with the task
            files[bucket].write(_HEAD.pack(digest, len(content), len(numbers)))
            files[bucket].write(struct.pack(f"<{len(numbers)}q", *numbers))
            files[bucket].write(content)
            continue
        if new:
            classes.append(next(names))
        yield classes[entry], (digest, content, numbers)
    del opened, classes
    for bucket in sorted(files):
        with files.pop(bucket) as file:
            file.seek(0)
            yield from grace(_unspill(file), memory, folder, depth + 1, names)


_HEAD = struct.Struct("<32sqq")


def _unspill(file) -> Iterator[Record]:
    while head := file.read(_HEAD.size):
        digest, size, n = _HEAD.unpack(head)
        numbers = struct.unpack(f"<{n}q", file.read(8 * n))
        yield digest, file.read(size), numbers


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text without the ignored white space; NULL counts as empty."""
    return (text or "").encode().translate(None, IGNORED)


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded rows and bytes (the last field's, if it is binary)."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if len(out) >= ROWS_OUT or size > BATCH_BYTES:
            yield _batch(out, schema)
            out, size = [], 0
    if out:
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


NUMBERED = pa.schema([("row", pa.int64()), ("first_row", pa.int64()), ("doc_id", pa.int64()), ("n_chars", pa.int64()),
                      ("sha", pa.string()), ("content", pa.binary())])


def _numbered(rows: DataFrame, memory: int) -> DataFrame:
    """Of (row, doc_id, text): each row with its digest and the first row of its content in the same task.

    Only that first row carries the content, so later steps move a content
    once per task that has it and not once per copy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Record]:
            for batch in batches:
                ids, texts, numbers = batch.column("doc_id"), batch.column("text"), batch.column("row")
                for i in range(batch.num_rows):
                    doc_id, text = ids[i].as_py(), texts[i].as_py() or ""
                    content = normalised(text)
                    yield (hashlib.sha256(content).digest(), content,
                           (numbers[i].as_py(), doc_id or 0, int(doc_id is None), len(text)))

        def result() -> Iterator[tuple]:
            firsts: list[int] = []
            for kind, (digest, content, (row, doc_id, no_id, n_chars)) in grace(records(), memory):
                if kind == len(firsts):
                    firsts.append(row)
                yield (row, firsts[kind], None if no_id else doc_id, n_chars, digest.hex(),
                       content if firsts[kind] == row else None)

        yield from _batches(result(), NUMBERED)

    return rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "row long, first_row long, doc_id long, n_chars long, sha string, content binary")


MEMBERS = pa.schema([("first_row", pa.int64()), ("class_row", pa.int64())])


def _classes(firsts: DataFrame, memory: int) -> DataFrame:
    """Of (first_row, sha, content): the smallest first row with the same content, over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Record]:
            for batch in batches:
                rows, digests, contents = batch.column("first_row"), batch.column("sha"), batch.column("content")
                for i in range(batch.num_rows):
                    yield bytes.fromhex(digests[i].as_py()), contents[i].as_py(), (rows[i].as_py(),)

        members, least = [], {}
        for kind, (_, _, (row,)) in grace(records(), memory):
            members.append((row, kind))
            least[kind] = min(row, least.get(kind, row))
        yield from _batches(((row, least[kind]) for row, kind in members), MEMBERS)

    return firsts.select("first_row", "sha", "content").repartition("sha").mapInArrow(
        run, "first_row long, class_row long")


def group_rows(rows: DataFrame, memory: int = MEMORY_BYTES) -> DataFrame:
    """Of (row, doc_id, text) with unique rows: row, doc_id, keep_row, keep_id, group_size, kept, text_sha256.

    Two rows are in one group exactly if their texts without ``IGNORED``
    characters are equal byte for byte; NULL text counts as empty, and empty
    texts are a group like any other. The kept row has the most code points,
    then the smallest ``doc_id`` (NULL after all others), then the smallest
    row, so exactly one row of a group is kept, repeated rows included.

    A content crosses the shuffle once per scan task that holds it. Copies are
    counted per task and then per group, so a group with a third of all rows
    is no larger than any other in a reduce task.
    """
    numbered = stored(_numbered(rows, memory), "dedup-rows")
    classes = _classes(numbered.where("row = first_row"), memory)
    best = F.struct((-F.col("n_chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"),
                    F.coalesce("doc_id", F.lit(0)).alias("id"), "row")
    local = numbered.groupBy("first_row").agg(F.count("*").alias("n"), F.min(best).alias("best"))
    member = stored(local.join(classes, "first_row"), "dedup-members")
    whole = member.groupBy("class_row").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
    decided = member.select("first_row", "class_row").join(whole, "class_row").select(
        "first_row", "group_size", F.col("best.row").alias("keep_row"),
        F.when(~F.col("best.no_id"), F.col("best.id")).alias("keep_id"))
    return numbered.select("row", "first_row", "doc_id", "sha").join(decided, "first_row").select(
        "row", "doc_id", "keep_row", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def dedup_report(docs: DataFrame, memory: int = MEMORY_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (see ``group_rows``)."""
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return group_rows(rows, memory).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, memory: int = MEMORY_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: one of each group of equal texts."""
    if not {"doc_id", "text"} <= set(docs.columns):
        raise ValueError("documents need doc_id and text")
    row = "row_" + uuid.uuid4().hex  # clashes with no column
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "dedup-docs")
    groups = group_rows(numbered.select(F.col(row).alias("row"), "doc_id", "text"), memory)
    gone = groups.where(~F.col("kept")).select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*own_columns(docs))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document, and which one stays."""
    return dedup_report(table(spark, sf_dir, "documents"))


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLE = {"op4_exact_dedup": r"""
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS n,
               sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
        FROM documents),
    w AS (
        SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size
        FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM w"""}
