"""Operator 11: WARC archives, written with revisit records and read back in byte ranges.

Archives are written and read by Spark data sources in Python (``WarcSource``), so tasks do all the work and
Spark retries it; files are opened with pyarrow's file systems (local and mounted folders, HDFS, object stores).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from crisismap.llm.common import shared_path, stored, table

# Fixed values of the formats: gzip members with deflate begin so; the revisit profile of WARC 1.1.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
BEGINNING = b"WARC/1."
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "1970-01-01T00:00:00Z"  # pages carry no time of their own; a fixed one keeps archives reproducible
ARCHIVE_BYTES = 1 << 30  # compressed size at which a task begins its next archive
RANGE_BYTES = 64 << 20  # bytes of an archive that a task of the reader owns
BLOCK_BYTES = 1 << 20  # bytes read at a time
SMALLEST_PAYLOAD = 0  # payloads below this many bytes are never revisits
HEAVY_GROUPS = 2000  # groups with more than this share (1 / n) of all rows are joined by broadcast

RECORD_SCHEMA = ("record_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
                 "payload_bytes long, payload binary")
READ_SCHEMA = f"archive string, range_start long, offset long, next_offset long, digest_ok boolean, {RECORD_SCHEMA}"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a path or URI; ``file:/x`` (as Spark writes it) is a local path."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def bare_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str | None) -> str:
    """A header value on one line: control characters and spaces are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def encode_record(kind: str, record_id: str, target: str, refers_to: str | None, digest: str, size: int,
                  payload: bytes | None) -> bytes:
    """One record as a gzip member of its own. A revisit has the HTTP header of its response, without the payload."""
    fields = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {WARC_DATE}"]
    if kind == "warcinfo":
        block = b"software: crisismap\r\nformat: WARC File Format 1.1\r\n"
        fields.append("Content-Type: application/warc-fields")
    else:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        fields += [f"WARC-Target-URI: {_line(target)}", f"WARC-Payload-Digest: sha1:{digest}",
                   "Content-Type: application/http; msgtype=response"]
        if kind == "revisit":
            fields += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
        else:
            block += payload or b""
    head = "\r\n".join([VERSION.decode(), *fields, f"Content-Length: {len(block)}", "", ""]).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes archives under hidden names; the commit of the whole job gives them their own.

    Files of lost or repeated attempts stay hidden, so readers never see a record twice.
    """

    def __init__(self, path: str, archive_bytes: int):
        self.path, self.archive_bytes = path.rstrip("/"), archive_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = _open(self.path)
        names, out, size = [], None, 0
        for batch in iterator:
            columns = [batch.column(c) for c in ("record_type", "record_id", "target_uri", "refers_to", "payload_digest",
                                                 "payload_bytes", "payload")]
            for i in range(batch.num_rows):
                if out is None or size >= self.archive_bytes:
                    if out is not None:
                        out.close()
                    files.create_dir(folder, recursive=True)
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = files.open_output_stream(f"{folder}/.{names[-1]}", compression=None), 0
                    info = encode_record("warcinfo", f"urn:uuid:{uuid.uuid4()}", "", None, "", 0, None)
                    size += out.write(info)
                size += out.write(encode_record(*(column[i].as_py() for column in columns)))
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _open(self.path)
        for name in (name for message in messages if message for name in message.names):
            files.move(f"{folder}/.{name}", f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = _open(self.path)
        for name in (name for message in messages if message for name in message.names):
            files.delete_file(f"{folder}/.{name}")


class Blocks:
    """Random access to a file by blocks, the last few of which are kept."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size, self.held = file, size, {}

    def read(self, at: int, end: int) -> bytes:
        parts, end = [], min(end, self.size)
        while at < end:
            number = at // BLOCK_BYTES
            if (block := self.held.get(number)) is None:
                if len(self.held) >= 4:
                    del self.held[min(self.held)]
                self.file.seek(number * BLOCK_BYTES)
                block = self.held[number] = self.file.read(min(BLOCK_BYTES, self.size - number * BLOCK_BYTES))
            start = at - number * BLOCK_BYTES
            parts.append(block[start:end - number * BLOCK_BYTES])
            at += len(parts[-1])
        return b"".join(parts)

    def find_magic(self, at: int, end: int) -> int:
        """First place in [at, end) where a gzip member may begin; -1 if there is none."""
        while at < end:
            stop = min((at // BLOCK_BYTES + 1) * BLOCK_BYTES, end)
            if (found := self.read(at, stop + len(MAGIC) - 1).find(MAGIC)) >= 0:
                return at + found
            at = stop
        return -1

    def member(self, at: int) -> tuple[bytes | None, int, bool]:
        """(content, end, begins like a record) of the gzip member at this place; content None if it is none."""
        unpack, parts, place, begun = zlib.decompressobj(31), [], at, False
        try:
            while not unpack.eof:
                data = unpack.unconsumed_tail
                if not data:
                    data = self.read(place, place + (1 << 16))
                    place += len(data)
                    if not data:
                        return None, at, begun  # the file ends within the member
                parts.append(unpack.decompress(data, 0 if begun else len(BEGINNING)))
                if not begun:
                    head = b"".join(parts)
                    if not BEGINNING.startswith(head[:len(BEGINNING)]):
                        return None, at, False
                    begun = len(head) >= len(BEGINNING)
        except zlib.error:
            return None, at, begun
        return b"".join(parts), place - len(unpack.unused_data), begun


def decode_record(content: bytes) -> tuple[dict[str, str], bytes] | None:
    """(fields by lower-case name, block) of a whole record; None if header and length don't fit it."""
    head, parted, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not parted or not lines[0].startswith(BEGINNING.decode()):
        return None
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    length = fields.get("content-length", "")
    if not length.isdecimal() or not {"warc-type", "warc-record-id"} <= set(fields) or rest[int(length):] != b"\r\n\r\n":
        return None
    return fields, rest[:int(length)]


def _row(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    """digest_ok and the columns of ``RECORD_SCHEMA``; size and digest of a response are those of the bytes at hand."""
    kind, bare = fields["warc-type"], lambda name: fields[name].strip("<>") if name in fields else None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size, payload, fine = None, None, None
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            found, size = bare_sha1(payload), len(payload)
            fine, digest = digest in (None, found), found
        else:
            payload = None
            told = re.search(rb"\r\ncontent-length:[ \t]*([0-9]+)", http, re.IGNORECASE)
            size = int(told[1]) if told else None
    return fine, kind, bare("warc-record-id"), fields.get("warc-target-uri"), bare("warc-refers-to"), digest, size, \
        payload if with_payload else None


def records_of(blocks: Blocks, start: int, end: int, with_payload: bool) -> Iterator[tuple]:
    """(offset, next offset, ``_row`` columns) of the records that begin in [start, end), read past the end if need be.

    A place with gzip's magic bytes counts only if it inflates to a whole record.
    One that begins like a record and then breaks off is given as ``damaged``.
    """
    at = start
    while at < end and (at := blocks.find_magic(at, end)) >= 0:
        content, after, begun = blocks.member(at)
        record = decode_record(content) if content is not None else None
        if record:
            yield at, after, *_row(*record, with_payload)
            at = after
        else:
            if begun:
                yield at, at + 1, None, "damaged", None, None, None, None, None, None
            at += 1


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class WarcReader(DataSourceReader):
    """Archives of a folder (hidden files apart), dealt to tasks in byte ranges whatever the members' lengths."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path = options["path"].rstrip("/")
        self.range_bytes = int(options.get("rangebytes") or options.get("rangeBytes") or RANGE_BYTES)
        self.with_payload = (options.get("payload") or "true").lower() == "true"
        from pyspark.sql.pandas.types import to_arrow_schema

        self.arrow = to_arrow_schema(schema)

    def partitions(self) -> list[Range]:
        files, folder = _open(self.path)
        scheme = self.path[:-len(folder)] if self.path.endswith(folder) else ""
        found = files.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        return [Range(scheme + info.path, start, min(start + self.range_bytes, info.size)) for info in found
                if info.type == fs.FileType.File and not info.base_name.startswith((".", "_"))
                for start in range(0, info.size, self.range_bytes)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        files, path = _open(partition.path)
        rows, size = [], 0
        with files.open_input_file(path) as file:
            for record in records_of(Blocks(file, file.size()), partition.start, partition.end, self.with_payload):
                rows.append((partition.path, partition.start, *record))
                size += len(record[-1] or b"") + 500
                if size > 8 << 20:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.arrow, strict=True)],
                                          schema=self.arrow)


class WarcSource(DataSource):
    """``format("warc")``: reads and appends folders of gzipped WARC archives.

    Options of the reader: ``rangeBytes``, ``payload`` (false leaves the payloads out); of the writer:
    ``archiveBytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to a folder, not overwritten")
        return WarcWriter(self.options["path"], int(self.options.get("archivebytes") or self.options.get("archiveBytes")
                                                    or ARCHIVE_BYTES))


def archive_records(pages: DataFrame, smallest: int = SMALLEST_PAYLOAD) -> DataFrame:
    """Rows of ``RECORD_SCHEMA`` for pages (page_id, url, html): a response per distinct payload, revisits of it.

    Of equal payloads (UTF-8 of html, NULL as empty) of at least ``smallest``
    bytes the row with the largest page_id is the response (NULL below all
    ids; of repeated rows one is), the others revisit it. Smaller ones are all
    responses. A group with more than 1 / ``HEAVY_GROUPS`` of all rows meets its
    response by a broadcast of at most that many groups, all others by a shuffle,
    so that no task gets more than that share of the rows for one key.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    numbered = stored(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                                   payload.alias("payload")).select(
        F.monotonically_increasing_id().alias("row"), "page_id", "url", "payload", F.octet_length("payload").cast("long").alias("size"),
        F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("content")), "warc-pages")
    best = F.struct(F.col("page_id").isNotNull(), "page_id", F.col("row"))
    groups = stored(numbered.where(F.col("size") >= smallest).groupBy("content").agg(F.count("*").alias("n"), F.max(best).alias("best"))
                    .where("n > 1").select(F.col("content").alias("same"), "n", F.col("best.page_id").alias("best_id"),
                                           F.col("best.row").alias("best_row")), "warc-groups")
    most = max(1, numbered.count() // HEAVY_GROUPS)
    heavy = groups.where(F.col("n") > most).select(F.col("same").alias("hot"), F.col("best_id").alias("hot_id"),
                                                   F.col("best_row").alias("hot_row"))
    rest = groups.where(F.col("n") <= most)
    met = numbered.join(F.broadcast(heavy), F.col("content") == F.col("hot"), "left")
    key = F.when(F.col("hot").isNotNull(), F.col("row").cast("string")).otherwise(F.col("content"))
    met = met.withColumn("key", key).join(rest, F.col("key") == F.col("same"), "left").select(
        "row", "page_id", "url", "payload", "size", "sha1", F.coalesce("hot_row", "best_row").alias("best_row"),
        F.when(F.col("hot_row").isNotNull(), F.col("hot_id")).otherwise(F.col("best_id")).alias("best_id"))
    named = lambda page, row: F.concat(F.lit("urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("")),
                                       F.lit(":"), F.col(row).cast("string"))
    revisit = F.coalesce(F.col("best_row") != F.col("row"), F.lit(False))
    digest = F.udf(lambda sha1: base64.b32encode(bytes.fromhex(sha1)).decode(), "string", useArrow=True)
    return met.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), named("page_id", "row").alias("record_id"),
        F.coalesce("url", named("page_id", "row")).alias("target_uri"),
        F.when(revisit, named("best_id", "best_row")).alias("refers_to"), digest("sha1").alias("payload_digest"),
        F.col("size").alias("payload_bytes"), F.when(~revisit, F.col("payload")).alias("payload"))


def write_warc(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Append archives with these records (``RECORD_SCHEMA``) to a folder."""
    spark = records.sparkSession
    spark.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").option("archiveBytes", archive_bytes).save(path)


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, payload: bool = True) -> DataFrame:
    """Records (``READ_SCHEMA``) of a folder of archives; see ``without_nested`` for payloads that are archives."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("rangeBytes", range_bytes).option("payload", str(payload).lower()).load(path)


def without_nested(records: DataFrame) -> DataFrame:
    """``records`` without those that lie inside another one, where a range began within its payload.

    A payload stored as it is may itself hold gzip members with whole records.
    A task that starts in its middle takes them for its own; they all lie before
    the end of the last record of an earlier range. Only one row per range meets
    in a window, of one archive at a time.
    """
    ends = records.groupBy("archive", "range_start").agg(F.max("next_offset").alias("last"))
    before = Window.partitionBy("archive").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    limit = ends.select("archive", "range_start", F.coalesce(F.max("last").over(before), F.lit(0)).alias("least"))
    return records.join(limit, ["archive", "range_start"]).where(F.col("offset") >= F.col("least")).drop("least")


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the page records among ``records``."""
    page = lambda name: F.expr(f"try_cast(regexp_extract({name}, '^urn:page:(-?[0-9]*):', 1) AS BIGINT)")
    return records.where(F.col("record_type").isin("response", "revisit")).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def archived(pages: DataFrame, smallest: int = SMALLEST_PAYLOAD, range_bytes: int = RANGE_BYTES,
             archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` into new archives of the shared folder and read them back: one row per page, NULLs,
    empty texts, ties and repeated rows as ``archive_records`` says; an empty table gives no row."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(archive_records(pages, smallest), path, archive_bytes)
    found = stored(read_warc(spark, path, range_bytes, payload=False).drop("payload"), "warc-index")
    return page_records(without_nested(found))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of an archive, read back by byte ranges."""
    return archived(table(spark, sf_dir, "pages"))


QUERIES = {"op11_warc": op11_warc}
# base32 of the 160-bit digest: five bits at a time, taken from its bits as text.
ORACLE = {"op11_warc": """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS t FROM pages),
    d AS (
        SELECT page_id, t, CAST(strlen(t) AS BIGINT) AS n, CAST(from_hex(sha1(t)) AS BIT)::VARCHAR AS bits,
               max(page_id) OVER (PARTITION BY t) AS best
        FROM p)
    SELECT page_id, n AS payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, 1 + 5 * i + j, 1) AS INTEGER)
               * (16 >> CAST(j AS INTEGER))))::INTEGER, 1)), '') AS payload_digest,
           CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> best THEN best END AS refers_to
    FROM d"""}
