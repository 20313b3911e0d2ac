import base64
import gzip
import hashlib
import os
import zlib

import duckdb
import pyarrow as pa
import pytest
from llm_fixtures import SF_SMALL

from crisismap.llm import warc as W


def found(records):
    return sorted((tuple(r) for r in records.collect()), key=str)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF_SMALL}/pages.parquet'")
    assert found(W.op11_warc(spark, SF_SMALL)) == sorted(con.execute(W.ORACLE["op11_warc"]).fetchall(), key=str)


ODD = [(1, "http://a/ b\r\nx", "same"), (2, "http://a", "same"), (2, "http://a", "same"), (3, None, None), (4, "u", ""), (None, "u", "same"),
       (None, None, "no id"), (5, "u", "é 你 \U0001f600\r\n\r\nWARC/1.1\r\n"), (6, "u", "x" * 300_000), (7, "u", "hot")] + [(i, "u", "hot") for i in range(100, 300)]
RANK = {"response": 0, "revisit": 1}


def brute(rows, smallest):
    groups = {}
    for i, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    out = []
    for payload, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        same = len(payload) >= smallest
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out += [(i, len(payload), digest, "revisit" if same and n else "response", ids[-1] if same and n else None)
                for n, i in enumerate(reversed(ids))]
    return sorted(out, key=str)


@pytest.mark.parametrize("smallest, range_bytes, archive_bytes", [(0, 1 << 26, 1 << 30), (0, 100, 1000), (5, 777, 5000)])
def test_edges(spark, smallest, range_bytes, archive_bytes):
    pages = spark.createDataFrame(ODD, "page_id long, url string, html string").selectExpr("*", "'x' AS row", "1 AS size", "2 AS `a.b`")
    got = found(W.archived(pages.repartition(3), smallest, range_bytes, archive_bytes))
    assert got == brute(ODD, smallest)
    assert W.archived(pages.limit(0)).count() == 0


def test_archives_are_plain_warc(spark, tmp_dir):
    pages = spark.createDataFrame(ODD[:8], "page_id long, url string, html string").coalesce(1)
    W.write_warc(W.archive_records(pages), tmp_dir)
    names = os.listdir(tmp_dir)
    assert names and all(n.endswith(".warc.gz") and not n.startswith(".") for n in names)
    whole = b"".join(gzip.open(f"{tmp_dir}/{n}").read() for n in names)  # members in a row are one gzip file
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and whole.count(b"\r\nWARC-Type: re") == len(ODD[:8])
    back = W.read_warc(spark, tmp_dir).where("record_type = 'response'").collect()
    assert {bytes(r.payload).decode() for r in back} == {html or "" for _, _, html in ODD[:8]} and all(r.digest_ok for r in back)
    assert not any("\n" in r.target_uri or " " in r.target_uri for r in back)
    bare = W.read_warc(spark, tmp_dir, payload=False).where("record_type = 'response'").collect()
    assert {r.payload for r in bare} == {None} and sorted(r.payload_bytes for r in bare) == sorted(r.payload_bytes for r in back)


def member(kind, payload, digest=None):
    return W.encode_record(kind, "urn:page:1:1", "http://x", None, digest or W.bare_sha1(payload), len(payload), payload)


def stored_member(content):
    """A gzip member whose deflate blocks hold the content as it is."""
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def test_every_split_gives_each_record_once(spark, tmp_dir):
    """False magic bytes between and inside members, an archive nested in a payload, a broken member, a cut end."""
    inner = member("response", b"nested") * 3
    outer_head, outer = zlib.decompress(member("response", inner), 31).split(b"\r\n\r\n", 1)
    noise = b"\x1f\x8b\x08" * 5 + b"\x00" * 10
    parts = [member("response", b"first"), noise, stored_member(outer_head + b"\r\n\r\n" + outer), member("response", b"wrong", "ABC"),
             gzip.compress(b"no record"), member("response", b"broken" * 200)[:-3] + b"???", member("response", b"last"),
             member("response", b"cut off" * 90)[:-20]]
    with open(f"{tmp_dir}/a.warc.gz", "wb") as out:
        out.write(b"".join(parts))
    size = sum(map(len, parts))
    for range_bytes in (7, 60, 500, size):
        got = W.without_nested(W.read_warc(spark, tmp_dir, range_bytes)).orderBy("offset").collect()
        kinds = [(bytes(r.payload) if r.payload is not None else None, r.digest_ok) for r in got if r.record_type != "damaged"]
        assert kinds == [(b"first", True), (inner, True), (b"wrong", False), (b"last", True)]
        assert [r.offset for r in got if r.record_type == "damaged"] == [sum(map(len, parts[:5])), sum(map(len, parts[:7]))]


def test_uncommitted_files_are_not_read(spark, tmp_dir):
    writer = W.WarcWriter(f"file:{tmp_dir}", 1 << 20)
    row = {"record_type": "response", "record_id": "urn:page:1:1", "target_uri": "u", "refers_to": None, "payload_digest": "x",
           "payload_bytes": 1, "payload": b"x"}
    lost, kept = (writer.write(iter([pa.RecordBatch.from_pylist([row])])) for _ in range(2))
    assert W.read_warc(spark, tmp_dir).count() == 0
    writer.commit([kept, None])
    writer.abort([lost])
    assert W.read_warc(spark, tmp_dir).where("record_type = 'response'").count() == 1 and len(os.listdir(tmp_dir)) == 1
