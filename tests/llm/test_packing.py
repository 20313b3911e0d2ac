import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import SF_SMALL, edge, empty  # noqa: F401
from tokenizers import Tokenizer

from crisismap.llm import packing as K

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_layout(rows, limit):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    return len(by)


def test_query_equals_library(spark):
    texts = dict(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect())
    rows = K.op10_packing(spark, SF_SMALL).collect()
    n = check_layout(rows, 1024)
    assert n <= 1.01 * -(-sum(r.length for r in rows) // 1024) + 1
    of = defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
    for doc_id, text in texts.items():
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(of[doc_id], key=lambda r: r.piece)
        assert [r.start for r in own] == [s for s, _ in K.cut(len(ids), 1024)] and sum(r.length for r in own) == len(ids)
        assert all(r.length == 1024 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())


@pytest.mark.parametrize("rule", [K.Rule("norm"), K.Rule("dot"), K.Rule("norm", (1.0, 1.0, 1.0))])
@pytest.mark.parametrize("capacity", [K.Capacity(), K.Capacity(100, 3, 100 * 100), K.Capacity(100, 100, 2500)])
def test_every_constraint_holds(rule, capacity):
    rng = np.random.default_rng(0)
    top = min(capacity.tokens, int(capacity.attention**0.5))
    sizes = rng.integers(1, top + 1, 700)
    lengths, counts = np.unique(sizes, return_counts=True)
    bins = defaultdict(list)
    placed = defaultdict(int)
    for length, first, count, first_bin, per_bin, offset in K.plan(lengths.tolist(), counts.tolist(), capacity, rule).tolist():
        assert first == placed[length]
        placed[length] += count
        for turn in range(count):
            bins[first_bin + turn // per_bin].append((offset + turn % per_bin * length, length))
    assert dict(placed) == dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity.tokens and len(places) <= capacity.documents
        assert sum(n * n for _, n in places) <= capacity.attention


def test_one_length_for_all(spark):
    docs = spark.createDataFrame([(i, "copy of one text") for i in range(3000)], "doc_id long, text string")
    rows = K.pack(docs).collect()
    assert check_layout(rows, 1024) == -(-len(rows) // (1024 // rows[0].length))


def test_encoder_equals_library():
    ranks = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    encoder = K.Encoder(ranks, open(public_tokenizers.path("byte_bpe_50k.json")).read(), public_tokenizers.PATTERN)
    for text in ("", "a <|endoftext|> b", " \n\n x", "你好 ꟍ ՘", "don't  stop\t!!", " x\x85y\x1c", "1234567 été"):
        assert encoder.ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_edges(edge, empty):
    rows = K.pack(edge, with_ids=True).collect()
    check_layout(rows, 1024)
    assert {r.length for r in rows if r.doc_id in (1, 2)} == {1}
    assert sum(r.doc_id == 4 for r in rows) == 2
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert K.pack(empty).count() == 0
