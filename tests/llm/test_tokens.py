import hashlib

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import SF_SMALL, edge, empty  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from crisismap.llm import bpe_codec, token_counts
from crisismap.llm.bpe import Vocabulary

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
VOCABULARY = Vocabulary(bpe_codec.vocabulary_file())
COUNTS = token_counts.Counts(VOCABULARY)


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbeThE's!1 \n\té́Σß你😀\x1c\x85<|endoftext|>", max_size=60), min_size=1, max_size=5))
def test_ids_and_counts_equal_the_librarys(texts):
    for text, ids in zip(texts, VOCABULARY.encode_batch(texts), strict=True):
        want = library_ids(text)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert VOCABULARY.decode(ids).decode() == LIBRARY.decode(want, skip_special_tokens=False)
        chunks = VOCABULARY.chunks(text)
        known = COUNTS.of(set(chunks))
        assert sum(known[c] for c in chunks) == len(want)


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2001, "<|startoftext|><|endoftext|>x", "'s't've", "é" * 999])
def test_long_and_overlapping_runs(text):
    assert np.frombuffer(VOCABULARY.encode_batch([text])[0], "<u4").tolist() == library_ids(text)


def test_query_equals_library(spark):
    texts = dict(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect())
    counts = {r.doc_id: r for r in token_counts.op7_token_counts(spark, SF_SMALL).collect()}
    for r in bpe_codec.op1_bpe_codec(spark, SF_SMALL).collect():
        ids = library_ids(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) == counts[r.doc_id].n_tokens
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert counts[r.doc_id].over_limit == (len(ids) > 2048)


def test_edges(edge, empty):
    rows = bpe_codec.encode(edge).collect()
    assert len(rows) == edge.count()
    assert all(r.n_tokens == 0 and r.decoded == "" for r in rows if r.doc_id in (1, 2, 3))
    assert bpe_codec.encode(empty).count() == token_counts.count_tokens(empty).count() == 0
    counted = {r.doc_id: r for r in token_counts.count_tokens(edge).collect()}
    assert counted[1].n_bytes == counted[1].n_tokens == 0 and not counted[1].over_limit
    assert counted[6].over_limit and None in counted
