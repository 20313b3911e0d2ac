"""Operator 7: token counts of whole texts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from crisismap.llm.bpe import CACHE_CHUNKS, NO_PAIR, Vocabulary
from crisismap.llm.bpe_codec import vocabulary, vocabulary_file
from crisismap.llm.common import table, text_slices

TOKEN_LIMIT = 2048
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def survivors(vocab: Vocabulary, words: Sequence[bytes]) -> np.ndarray:
    """How many symbols of each word are left when no pair merges any more.

    The words are rows of one ragged array (flat symbols and row offsets). A
    round takes each row's lowest-ranked pair, merges it at all its places in
    all rows simultaneously and closes the gaps; rows without a pair leave
    with the length they have.
    """
    left = np.zeros(len(words), np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    sym = vocab.byte_id[flat]
    rows = np.flatnonzero(size)
    size = size[rows]
    start = np.cumsum(size) - size
    last = start + size - 1
    sym[last] = vocab.end_id[flat[last]]
    rank = np.full(sym.size, NO_PAIR, np.int32)
    rank[:-1] = vocab.rank(sym[:-1], sym[1:]) if sym.size else 0
    rank[last] = NO_PAIR
    while rows.size:
        low = np.minimum.reduceat(rank, start)
        over = low == NO_PAIR
        if over.any():
            left[rows[over]] = size[over]
            stay = np.repeat(~over, size)
            sym, rank = sym[stay], rank[stay]
            rows, size, low = rows[~over], size[~over], low[~over]
            if not rows.size:
                break
        place = rank == np.repeat(low, size)
        if (place[1:] & place[:-1]).any():
            # overlapping places of one pair (x x x): every other one of a run, from its left end
            index = np.arange(place.size)
            run_start = np.maximum.accumulate(np.where(place & ~np.append(False, place[:-1]), index, 0))
            place &= (index - run_start) % 2 == 0
        at = np.flatnonzero(place)
        sym[at] = vocab.merged[rank[at]]
        stay = ~np.append(False, place[:-1])
        owner = np.repeat(np.arange(rows.size), size)
        size = size - np.bincount(owner[at], minlength=rows.size)
        sym, rank = sym[stay], rank[stay]
        start = np.cumsum(size) - size
        at -= np.arange(at.size)
        ends = np.zeros(sym.size, bool)
        ends[start + size - 1] = True
        near = np.concatenate((at, at[at > 0] - 1))
        rank[near] = NO_PAIR
        near = near[~ends[near]]
        rank[near] = vocab.rank(sym[near], sym[near + 1])
    return left


class Counts:
    """Token counts of white-space chunks, remembered up to a bound within a Python worker."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.known = vocab, {}

    def of(self, chunks: set[str]) -> dict[str, int]:
        if len(self.known) > CACHE_CHUNKS:
            self.known = {}
        new = [c for c in chunks if c not in self.known]
        if new:
            words = [() if c in self.vocab.special else self.vocab.words(c) for c in new]
            left = survivors(self.vocab, [w.encode() for found in words for w in found])
            ends = np.cumsum([0, *map(len, words)])
            total = np.concatenate(([0], np.cumsum(left)))[ends]
            self.known.update(zip(new, np.diff(total).tolist(), strict=True))
            self.known.update({c: 1 for c in self.vocab.special if c in chunks})
        return self.known


_counts: dict[int, Counts] = {}


def count_tokens(docs: DataFrame, vocabulary_text: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit``).

    NULL text counts as empty (0 bytes, 0 tokens, not over). Special strings
    inside texts are one token each. Only ``doc_id`` and ``text`` are read;
    NULL or repeated ids give their rows like any other. One map, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_text or vocabulary_file())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(shared.value)
        counts = _counts.setdefault(id(vocab), Counts(vocab))
        for batch in batches:
            for start, texts in text_slices(batch, "text"):
                split = [vocab.chunks(text) for text in texts]
                known = counts.of(set().union(*split))
                tokens = [sum([known[c] for c in chunks]) for chunks in split]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(start, len(texts)),
                    pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it exceeds the token limit."""
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLE: dict[str, str] = {}
