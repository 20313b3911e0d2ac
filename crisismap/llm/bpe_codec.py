"""Operator 1: byte-pair encoding of whole texts, and decoding of the ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from crisismap.llm.bpe import Vocabulary
from crisismap.llm.common import table, text_slices

VOCABULARY = "word_bpe_49k.json"
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
_loaded: dict[str, Vocabulary] = {}


def vocabulary(text: str) -> Vocabulary:
    """The parsed vocabulary, once per Python worker."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Vocabulary(text)
    return _loaded[key]


def vocabulary_file(name: str = VOCABULARY) -> str:
    """Contents of a public vocabulary file (read on the driver, a few MB whatever the corpus)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, vocabulary_text: str | None = None, digests: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens``, ``ids`` (binary, little-endian 32-bit), ``decoded``.

    With ``digests`` the ids and the decoded text are given as SHA-256 instead
    (``ids_sha256``, ``decoded_sha256``), so that no token leaves its task.

    NULL text counts as empty: no ids, an empty decoded text. Only ``doc_id``
    and ``text`` are read, whatever other columns are called; a NULL or
    repeated ``doc_id`` gives its row like any other. One map over the rows: no
    shuffle, and a lost executor repeats only its own partitions.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_text or vocabulary_file())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(shared.value)
        for batch in batches:
            for start, texts in text_slices(batch, "text"):
                ids = vocab.encode_batch(texts)
                counts = pa.array([len(i) // 4 for i in ids], pa.int64())
                decoded = [vocab.decode(i) for i in ids]
                if digests:
                    made = [pa.array([hashlib.sha256(x).hexdigest() for x in column], pa.string())
                            for column in (ids, decoded)]
                else:
                    made = [pa.array(ids, pa.binary()), pa.array([d.decode() for d in decoded], pa.string())]
                rows = batch.column("doc_id").slice(start, len(texts))
                names = [field.split()[0] for field in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([rows, counts, *made], names)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    return encode(table(spark, sf_dir, "documents"), digests=True)


QUERIES = {"op1_bpe_codec": op1_bpe_codec}
ORACLE: dict[str, str] = {}
