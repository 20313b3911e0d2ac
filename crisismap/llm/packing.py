"""Operator 10: best-fit packing of documents into token sequences under several capacities."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crisismap.llm.bpe import NEWER
from crisismap.llm.common import stored, table, text_slices

VOCABULARY = "byte_bpe_50k"
END_ID = 2
MAX_TOKENS = 1024
# Pieces of one length that a window task ranks on average if all pieces had that length.
RANKED_TOGETHER = 4_000
SLICE_CHARS = 500_000


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold: tokens, documents, and attention cost (sum of squared piece lengths).

    The defaults of the last two follow from the tokens (each piece has one at
    least), so they steer the choice among bins without costing a sequence.
    """

    tokens: int = MAX_TOKENS
    documents: int = MAX_TOKENS
    attention: int = MAX_TOKENS * MAX_TOKENS


@dataclass(frozen=True)
class Rule:
    """How a bin is chosen: the least weighted norm of what would be left, or the greatest weighted dot product."""

    kind: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.05, 0.25)


PLACEMENT = ("length", "first_rank", "count", "first_bin", "per_bin", "offset")


def plan(lengths: Sequence[int], counts: Sequence[int], capacity: Capacity = Capacity(),
         rule: Rule = Rule()) -> np.ndarray:
    """Vector best-fit decreasing over a histogram of piece lengths: rows of ``PLACEMENT``.

    Bins that have the same residual capacities stand together as one class
    with a count, so the work depends on the number of lengths (at most the
    token capacity), not on the number of pieces. For the pieces of a length,
    longest first, the best class under every constraint takes as many as it
    can hold; new bins open only when no open one fits.
    """
    whole = np.array([capacity.tokens, capacity.documents, capacity.attention], np.int64)
    weights = np.array(rule.weights) / whole.astype(float)  # residuals as shares of the capacity
    left, bins, first = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    opened, out = 0, []
    for length, count in sorted(zip(lengths, counts, strict=True), reverse=True):
        item = np.array([length, 1, length * length], np.int64)
        if (item > whole).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity")
        rank = 0
        while rank < count:
            rest = count - rank
            fits = np.flatnonzero((left >= item).all(axis=1))
            if fits.size:
                if rule.kind == "norm":
                    score = -(((left[fits] - item) * weights) ** 2).sum(axis=1)
                else:
                    score = ((left[fits] * item) * weights**2).sum(axis=1)
                at = int(fits[np.argmax(score)])
            else:
                per_new = int((whole // item).min())
                at = bins.size
                left = np.vstack((left, whole))
                bins, first = np.append(bins, -(-rest // per_new)), np.append(first, opened)
                opened += int(bins[at])
            per_bin = min(int((left[at] // item).min()), rest)
            used = min(int(bins[at]), rest // per_bin)
            out.append((length, rank, used * per_bin, int(first[at]), per_bin, int(whole[0] - left[at, 0])))
            rank += used * per_bin
            after = left[at] - per_bin * item
            if used == bins[at]:
                left[at] = after
            else:
                left, bins, first = np.vstack((left, after)), np.append(bins, used), np.append(first, first[at])
                bins[at] -= used
                first[at] += used
            closed = (left < 1).any(axis=1)
            if closed.any():
                left, bins, first = left[~closed], bins[~closed], first[~closed]
    return np.array(out, np.int64).reshape(-1, len(PLACEMENT))


class Encoder:
    """Byte-level BPE ids; a text that the fast encoder may read otherwise goes to the vocabulary's own library."""

    def __init__(self, ranks_file: bytes, library_file: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_file.splitlines())}
        self.library = Tokenizer.from_str(library_file)
        self.library.no_truncation()
        self.library.no_padding()
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if text.isascii() or not NEWER.search(text):
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except (ValueError, RuntimeError):  # its pattern engine gives up on extreme runs
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[int, Encoder] = {}


def cut(size: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than ``limit``."""
    head = size % limit or limit
    return [(0, head)] + [(at, limit) for at in range(head, size, limit)]


def pieces(docs: DataFrame, limit: int = MAX_TOKENS, with_ids: bool = False, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token pieces of every document: row, doc_id, piece, start, length, ids_crc32 (and ids, if wanted)."""
    import public_tokenizers

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as ranks, \
            open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as library:
        files = docs.sparkSession.sparkContext.broadcast((ranks.read(), library.read(), public_tokenizers.PATTERN))
    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"][:7 if with_ids else 6]
    schema = ", ".join(f"{n} {({'ids': 'binary', 'piece': 'int'}).get(n, 'long')}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = files._jbroadcast.id() if hasattr(files, "_jbroadcast") and files._jbroadcast else id(files.value)
        encoder = _encoders.get(key) or _encoders.setdefault(key, Encoder(*files.value))
        for batch in batches:
            for start, texts in text_slices(batch, "text", SLICE_CHARS):
                rows = batch.column("row").slice(start, len(texts)).to_pylist()
                doc_ids = batch.column("doc_id").slice(start, len(texts)).to_pylist()
                out = []
                for row, doc_id, text in zip(rows, doc_ids, texts, strict=True):
                    raw = np.append(encoder.ids(text), END_ID).astype("<u4").tobytes()
                    for i, (at, n) in enumerate(cut(len(raw) // 4, limit)):
                        part = raw[4 * at:4 * (at + n)]
                        out.append((row, doc_id, i, at, n, zlib.crc32(part), part)[:len(names)])
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds)], names)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema))


def _ranked(parts: DataFrame, total: int) -> DataFrame:
    """``rank`` of each piece among all pieces of its length, from 0.

    A hash of the piece deals each length into buckets, however many pieces
    have it; a bucket's first rank is the count of the buckets before it.
    """
    buckets = max(64, -(-total // RANKED_TOGETHER))
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(
        Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row", "piece"))
    return (dealt.withColumn("own", own).join(before.drop("n"), ["length", "bucket"])
            .withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("own") - 1).drop("bucket", "own", "before"))


def pack(docs: DataFrame, capacity: Capacity = Capacity(), rule: Rule = Rule(), with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    A document is its ids and then ``END_ID``; only longer ones than the token
    capacity are cut, into full pieces but for the first. NULL text counts as
    empty (one piece of one token). NULL and repeated ids, ties and other
    columns change nothing; an empty table gives no rows.

    Tokens are made once, in a map, and written; only lengths matter from
    there on. Their histogram (at most one row per length) is all that reaches
    the driver, and the plan made of it is as bounded, so the packing is that of
    one global best-fit over all pieces, whatever their number and partitions.
    """
    parts = stored(pieces(docs, capacity.tokens, with_ids), "packing-pieces")
    sizes = [(r["length"], r["n"]) for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()]
    placed = plan([s for s, _ in sizes], [n for _, n in sizes], capacity, rule)
    placed = placed[np.lexsort((placed[:, 1], placed[:, 0]))] if placed.size else placed
    key = placed[:, 0] << 48 | placed[:, 1]  # length, first rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            at = placed[np.searchsorted(key, length << 48 | rank, "right") - 1]
            turn = rank - at[:, 1]
            made = [pa.array(at[:, 3] + turn // at[:, 4]), pa.array(at[:, 5] + turn % at[:, 4] * length)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, [*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = _ranked(parts, sum(n for _, n in sizes)).select(*kept, "rank")
    types = dict(parts.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of every document."""
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op10_packing": op10_packing}
ORACLE: dict[str, str] = {}
