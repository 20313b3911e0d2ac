"""Operator 5: language identification by unigram pieces, marginalised over all segmentations."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from crisismap.llm.common import stored, table, text_slices, with_text_columns

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN = 0
# The mark that begins a word in the vocabulary.
BOUNDARY = "▁"
LONGEST_PIECE = 16
EM_ROUNDS = 3
# Added to the expected count of every piece.
SMOOTHING = 0.05
CACHE_WORDS = 300_000
CACHE_CHARS = 20_000_000
BATCH_WORDS = 8_000
BATCH_CHARS = 320_000
BATCH_ENTRIES = 1_000_000
COUNTED_WORDS = 200_000
HOLDOUT_MOD, HOLDOUT_REST = 3, 1
UNDETERMINED = "und"
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def read_pieces(name: str = VOCABULARY) -> list[str]:
    """The fixed public vocabulary, by id."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    return [model.id_to_piece(i) for i in range(model.get_piece_size())]


def words(text: str) -> list[str]:
    """Lower-case words: runs of letters and their marks."""
    return WORD.findall(text.lower())


class Pieces:
    """The vocabulary's pieces in an open-addressed table of polynomial hashes, looked up by whole arrays."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    BITS = 20

    def __init__(self, pieces: Sequence[str]):
        self.size = len(pieces)
        self.keys = np.zeros(1 << self.BITS, np.uint64)
        self.ids = np.full(1 << self.BITS, -1, np.int32)
        for i, piece in enumerate(pieces):
            if 0 < len(piece) <= LONGEST_PIECE:
                key = 0
                for c in piece:
                    key = (key * int(self.BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                slot = self._slot(key)
                while self.ids[slot] >= 0:
                    slot = slot + 1 & (1 << self.BITS) - 1
                self.keys[slot], self.ids[slot] = key, i

    @classmethod
    def _slot(cls, key):
        if isinstance(key, int):
            return (key * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 64 - cls.BITS
        return ((key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - cls.BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 where there is none."""
        slot = self._slot(keys)
        found = self.ids[slot]
        wrong = np.flatnonzero((found >= 0) & (self.keys[slot] != keys))
        while wrong.size:
            slot[wrong] = slot[wrong] + 1 & (1 << self.BITS) - 1
            found[wrong] = self.ids[slot[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[slot[wrong]] != keys[wrong])]
        return found


class Lattice:
    """Every way to cut some words into pieces, whatever their length.

    ``edges`` has, for each place and length at which any word has a piece, the
    words that have one there and their pieces. A character that is no piece is the
    unknown one, so every word can be cut. Sums go from left to right in spans as long as the longest piece: a
    window of two spans holds all that a piece can reach, and is scaled after each span, so
    nothing is lost to underflow in a run of any length. Shorter words are filled up with
    a character that no piece has; edges of one block of places are held at a time.
    """

    def __init__(self, texts: Sequence[str], pieces: Pieces):
        self.pieces, self.words = pieces, len(texts)
        self.lengths = np.fromiter(map(len, texts), np.int64, self.words)
        self.length = int(self.lengths.max())
        codes = np.zeros((self.words, self.length + LONGEST_PIECE), np.uint64)
        codes[np.arange(codes.shape[1]) < self.lengths[:, None]] = np.frombuffer(
            "".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.codes = np.ascontiguousarray(codes.T)
        self.spans = -(-self.length // LONGEST_PIECE)
        self.window = min(2 * LONGEST_PIECE, self.length + 1)
        self.block = max(1, BATCH_CHARS // self.words // LONGEST_PIECE)  # spans
        self.held: tuple[int, list] = (-1, [])

    def edges(self, span: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, words, pieces) of a span by place from its start."""
        if self.held[0] != span // self.block:
            self.held = (span // self.block, self._edges(span // self.block))
        return self.held[1][span % self.block]

    def _edges(self, block: int) -> list[list[tuple[int, int, np.ndarray, np.ndarray]]]:
        first = block * self.block * LONGEST_PIECE
        places = min(self.block * LONGEST_PIECE, self.length - first)
        at: list[list] = [[] for _ in range(places)]
        key = np.zeros((places, self.words), np.uint64)
        for size in range(1, min(LONGEST_PIECE, self.length - first) + 1):
            fit = min(places, self.length - first - size + 1)
            key = key[:fit] * Pieces.BASE + self.codes[first + size - 1:first + size - 1 + fit]
            found = self.pieces.find(key.ravel()).reshape(key.shape)
            if size == 1:
                found = np.where(found < 0, UNKNOWN, found)
            place, row = np.nonzero(found >= 0)
            piece, bounds = found[place, row], np.searchsorted(place, np.arange(fit + 1)).tolist()
            for i in range(fit):
                if bounds[i] < bounds[i + 1]:
                    here, some = i % LONGEST_PIECE, slice(bounds[i], bounds[i + 1])
                    at[i].append((here, here + size, row[some], piece[some]))
        return [[e for edges in at[i:i + LONGEST_PIECE] for e in edges] for i in range(0, places, LONGEST_PIECE)]

    def _ending(self, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Words that end in a span, and at which of its places (from 1)."""
        end = self.lengths - span * LONGEST_PIECE
        rows = np.flatnonzero((end > 0) & (end <= LONGEST_PIECE))
        return rows, end[rows]

    def log_forward(self, probability: np.ndarray) -> np.ndarray:
        """Of each word and language, the log of the total probability of all cuts (``probability``: pieces by
        languages)."""
        out, scales = np.zeros((2, self.words, probability.shape[1]))
        value = np.zeros((self.window, self.words, probability.shape[1]))
        value[0] = 1.0
        for span in range(self.spans):
            for i, j, rows, found in self.edges(span):  # in order of i, so value[i] is complete
                if rows.size == self.words:
                    value[j] += value[i] * probability[found]
                else:
                    value[j][rows] += value[i][rows] * probability[found]
            rows, end = self._ending(span)
            with np.errstate(divide="ignore"):  # a model may rule a word out
                out[rows] = scales[rows] + np.log(value[end, rows])
            if span + 1 < self.spans:
                scales += np.log(_shift(value, value[LONGEST_PIECE:].max(axis=0)))
        return out

    def forward(self, probability: np.ndarray) -> np.ndarray:
        """Of each word and language, the total probability of all cuts."""
        return np.exp(self.log_forward(probability))

    def expected(self, probability: np.ndarray, language: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> None:
        """Add to ``counts`` (pieces by languages) how often each piece is used, if word w of a language occurs
        ``weight`` times."""
        value = np.zeros((self.window, self.words))
        value[0] = 1.0
        entered, ahead = [], []  # of each span, what came from those before, and all
        for span in range(self.spans):
            entered.append(value[:LONGEST_PIECE].copy())
            for i, j, rows, found in self.edges(span):
                value[j][rows] += value[i][rows] * probability[found, language[rows]]
            ahead.append(value[:LONGEST_PIECE].copy())
            if span + 1 < self.spans:
                _shift(value, value[LONGEST_PIECE:].max(axis=0))
        behind = np.zeros((self.window, self.words))
        where, used, held = [], [], 0
        for span in reversed(range(self.spans)):
            rows, end = self._ending(span)
            behind[end, rows] = 1.0
            flows = []
            for i, j, rows, found in reversed(self.edges(span)):
                flow = probability[found, language[rows]] * behind[j][rows]
                behind[i][rows] += flow
                flows.append((found * counts.shape[1] + language[rows], ahead[span][i][rows] * flow, rows))
            # every cut crosses the start of the span by one piece, so this is the total in the units of this span
            total = (entered[span] * behind[:LONGEST_PIECE]).sum(axis=0)
            scale = np.divide(weight, total, out=np.zeros(self.words), where=total > 0)
            for number, flow, rows in flows:
                where.append(number)
                used.append(flow * scale[rows])
                held += rows.size
            if span:
                after = behind[:self.window - LONGEST_PIECE] / np.where(behind[0] > 0, behind[0], 1.0)
                behind[:LONGEST_PIECE] = 0.0
                behind[LONGEST_PIECE:] = after
            if held > BATCH_ENTRIES or span == 0:
                counts += np.bincount(np.concatenate(where), np.concatenate(used), counts.size).reshape(counts.shape)
                where, used, held = [], [], 0


def _shift(value: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Move a window on by a span, divided by ``scale`` (1 where that is zero), which is returned."""
    scale = np.where(scale > 0, scale, 1.0)
    rest = value[LONGEST_PIECE:] / scale
    value[:] = 0.0
    value[:len(rest)] = rest
    return scale


def by_length(texts: Sequence[str]) -> Iterator[list[int]]:
    """Places of texts of about one length (up to an eighth more), in batches of bounded size or of one text."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    at = 0
    while at < len(order):
        stop, longest = at, len(texts[order[at]]) * 9 // 8
        while (stop < len(order) and len(texts[order[stop]]) <= longest
               and (stop == at or (stop - at < BATCH_WORDS and (stop - at) * len(texts[order[stop]]) < BATCH_CHARS))):
            stop += 1
        yield order[at:stop]
        at = stop


@dataclass
class Model:
    """Piece probabilities of each language (pieces by languages) and the languages' shares."""

    pieces: list[str]
    languages: list[str]
    probability: np.ndarray
    prior: np.ndarray

    def __post_init__(self):
        self.found = Pieces(self.pieces)
        self.rows: dict[str, int] = {}
        self.chars = 0
        self.logs = np.zeros((0, len(self.languages)))

    def _learn_words(self, new: list[str]) -> None:
        marked = [BOUNDARY + w for w in new]
        logs = np.empty((len(new), len(self.languages)))
        for chosen in by_length(marked):
            logs[chosen] = Lattice([marked[i] for i in chosen], self.found).log_forward(self.probability)
        self.rows.update(zip(new, range(len(self.logs), len(self.logs) + len(new)), strict=True))
        self.logs = np.vstack((self.logs, logs))
        self.chars += sum(map(len, new))

    def log_likelihoods(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, the log probability in each language, and its number of words."""
        split = [words(text) for text in texts]
        if len(self.rows) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.rows, self.logs, self.chars = {}, np.zeros((0, len(self.languages))), 0
        new = [w for w in set().union(*split) if w not in self.rows]
        if new:
            self._learn_words(new)
        rows = self.rows
        out = np.zeros((len(texts), len(self.languages)))
        for i, one in enumerate(split):
            if one:
                out[i] = self.logs[[rows[w] for w in one]].sum(axis=0)
        return out, np.fromiter(map(len, split), np.int64, len(split))

    def predict(self, texts: Sequence[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior probability."""
        logs, counts = self.log_likelihoods(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        logs = logs + np.log(self.prior)
        best = logs.argmax(axis=1)
        share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        known = counts > 0
        return ([self.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist(), strict=True)],
                np.where(known, share, 0.0))


def held_out() -> F.Column:
    """Rows never learned from; a row without an id isn't held out."""
    rest = F.crc32(F.col("doc_id").cast("string")) % HOLDOUT_MOD
    return F.coalesce(rest == HOLDOUT_REST, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over whole texts with a language; counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, have in counts.items():
                items = list(have.items())
                for at in range(0, len(items), 50_000):
                    some = items[at:at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some)), pa.array([w for w, _ in some]),
                         pa.array([n for _, n in some], pa.int64())], ["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for start, texts in text_slices(batch, "text"):
                for lang, text in zip(langs[start:start + len(texts)], texts, strict=True):
                    counts.setdefault(lang, Counter()).update(words(text))
                if sum(map(len, counts.values())) > COUNTED_WORDS:
                    yield from flush()
        yield from flush()

    return (docs.where("lang is not null").select("lang", "text").mapInArrow(run, "lang string, word string, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


def train(docs: DataFrame, rounds: int = EM_ROUNDS, pieces: list[str] | None = None) -> Model:
    """Piece probabilities by expectation-maximisation over all words of all given documents.

    Every round sums, over all segmentations of every distinct word, how often
    each piece is expected in each language. What returns to the driver is a
    count for each piece of the fixed vocabulary and each language.
    """
    spark = docs.sparkSession
    pieces = pieces or read_pieces()
    counts = stored(word_counts(docs), "language-words")
    shares = {r["lang"]: r["n"] for r in docs.where("lang is not null").groupBy("lang").agg(
        F.count("*").alias("n")).collect()}
    languages = sorted(shares)
    prior = np.array([shares[x] for x in languages], float)
    start = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    model = Model(pieces, languages, start, (prior + 1) / (prior + 1).sum())
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast((pieces, languages, model.probability.astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocabulary, langs, probability = shared.value
            found, number = Pieces(vocabulary), {x: i for i, x in enumerate(langs)}
            total = np.zeros(probability.shape)
            probability = probability.astype(float)
            for batch in batches:
                rows = [(BOUNDARY + word, number[lang], n) for lang, word, n in zip(*(
                    batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True)]
                for chosen in by_length([r[0] for r in rows]):
                    texts, lang, n = zip(*[rows[i] for i in chosen], strict=True)
                    Lattice(texts, found).expected(probability, np.array(lang), np.array(n, float), total)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()),
                                              pa.array(total[piece, lang])], ["piece", "lang", "n"])

        sums = (counts.mapInArrow(run, "piece int, lang int, n double").groupBy("piece", "lang")
                .agg(F.sum("n").alias("n")).toArrow())
        fresh = np.full(model.probability.shape, SMOOTHING)
        fresh[sums["piece"].to_numpy(), sums["lang"].to_numpy()] += sums["n"].to_numpy()
        model = Model(pieces, languages, fresh / fresh.sum(axis=0), model.prior)
        shared.unpersist()
    return model


def identify(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the likeliest language and its posterior, from the text alone; other columns are kept.

    NULL texts, empty ones and those without a letter get ``und`` and score 0;
    so does every text if no language was learned. Runs of letters of any length are summed
    whole. Of languages equally likely the first by name is taken. Columns called like the new
    ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.pieces, model.languages, model.probability, model.prior))
    mark = uuid.uuid4().hex

    def make(slices: Iterator[list[str]]) -> Iterator[list[pa.Array]]:
        if _loaded.get("mark") != mark:
            _loaded.update(mark=mark, model=Model(*shared.value))
        for texts in slices:
            found, share = _loaded["model"].predict(texts)
            yield [pa.array(found, pa.string()), pa.array(share, pa.float64())]

    return with_text_columns(docs, [StructField(names[0], StringType()), StructField(names[1], DoubleType())], make)


_loaded: dict = {}


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()).select("lang", "text"))
    return identify(docs.select("doc_id", "text"), model).select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
ORACLE: dict[str, str] = {}
