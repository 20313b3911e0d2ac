"""Operator 9: toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from crisismap.llm.common import own_columns, table, text_slices, with_text_columns

# The classifier is fitted on at most so many labelled documents, those of the smallest id hashes.
SAMPLE_DOCS = 20_000
HASH_BITS = 20
# Least z-score of a term that tells the classes apart alone, and of a pair of words that does beside such terms.
LEAST_Z = 2.5
LEAST_PAIR_Z = 4.0
# A document whose cross-fitted score is off by so much isn't explained by single terms; it proposes pairs.
UNEXPLAINED = 0.05
PAIR_BITS = 24
FACTORS = 8
EPOCHS = 40
BATCH = 512
RATE = 0.1
SHRINK = 1e-4
PREDICT_AT = 0.3
CACHE_WORDS = 400_000
HOLDOUT_MOD, HOLDOUT_REST = 4, 2
WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> tuple[int, ...]:
    """Hashed terms of a word: itself and its beginnings, which cover words that were never seen whole."""
    mask = (1 << HASH_BITS) - 1
    heads = {f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n}
    return tuple(zlib.crc32(term.encode()) & mask for term in (word, *sorted(heads)))


def words(text: str) -> set[str]:
    """Distinct lower-case words of a text."""
    return set(WORD.findall(text.lower()))


@dataclass
class Model:
    """logit = bias + sum of w + half of (squared sum of v - sum of squared v), over the terms present."""

    terms: np.ndarray  # sorted hashed terms that have weights
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def __post_init__(self):
        self.place = {t: i for i, t in enumerate(self.terms.tolist())}
        self.cache: dict[str, tuple[int, ...]] = {}

    def places(self) -> np.ndarray:
        """Place of each hashed term, -1 where it has no weights."""
        place = np.full(1 << HASH_BITS, -1)
        place[self.terms] = np.arange(self.terms.size)
        return place

    def active(self, text: str) -> list[int]:
        """Places of the model's terms that a text has, each once."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache, out = self.cache, set()
        for word in words(text):
            have = cache.get(word)
            if have is None:
                have = cache[word] = tuple(self.place[t] for t in word_terms(word) if t in self.place)
            if have:
                out.update(have)
        return sorted(out)

    def scores(self, texts: Iterable[str]) -> np.ndarray:
        found = [self.active(text) for text in texts]
        return _sigmoid(_logits(self, *_flat(found))[0])


def _flat(found: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, found), np.int64, len(found))
    ids = np.concatenate([np.asarray(one, np.int64) for one in found]) if len(found) else np.zeros(0, np.int64)
    return ids, counts


def _logits(model: Model, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    doc = np.repeat(np.arange(counts.size), counts)
    v = model.factors[ids]
    linear = np.bincount(doc, model.weights[ids], counts.size)
    total = np.stack([np.bincount(doc, v[:, k], counts.size) for k in range(v.shape[1])], axis=1)
    square = np.bincount(doc, (v * v).sum(axis=1), counts.size)
    return model.bias + linear + 0.5 * ((total * total).sum(axis=1) - square), total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def screened(terms: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Sorted terms whose presence tells the classes apart, by the z-score of their log odds."""
    size = 1 << HASH_BITS
    n1, n0 = np.zeros(size), np.zeros(size)
    for one, label in zip(terms, labels, strict=True):
        (n1 if label else n0)[one] += 1
    d1, d0 = labels.sum() + 1.0, (1 - labels).sum() + 1.0
    a, b = n1 + 0.5, n0 + 0.5
    z = np.abs(np.log(a / d1) - np.log(b / d0)) / np.sqrt(1 / a + 1 / b)
    z[n1 + n0 < 2] = 0
    return np.flatnonzero(z > LEAST_Z)


def _pairs(hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of every unordered pair of an array, in slices of bounded size: each place with those after it in a ring."""
    n = hashes.size
    place = np.arange(n)
    step = max(1, (1 << 22) // max(n, 1))
    for at in range(1, (n - 1) // 2 + 1, step):
        shifts = np.arange(at, min(at + step, (n - 1) // 2 + 1))
        yield np.tile(place, shifts.size), ((place[None, :] + shifts[:, None]) % n).ravel()
    if n and n % 2 == 0:
        yield place[:n // 2], place[n // 2:]


def paired(words: list[np.ndarray], error: np.ndarray) -> np.ndarray:
    """Sorted words of the pairs whose presence goes with the errors that single terms leave, whatever each shows alone.

    Pairs of the unexplained documents add their errors up in hashed buckets; the
    pairs in buckets that stand out are then summed by themselves, over all documents.
    A pair's z-score is its sum of errors by the root of its sum of squared errors.
    """
    open_docs = [i for i in np.flatnonzero(np.abs(error) > UNEXPLAINED) if words[i].size > 1]
    if not open_docs:
        return np.zeros(0, np.int64)
    # a pair needs LEAST_PAIR_Z squared documents at least, and so does each of its words
    least = LEAST_PAIR_Z * LEAST_PAIR_Z
    often = np.flatnonzero(np.bincount(np.concatenate([words[i] for i in open_docs]), minlength=1 << HASH_BITS) >= least)
    usual = np.zeros(1 << HASH_BITS, bool)
    usual[often] = True
    mixed = np.random.default_rng(11).integers(0, 1 << PAIR_BITS, 1 << HASH_BITS, dtype=np.int32)
    mask = (1 << PAIR_BITS) - 1
    sums, squares = np.zeros((2, 1 << PAIR_BITS), np.float32)
    own = {i: words[i][usual[words[i]]] for i in open_docs}
    for i, one in own.items():
        hashes = mixed[one]
        for a, b in _pairs(one):
            bucket = (hashes[a] + hashes[b]) & mask
            sums[bucket] += error[i]
            squares[bucket] += error[i] ** 2
    stands_out = np.abs(sums) > LEAST_PAIR_Z * np.sqrt(np.maximum(squares, 1e-9))
    found: set[int] = set()
    for i, one in own.items():
        hashes = mixed[one]
        for a, b in _pairs(one):
            hit = np.flatnonzero(stands_out[(hashes[a] + hashes[b]) & mask])
            x, y = one[a[hit]].astype(np.int64), one[b[hit]].astype(np.int64)
            found.update(((np.minimum(x, y) << HASH_BITS) | np.maximum(x, y)).tolist())
    pairs = np.array(sorted(found), np.int64)
    usual[:] = False
    usual[pairs >> HASH_BITS] = usual[pairs & ((1 << HASH_BITS) - 1)] = True
    sums, squares = np.zeros((2, pairs.size))
    for one, off in zip(words, error, strict=True):
        one = one[usual[one]].astype(np.int64)
        for a, b in _pairs(one):
            pair = (np.minimum(one[a], one[b]) << HASH_BITS) | np.maximum(one[a], one[b])
            at = np.minimum(np.searchsorted(pairs, pair), pairs.size - 1)
            at = at[pairs[at] == pair]
            sums[at] += off
            squares[at] += off * off
    pairs = pairs[np.abs(sums) > LEAST_PAIR_Z * np.sqrt(np.maximum(squares, 1e-9))]
    return np.unique(np.concatenate((pairs >> HASH_BITS, pairs & ((1 << HASH_BITS) - 1))))


def fit(terms: list[np.ndarray], labels: np.ndarray, words: list[np.ndarray] | None = None) -> Model:
    """A factorization machine of the terms that tell the classes apart, alone or by a pair of ``words`` (else of terms).

    For the pairs, each half of the documents is scored by a model of the other
    half's single terms, so that the errors are those of unseen documents. The words
    of pairs are first fitted on top of those scores; from there all terms are.
    """
    kept, start = screened(terms, labels), None
    half = np.arange(labels.size) % 2
    if labels.size > 1:
        logit = np.zeros(labels.size)
        for part in (0, 1):
            learn, apart = np.flatnonzero(half != part), np.flatnonzero(half == part)
            seen = [terms[i] for i in learn]
            model = _fitted(seen, labels[learn], screened(seen, labels[learn]))
            place = model.places()
            found = [at[at >= 0] for at in (place[terms[i]] for i in apart)]
            logit[apart] = _logits(model, *_flat(found))[0]
        pairs = paired(terms if words is None else words, _sigmoid(logit) - labels)
        if pairs.size:
            start = _fitted(terms, labels, pairs, logit)
            kept = np.union1d(kept, pairs)
    return _fitted(terms, labels, kept, None, start)


def _fitted(terms: list[np.ndarray], labels: np.ndarray, kept: np.ndarray, given: np.ndarray | None = None,
            start: Model | None = None) -> Model:
    """Logistic loss, minimised by adaptive gradient steps over shuffled batches; the same data give the same model.

    ``given`` is a logit that each document has beside the model's, ``start`` a model of some of the terms.
    """
    rng = np.random.default_rng(7)
    share = (labels.sum() + 0.5) / (labels.size + 1.0)
    model = Model(kept, np.zeros(kept.size), rng.normal(0, 0.05, (kept.size, FACTORS)), float(np.log(share / (1 - share))))
    if given is not None:
        model.bias = 0.0
    if start is not None:
        at = np.searchsorted(kept, start.terms)
        model.weights[at], model.factors[at] = start.weights, start.factors
    place = model.places()
    found = [at[at >= 0] for at in (place[one] for one in terms)]
    sw, sv, sb = np.full(kept.size, 1e-6), np.full((kept.size, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS if labels.size else 0):
        order = rng.permutation(labels.size)
        for at in range(0, order.size, BATCH):
            batch = order[at:at + BATCH]
            ids, counts = _flat([found[i] for i in batch])
            logit, total = _logits(model, ids, counts)
            if given is not None:
                logit = logit + given[batch]
            error = _sigmoid(logit) - labels[batch]
            doc = np.repeat(np.arange(counts.size), counts)
            if ids.size:
                used, where = np.unique(ids, return_inverse=True)
                gw = np.bincount(where, error[doc], used.size) + SHRINK * model.weights[used]
                each = error[doc, None] * (total[doc] - model.factors[ids])
                gv = np.stack([np.bincount(where, each[:, k], used.size) for k in range(FACTORS)], axis=1)
                gv += SHRINK * model.factors[used]
                sw[used] += gw * gw
                sv[used] += gv * gv
                model.weights[used] -= RATE * gw / np.sqrt(sw[used])
                model.factors[used] -= RATE * 0.3 * gv / np.sqrt(sv[used])
            gb = error.sum()
            sb += gb * gb
            model.bias -= RATE * gb / np.sqrt(sb)
    return model


def held_out() -> F.Column:
    """Rows that are never learned from; a row without an id isn't held out (and has no label)."""
    rest = F.crc32(F.col("doc_id").cast("string")) % HOLDOUT_MOD
    return F.coalesce(rest == HOLDOUT_REST, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on labelled rows that aren't held out: at most ``sample_docs`` documents, chosen by a hash of their ids.

    The chosen ids are few by that bound, so they are broadcast and no text is
    shuffled but the sample's. One task fits the model on the sample's terms.
    """
    known = (labels.where("toxic is not null and doc_id is not null").where(~held_out())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))
    sample = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
              .join(F.broadcast(known.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")), "doc_id"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch, "text"):
                each = [[word_terms(w) for w in words(x)] for x in texts]
                terms = [np.unique(np.fromiter((t for w in one for t in w), np.int32)).tobytes() for one in each]
                whole = [np.unique(np.fromiter((w[0] for w in one), np.int32)).tobytes() for one in each]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, len(texts)),
                     batch.column("toxic").slice(start, len(texts)).cast(pa.int32()),
                     pa.array(terms, pa.binary()), pa.array(whole, pa.binary())], ["doc_id", "toxic", "terms", "words"])

    one_each = sample.mapInArrow(extract, "doc_id long, toxic int, terms binary, words binary").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.min(F.struct("terms", "words")).alias("found")).select("doc_id", "toxic", "found.*")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "terms", "words")), strict=True)
        rows.sort(key=lambda row: row[0])
        model = fit([np.frombuffer(r[2], np.int32) for r in rows], np.array([r[1] > 0 for r in rows], float),
                    [np.frombuffer(r[3], np.int32) for r in rows])
        yield pa.RecordBatch.from_arrays([
            pa.array([x], pa.binary()) for x in (model.terms.astype(np.int64).tobytes(), model.weights.tobytes(),
                                                 model.factors.tobytes(), np.array([model.bias]).tobytes())],
            ["terms", "weights", "factors", "bias"])

    made = one_each.repartition(1).mapInArrow(learn, "terms binary, weights binary, factors binary, bias binary").first()
    if made is None:  # no labelled row at all
        return fit([], np.zeros(0))
    return Model(np.frombuffer(made["terms"], np.int64), np.frombuffer(made["weights"]),
                 np.frombuffer(made["factors"]).reshape(-1, FACTORS), float(np.frombuffer(made["bias"])[0]))


def score(docs: DataFrame, model: Model, threshold: float = PREDICT_AT,
          names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with two more columns, the score (0 to 1) and the prediction, each from the text alone.

    NULL and empty texts have no terms and get the model's base score. Columns
    of ``docs`` that are called like the new ones are replaced; others are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.weights, model.factors, model.bias))
    loaded: dict[str, Model] = {}

    def make(slices: Iterator[list[str]]) -> Iterator[list[pa.Array]]:
        if not loaded:
            loaded["model"] = Model(*shared.value)
        for texts in slices:
            scores = loaded["model"].scores(texts)
            yield [pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))]

    return with_text_columns(docs, [StructField(names[0], DoubleType()), StructField(names[1], IntegerType())], make)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = PREDICT_AT) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their columns unchanged."""
    names = tuple(f"{n}_{uuid.uuid4().hex}" for n in ("score", "predicted"))  # clash with no column
    return score(docs, train(docs, labels), threshold, names).where(f"`{names[1]}` = 0").select(*own_columns(docs))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE: dict[str, str] = {}
