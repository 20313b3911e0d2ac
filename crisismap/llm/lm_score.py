"""Operator 6: language-model scores from a hashed maximum-entropy model with class-factored softmax."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crisismap.llm.common import stored, table, text_slices

HOLDOUT_MOD, HOLDOUT_REST = 10, 0
ADDED = 0.1
END = b""  # no word is empty
# A chunk of documents shares one dictionary; it ends at so many distinct words or tokens.
CHUNK_WORDS, CHUNK_TOKENS = 250_000, 1_500_000
# Output classes: FREQUENT of WIDTH frequent words each, then one for each shape that other words have.
FREQUENT, WIDTH, SHAPES = 16, 16, 16
CLASSES = FREQUENT + SHAPES
ROW_BITS = 14
ROWS = 1 << ROW_BITS
# Rounds at least; more learners make more of them. A learner takes about so many tokens a round.
ROUNDS = 2
LEARNER_TOKENS = 2_000_000
BATCH = 16384
PART = 4096  # tokens of a score in work at once
SHORT_RUN = 8
RATE = 0.5
LARGEST = 6.0
BLOCK = 1 << 11  # rows
# All other words are told apart by a tree over the bits of their hashes, one for each shape. Counts by the first bits
# go to all tasks, those further down come with the words. Weights of (context, node) are hashed to so many places.
HASH_BITS, TOP_BITS, NODE_BITS = 32, 16, 18
TOPS, NODES = 1 << TOP_BITS, 1 << NODE_BITS
START_HASH = 0x9E3779B1


def tokens(text: str) -> list[bytes]:
    """Words with A-Z lowered, cut at U+0020 and U+0009 to U+000D, and then the end."""
    words = text.encode().lower().split()
    words.append(END)
    return words


class Numbers(dict):
    """Numbers of words by their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def shape(word: bytes) -> int:
    """Class of a word that isn't frequent, from its bytes alone: ending, alphabet and length."""
    last = word[-1:]
    ending = 0 if last.isalpha() or last >= b"\x80" else 1 if last in b".!?" else 2
    if ending == 0 and any(48 <= b < 58 for b in word):
        ending = 3
    return ending * 4 + (0 if word.isascii() else 2) + (len(word) > 8)


def word_hash(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word)


def held_out() -> F.Column:
    """Rows never learned from; a row without an id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HOLDOUT_MOD == HOLDOUT_REST, F.lit(False))


def _mix(value: np.ndarray, factor: int) -> np.ndarray:
    """Rows of the weight table that hashed features fall on."""
    value = (value ^ (value >> np.uint64(15))) * np.uint64(factor)
    value ^= value >> np.uint64(29)
    return ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - ROW_BITS)).astype(np.uint16)


def _mix64(value: np.ndarray, factor: int) -> np.ndarray:
    value = (value + np.uint64(factor)) * np.uint64(0x9E3779B97F4A7C15)
    return (value ^ (value >> np.uint64(32))) * np.uint64(factor)


def _log_mass(tokens: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Log of the smoothed count of a part of a class: one more place stands for all its unseen words."""
    return np.log(tokens + ADDED * (words + 1))


def contexts(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word before and of the one before that; ``first`` marks the beginnings of documents."""
    one, two = np.roll(hashes, 1), np.roll(hashes, 2)
    one[first] = START_HASH
    two[first] = START_HASH
    second = first + 1
    second = second[second < hashes.size]
    two[second] = START_HASH
    return one.astype(np.uint64), two.astype(np.uint64)


@dataclass
class Paths:
    """Ways of a chunk's words down the trees of their shapes, one after another; frequent words have no steps."""

    starts: np.ndarray
    sizes: np.ndarray
    nodes: np.ndarray  # hash of each step's node
    bias: np.ndarray  # log odds of a right turn there, from counts
    sign: np.ndarray  # 1 for a right turn, -1 for a left one

    def steps(self, one: np.ndarray, two: np.ndarray, words: np.ndarray) -> tuple:
        """Of some tokens' steps: where each token's begin, places of the two weights, bias and sign."""
        sizes = self.sizes[words]
        begins = np.cumsum(sizes) - sizes
        at = _runs(self.starts[words], sizes)
        node = self.nodes[at]
        places = []
        for x, factor in ((one, 0xD6E8FEB86659FD93), (two, 0xA0761D6478BD642F)):
            place = np.repeat(_mix64(x, factor), sizes)
            place ^= node
            place *= np.uint64(0x9E3779B97F4A7C15)
            place >>= np.uint64(64 - NODE_BITS)
            places.append(place.view(np.int64))
        return begins, places, self.bias[at], self.sign[at]


@dataclass
class Model:
    """Weights of class logits, of word logits within a frequent class and of turns to all other words.

    A feature (the previous word; the word before it, skipping the previous)
    is hashed to a row of ``outer``, with a weight for each class; with the class,
    to a row of ``inner``, with a weight for each word of the class. Rows are kept as
    exponentials too, so that a token's probabilities are products of its rows. A class
    by shape has any number of words: they hang on a binary tree, and with a node of it the
    feature is hashed to a weight of ``nodes``, for the right turn there.
    """

    outer: np.ndarray
    inner: np.ndarray
    class_bias: np.ndarray
    word_bias: np.ndarray
    nodes: np.ndarray | None = None

    def __post_init__(self):
        if self.nodes is None:
            self.nodes = np.zeros(NODES, np.float32)
        self.outer_x, self.inner_x = np.exp(self.outer), np.exp(self.inner)
        self.class_x, self.word_x = np.exp(self.class_bias), np.exp(self.word_bias)

    @classmethod
    def start(cls, class_counts: np.ndarray, word_counts: np.ndarray) -> Model:
        """No feature has weight yet: the logs of the smoothed counts alone."""
        class_bias = np.log((class_counts + ADDED) / (class_counts.sum() + ADDED * CLASSES))
        share = word_counts / np.maximum(word_counts.sum(axis=1, keepdims=True), 1)
        word_bias = np.where(word_counts > 0, np.log(np.maximum(share, 1e-30)), -80.0)
        return cls(np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, WIDTH), np.float32),
                   class_bias.astype(np.float32), word_bias.astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate((self.outer.ravel(), self.inner.ravel(), self.class_bias, self.word_bias.ravel(), self.nodes))

    @classmethod
    def of(cls, flat: np.ndarray) -> Model:
        a, b = ROWS * CLASSES, ROWS * (CLASSES + WIDTH)
        c = b + CLASSES + FREQUENT * WIDTH
        return cls(flat[:a].reshape(ROWS, CLASSES).copy(), flat[a:b].reshape(ROWS, WIDTH).copy(),
                   flat[b:b + CLASSES].copy(), flat[b + CLASSES:c].reshape(FREQUENT, WIDTH).copy(), flat[c:].copy())

    @staticmethod
    def outer_rows(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _mix(one, 0xD6E8FEB86659FD93), _mix(two, 0xA0761D6478BD642F)

    @staticmethod
    def inner_rows(one: np.ndarray, two: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        which = classes.astype(np.uint64) << np.uint64(34)
        return _mix(one + which, 0x8EBC6AF09C88C6E3), _mix(two + which, 0x589965CC75374CC3)

    def logs(self, one: np.ndarray, two: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Natural log probability of the output codes: of the class, and of the word if its class is frequent."""
        result = np.empty(out.size)
        for at in range(0, out.size, PART):
            a, b, code = one[at:at + PART], two[at:at + PART], out[at:at + PART]
            classes, word = code // WIDTH, code % WIDTH
            got = _chosen(self.outer_x, self.outer_rows(a, b), self.class_x, classes)
            some = np.flatnonzero(classes < FREQUENT)
            if some.size:
                rows = self.inner_rows(a[some], b[some], classes[some])
                got[some] += _chosen(self.inner_x, rows, self.word_x[classes[some]], word[some])
            result[at:at + PART] = got
        return result

    def learn(self, one: np.ndarray, two: np.ndarray, out: np.ndarray, sums: np.ndarray, uses: np.ndarray) -> None:
        """One pass of gradient steps over batches of tokens; step sizes fall with each row's gradients so far.

        ``sums`` has the squared gradients of outer and inner rows, ``uses`` the tokens that used them.
        """
        for at in range(0, out.size, BATCH):
            a, b, code = one[at:at + BATCH], two[at:at + BATCH], out[at:at + BATCH]
            classes, word = code // WIDTH, code % WIDTH
            _step(self.outer, self.outer_x, sums[0], uses[0], self.outer_rows(a, b), self.class_x, classes)
            some = np.flatnonzero(classes < FREQUENT)
            if some.size:
                rows = self.inner_rows(a[some], b[some], classes[some])
                _step(self.inner, self.inner_x, sums[1], uses[1], rows, self.word_x[classes[some]], word[some])


    def turn_logs(self, one: np.ndarray, two: np.ndarray, words: np.ndarray, paths: Paths) -> np.ndarray:
        """Natural log probability of the turns to each token's word (its number in the chunk)."""
        result = np.zeros(words.size)
        some = np.flatnonzero(paths.sizes[words])
        for at in range(0, some.size, PART):
            own = some[at:at + PART]
            begins, places, bias, sign = paths.steps(one[own], two[own], words[own])
            odds = np.take(self.nodes, places[0])
            odds += np.take(self.nodes, places[1])
            odds += bias
            odds *= sign
            np.exp(np.negative(odds, out=odds), out=odds)
            result[own] = -np.add.reduceat(np.log1p(odds, out=odds), begins)
        return result

    def learn_turns(self, one: np.ndarray, two: np.ndarray, words: np.ndarray, paths: Paths, sums: np.ndarray, uses: np.ndarray) -> None:
        """As ``learn``, for the turns to words that aren't frequent."""
        some = np.flatnonzero(paths.sizes[words])
        for at in range(0, some.size, BATCH):
            own = some[at:at + BATCH]
            _, places, bias, sign = paths.steps(one[own], two[own], words[own])
            error = np.take(self.nodes, places[0])
            error += np.take(self.nodes, places[1])
            error += bias
            np.exp(np.negative(error, out=error), out=error)
            error += 1
            np.divide(1, error, out=error)
            error -= sign > 0
            gradient, error = np.zeros(NODES), error.astype(float)
            for place in places:
                np.add.at(gradient, place, error)
                np.add.at(uses, place, 1)
            gradient = gradient.astype(np.float32)
            sums += gradient * gradient
            self.nodes -= RATE / np.sqrt(sums) * gradient
            np.clip(self.nodes, -LARGEST, LARGEST, out=self.nodes)


def _chosen(table: np.ndarray, rows: tuple[np.ndarray, np.ndarray], bias: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log of the softmax at the chosen outputs."""
    share = np.take(table, rows[0], axis=0)
    share *= np.take(table, rows[1], axis=0)
    share *= bias
    return np.log(share[np.arange(chosen.size), chosen].astype(float) / share.sum(axis=1))


def _step(weights: np.ndarray, table: np.ndarray, sums: np.ndarray, uses: np.ndarray, rows: tuple[np.ndarray, np.ndarray],
          bias: np.ndarray, chosen: np.ndarray) -> None:
    """A gradient step on the rows that a batch uses."""
    error = np.take(table, rows[0], axis=0)
    error *= np.take(table, rows[1], axis=0)
    error *= bias
    error /= error.sum(axis=1, keepdims=True)
    error[np.arange(chosen.size), chosen] -= 1
    every = np.concatenate(rows)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    lengths = np.diff(heads, append=every.size)
    which, gradient = _run_sums(error, order % chosen.size, heads, lengths)
    used = ordered[heads[which]]
    uses[used] += lengths[which]
    sums[used] += np.einsum("ij,ij->i", gradient, gradient)
    fresh = weights[used] - (RATE / np.sqrt(sums[used]))[:, None] * gradient
    weights[used] = fresh = np.clip(fresh, -LARGEST, LARGEST)
    table[used] = np.exp(fresh)


def _run_sums(values: np.ndarray, order: np.ndarray, heads: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of ``values`` that each run of ``order`` names: numbers of the runs, in some order, and their sums.

    Most runs are short; those are added up side by side, a row of each at a time, as ``reduceat`` adds those of one.
    """
    long, short = np.flatnonzero(lengths > SHORT_RUN), np.flatnonzero(lengths <= SHORT_RUN)
    short = short[np.argsort(-lengths[short], kind="stable")]
    first, size = heads[short], lengths[short]
    more = np.searchsorted(-size, -np.arange(SHORT_RUN), side="left")  # runs of more than so many rows come first
    sums = np.take(values, order[first], axis=0)
    rest = np.take(values, order[first[:more[1]] + 1], axis=0)
    for k in range(2, SHORT_RUN):
        rest[:more[k]] += np.take(values, order[first[:more[k]] + k], axis=0)
    sums[:more[1]] += rest
    if long.size:
        sizes = lengths[long]
        of_long = np.add.reduceat(np.take(values, order[_runs(heads[long], sizes)], axis=0), np.cumsum(sizes) - sizes, axis=0)
        sums = np.concatenate((of_long, sums))
    return np.concatenate((long, short)), sums


@dataclass(frozen=True)
class Vocabulary:
    """Frequent words with their output codes, and the training counts of everything else by shape."""

    codes: dict[bytes, int]
    counts: np.ndarray  # of the frequent words, by class and place
    shape_tokens: np.ndarray
    shape_words: np.ndarray
    tokens: int
    words: int
    top_tokens: np.ndarray | None  # running sums by shape over the first bits of the hashes of words that aren't frequent
    top_words: np.ndarray | None

    def code(self, word: bytes) -> int:
        found = self.codes.get(word)
        return (FREQUENT + shape(word)) * WIDTH if found is None else found

    @cached_property
    def top(self) -> tuple[np.ndarray, ...]:
        """The trees' upper part, by shape: of each node, the log odds of a right turn; of the hashes' first bits, how
        many steps their words have there, and the tokens and words of the node at which those end.
        """
        odds = np.zeros((SHAPES, TOPS), np.float32)  # a level's nodes follow those of the levels above, from 1 on
        depth, tokens, words = np.zeros((SHAPES, TOPS), np.uint8), *(np.zeros((SHAPES, TOPS), np.int64) for _ in range(2))
        going = np.ones((SHAPES, 1), bool)
        for level in range(TOP_BITS + 1):
            span = TOPS >> level
            own, known = (np.diff(x[:, ::span], axis=1) for x in (self.top_tokens, self.top_words))
            further = going & (known > 1) if level < TOP_BITS else np.zeros_like(going)
            for ended, made in ((tokens, own), (words, known)):
                np.copyto(ended.reshape(SHAPES, -1, span), made[:, :, None], where=(going & ~further)[:, :, None])
            if level < TOP_BITS:
                depth.reshape(SHAPES, -1, span)[:] += further[:, :, None]
                half, half_known = (np.diff(x[:, ::span // 2], axis=1) for x in (self.top_tokens, self.top_words))
                odds[:, 1 << level:2 << level] = _log_mass(half[:, 1::2], half_known[:, 1::2]) - _log_mass(half[:, ::2], half_known[:, ::2])
                going = np.repeat(further, 2, axis=1)
        return odds, depth, tokens, words

    def sent(self) -> Vocabulary:
        """What tasks need of it to find words' paths."""
        out = replace(self, top_tokens=None, top_words=None)
        out.__dict__["top"] = self.top
        return out

    def class_counts(self) -> np.ndarray:
        return np.concatenate((self.counts.sum(axis=1), self.shape_tokens))


CHUNKS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("doc_id", pa.list_(pa.int64())),
                    ("held_out", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("ids", pa.binary()),
                    ("buckets", pa.binary()), ("words", pa.binary()), ("n", pa.binary())])


def _packed(values: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, kind).tobytes())


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def chunked(docs: DataFrame, buckets: int) -> DataFrame:
    """Documents as word numbers, and the dictionaries of their chunks dealt into buckets, in one stored table.

    A chunk is a run of documents in one scan task, of bounded size. Its row with
    ``ids`` has its documents and the bucket of each word; its other rows, one for
    each bucket that has a word of the chunk, have those words in the order of
    their numbers, with their counts in the chunk's training documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId() << 32, 0
        numbers, ids, doc_ids, apart, size = Numbers(), [], [], [], 0

        def rows() -> Iterator[tuple]:
            words = list(numbers)
            # words whose hashes begin alike meet in one bucket
            bucket = np.fromiter(((word_hash(w) >> (HASH_BITS - TOP_BITS)) % buckets for w in words), np.int32, len(words))
            learned = [x for x, a in zip(ids, apart, strict=True) if not a]
            counts = np.bincount(np.concatenate(learned), minlength=len(words)) if learned else np.zeros(len(words))
            yield (part + done, -1, doc_ids, apart, [x.size for x in ids], _packed(np.concatenate(ids), "<i4"),
                   _packed(bucket, "<i4"), None, None)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            for one in np.split(order, cuts):
                yield (part + done, int(bucket[one[0]]), None, None, None, None, None,
                       b" ".join([words[i] for i in one.tolist()]), counts[one].astype("<i8").tobytes())

        def batch_of(some: Iterator[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), CHUNKS, strict=True)], schema=CHUNKS)

        for batch in batches:
            held, own = batch.column("held_out").to_pylist(), batch.column("doc_id").to_pylist()
            for start, texts in text_slices(batch, "text"):
                for i, text in enumerate(texts, start):
                    words = tokens(text)
                    ids.append(numbers.of(words))
                    doc_ids.append(own[i])
                    apart.append(held[i])
                    size += len(words)
                if len(numbers) > CHUNK_WORDS or size > CHUNK_TOKENS:
                    yield batch_of(rows())
                    done += 1
                    numbers, ids, doc_ids, apart, size = Numbers(), [], [], [], 0
        if ids:
            yield batch_of(rows())

    schema = ("chunk long, bucket int, doc_id array<long>, held_out array<boolean>, sizes array<int>, ids binary, "
              "buckets binary, words binary, n binary")
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
                  .mapInArrow(run, schema), "lm-chunks")


def _counted(rows: Iterator[tuple[bytes, bytes]]) -> tuple[dict[bytes, int], list[np.ndarray], np.ndarray]:
    """Numbers of the words in packed rows of words and counts, each row's numbers, and the words' sums."""
    numbers, own, sums = Numbers(), [], np.zeros(1 << 10, np.int64)
    for words, n in rows:
        own.append(numbers.of(words.split(b" ")))
        if len(numbers) > sums.size:
            sums = np.concatenate((sums, np.zeros(len(numbers), np.int64)))
        sums[own[-1]] += np.frombuffer(n, "<i8")  # no word comes twice in a row
    return numbers, own, sums[:len(numbers)]


def vocabulary(entries: DataFrame) -> Vocabulary:
    """The most frequent words of all chunks, and sums over all others.

    Each task adds up the words of its buckets; of those it hands on the most
    frequent, as many as the model has places for, sums by shape, and sums by shape and the
    first bits of the words' hashes, at most one for each of the model's tree places.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, _, n = _counted(row for batch in batches for row in
                                 zip(batch.column("words").to_pylist(), batch.column("n").to_pylist(), strict=True))
        known = np.flatnonzero(n)
        words = list(numbers)
        words, n = [words[i] for i in known.tolist()], n[known]
        shapes = np.fromiter((shape(w) for w in words), np.int64, len(words))
        first = np.fromiter((word_hash(w) >> (HASH_BITS - TOP_BITS) for w in words), np.int64, len(words))
        sums = np.stack([np.bincount(shapes, x, SHAPES).astype(np.int64) for x in (n, np.ones_like(n))], axis=1)
        places, place = np.unique(shapes * TOPS + first, return_inverse=True)
        by_place = [np.bincount(place, x, places.size) for x in (n, np.ones_like(n))]
        top = heapq.nsmallest(FREQUENT * WIDTH, zip((-n).tolist(), words, strict=True))
        more = SHAPES + len(top)
        yield pa.RecordBatch.from_arrays([
            pa.array([None] * SHAPES + [w for _, w in top] + [None], pa.binary()),
            pa.array(list(range(SHAPES)) + [None] * (len(top) + 1), pa.int32()),
            pa.array(sums[:, 0].tolist() + [-c for c, _ in top] + [None], pa.int64()),
            pa.array(sums[:, 1].tolist() + [1] * len(top) + [None], pa.int64()),
            *[pa.array([None] * more + [_packed(x, "<i8")], pa.binary()) for x in (places, *by_place)]],
            ["word", "shape", "tokens", "words", "places", "place_tokens", "place_words"])

    places = FREQUENT * WIDTH
    parts = stored(entries.select("bucket", "words", "n").repartition("bucket").mapInArrow(
        run, "word binary, shape int, tokens long, words long, places binary, place_tokens binary, place_words binary"), "lm-sums")
    top = parts.where("word is not null").orderBy(F.col("tokens").desc(), "word").limit(places).collect()
    by_shape = np.zeros((SHAPES, 2), np.int64)
    for r in parts.where("shape is not null").groupBy("shape").agg(F.sum("tokens"), F.sum("words")).collect():
        by_shape[r[0]] = r[1], r[2]
    total, words = by_shape.sum(axis=0).tolist()
    by_place = np.zeros((2, SHAPES, TOPS + 1), np.int64)
    for r in parts.where("places is not null").select("places", "place_tokens", "place_words").collect():
        at, *sums = (_unpacked(x, "<i8") for x in r)
        by_place[:, at // TOPS, at % TOPS + 1] += np.stack(sums)
    counts = np.zeros((FREQUENT, WIDTH))
    counts.ravel()[:len(top)] = [r["tokens"] for r in top]
    for r in top:
        word = bytes(r["word"])
        by_shape[shape(word)] -= (r["tokens"], 1)
        by_place[:, shape(word), (word_hash(word) >> (HASH_BITS - TOP_BITS)) + 1] -= (r["tokens"], 1)
    by_place = by_place.cumsum(axis=2)
    return Vocabulary({bytes(r["word"]): i for i, r in enumerate(top)}, counts, by_shape[:, 0].astype(float),
                      by_shape[:, 1].astype(float), total, words, by_place[0], by_place[1])


def deep_turns(shapes: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of words that meet with all others whose hashes begin alike: the steps of their paths beyond the first bits.

    Shapes are -1 for frequent words. Returns the number of steps and, one word's after another, the log odds of
    a right turn; then the tokens and the words that each word's leaf has besides. A node of at most one known word is a leaf.
    """
    keys = np.maximum(shapes, 0).astype(np.uint64) << np.uint64(HASH_BITS) | hashes.astype(np.uint64)
    known = np.flatnonzero((counts > 0) & (shapes >= 0))
    known = known[np.argsort(keys[known], kind="stable")]
    have, tokens = keys[known], np.concatenate(([0], np.cumsum(counts[known])))
    own = np.flatnonzero(shapes >= 0)
    below = np.uint64((1 << (HASH_BITS - TOP_BITS)) - 1)
    lo, hi = np.searchsorted(have, keys[own] & ~below), np.searchsorted(have, keys[own] | below, "right")
    steps, sizes = [], np.zeros(shapes.size, np.uint8)
    for bit in range(HASH_BITS - TOP_BITS - 1, -1, -1):
        at = np.flatnonzero(hi - lo > 1)
        if not at.size:
            break
        key = keys[own[at]] >> np.uint64(bit)
        a, b = lo[at], hi[at]
        middle = np.searchsorted(have, (key | np.uint64(1)) << np.uint64(bit))
        steps.append((own[at], _log_mass(tokens[b] - tokens[middle], b - middle) - _log_mass(tokens[middle] - tokens[a], middle - a)))
        sizes[own[at]] += 1
        right = (key & np.uint64(1)) > 0
        lo[at], hi[at] = np.where(right, middle, a), np.where(right, b, middle)
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    odds = np.zeros(int(sizes.sum(dtype=np.int64)), np.float16)
    for i, (which, made) in enumerate(steps):
        odds[starts[which] + i] = made
    rest, others = np.zeros(shapes.size, np.int64), np.zeros(shapes.size, np.int32)
    rest[own] = tokens[hi] - tokens[lo] - counts[own]
    others[own] = hi - lo - (counts[own] > 0)
    return sizes, odds, rest, others


def paths_of(vocab: Vocabulary, count: np.ndarray, hashes: np.ndarray, codes: np.ndarray, deep: np.ndarray, odds: np.ndarray,
             rest: np.ndarray, others: np.ndarray) -> tuple[Paths, np.ndarray]:
    """Paths of a chunk's words, and the natural log of each word's share of its leaf."""
    rare = np.flatnonzero(codes >= FREQUENT * WIDTH)
    shapes, own, deep_own = codes[rare] // WIDTH - FREQUENT, hashes[rare], deep[rare].astype(np.int64)
    top_odds, depth, tokens, words = (x.ravel() for x in vocab.top)
    place = shapes * TOPS + (own >> (HASH_BITS - TOP_BITS))
    top = depth[place].astype(np.int64)
    sizes = np.zeros(codes.size, np.int64)
    sizes[rare] = top + deep_own
    starts = np.cumsum(sizes) - sizes
    # a word's steps on end; those beyond the first bits are in the order of ``odds``
    size = sizes[rare]
    level = _runs(np.zeros_like(size), size)
    down = np.repeat(own, size)
    down >>= HASH_BITS - 1 - level
    node = np.left_shift(1, level)
    node |= down >> 1
    upper = level < np.repeat(top, size)
    bias = np.empty(level.size, np.float32)
    bias[upper] = top_odds[np.repeat(shapes * TOPS, top) + node[upper]]
    bias[~upper] = odds
    node |= np.repeat(shapes << (HASH_BITS + 1), size)
    sign = ((down & 1) * 2 - 1).astype(np.float32)
    further = deep_own > 0
    in_leaf = np.where(further, count[rare] + rest[rare], tokens[place])
    known = np.where(further, (count[rare] > 0) + others[rare], words[place])
    share = np.zeros(codes.size)  # a frequent word's place in its class is in the model's hands
    share[rare] = np.log(count[rare] + ADDED) - _log_mass(in_leaf, known)
    return Paths(starts, sizes, _mix64(node.view(np.uint64), 0x8EBC6AF09C88C6E3), bias, sign), share


WORD_COLUMNS = (("c", "<i8"), ("hash", "<u4"), ("code", "<u2"), ("deep", "u1"), ("rest", "<i8"), ("others", "<i4"))
ODDS = "<f2"
READY = "chunk long, doc_id array<long>, held_out array<boolean>, sizes array<int>, ids binary, " + "".join(f"{n} binary, " for n, _ in WORD_COLUMNS) + "odds binary"


def with_counts(parts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Chunks with the corpus count, hash, output code and further path of each of their words, in one stored table.

    A bucket's task adds up its words over all chunks and answers each chunk's
    row; the answers meet their chunk again.
    """
    shared = parts.sparkSession.sparkContext.broadcast(replace(vocab, top_tokens=None, top_words=None))
    columns = [name for name, _ in WORD_COLUMNS] + ["odds"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = []

        def rows() -> Iterator[tuple[bytes, bytes]]:
            for batch in batches:
                for chunk, bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("chunk", "bucket", "words", "n")), strict=True):
                    asked.append((chunk, bucket))
                    yield row

        numbers, own, counts = _counted(rows())
        code = shared.value.code
        codes = np.fromiter((code(w) for w in numbers), np.int64, len(numbers))
        hashes = np.fromiter((word_hash(w) for w in numbers), np.int64, len(numbers))
        deep, odds, rest, others = deep_turns(np.where(codes < FREQUENT * WIDTH, -1, codes // WIDTH - FREQUENT), hashes, counts)
        starts = np.cumsum(deep, dtype=np.int64) - deep
        for (chunk, bucket), ids in zip(asked, own, strict=True):
            made = [_packed(x[ids], kind) for x, (_, kind) in zip((counts, hashes, codes, deep, rest, others), WORD_COLUMNS, strict=True)]
            made.append(_packed(odds[_runs(starts[ids], deep[ids])], ODDS))
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk]), pa.array([bucket], pa.int32()), *[pa.array([x], pa.binary()) for x in made]], ["of", "bucket", *columns])

    answers = (parts.where("bucket >= 0").select("chunk", "bucket", "words", "n").repartition("bucket")
               .mapInArrow(look_up, "of long, bucket int, " + ", ".join(f"{n} binary" for n in columns)))

    def meet(docs: pa.Table, found: pa.Table) -> pa.Table:
        bucket = _unpacked(docs["buckets"][0].as_py(), "<i4")
        order = np.argsort(bucket, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(order.size)
        rows = found.sort_by("bucket")
        got = {name: np.concatenate([_unpacked(x, kind) for x in rows[name].to_pylist()]) for name, kind in (*WORD_COLUMNS, ("odds", ODDS))}
        starts = np.cumsum(got["deep"], dtype=np.int64) - got["deep"]
        out = [pa.array([_packed(got[name][place], kind)], pa.binary()) for name, kind in WORD_COLUMNS]
        out.append(pa.array([_packed(got["odds"][_runs(starts[place], got["deep"][place])], ODDS)], pa.binary()))
        names = ["chunk", "doc_id", "held_out", "sizes", "ids"]
        return pa.Table.from_arrays([*(docs[n] for n in names), *out], names=[*names, *columns])

    docs = parts.where("bucket < 0").select("chunk", "doc_id", "held_out", "sizes", "ids", "buckets")
    return stored(docs.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(meet, READY), "lm-ready")


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs of these sizes, one after another."""
    sizes = sizes.astype(np.int64)
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each chunk: doc ids, held-out marks, the documents' word numbers, and what ``paths_of`` needs by number."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids = _unpacked(batch.column("ids")[i].as_py(), "<i4")
            sizes = np.array(batch.column("sizes")[i].as_py(), np.int64)
            c, hashes, codes, deep, rest, others = (_unpacked(batch.column(n)[i].as_py(), kind) for n, kind in WORD_COLUMNS)
            yield (batch.column("doc_id")[i].as_py(), np.array(batch.column("held_out")[i].as_py(), bool), sizes, ids,
                   (c, hashes.astype(np.int64), codes.astype(np.int64), deep, _unpacked(batch.column("odds")[i].as_py(), ODDS), rest, others))


MOVED = "block int, outer binary, inner binary, sums binary, uses binary, nodes binary"


def _blocks(outer: np.ndarray, inner: np.ndarray, sums: np.ndarray, uses: np.ndarray,
            nodes: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Weight rows in blocks, those that no token used left out by blocks.

    ``nodes`` has weights, squared gradients and uses of the nodes' places; a block carries its share of them.
    """
    nodes = np.zeros((3, NODES), np.float32) if nodes is None else nodes
    for at in range(0, ROWS, BLOCK):
        rows, places = slice(at, at + BLOCK), slice(at * NODES // ROWS, (at + BLOCK) * NODES // ROWS)
        if uses[:, rows].any() or nodes[2, places].any():
            made = outer[rows], inner[rows], sums[:, rows], uses[:, rows], nodes[:, places]
            yield _block(at // BLOCK, made)


def _block(number: int, made: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int32()),
         *[pa.array([np.ascontiguousarray(x, k).tobytes()], pa.binary()) for x, k in zip(made, ("<f4", "<f4", "<f4", "<i8", "<f4"), strict=True)]],
        ["block", "outer", "inner", "sums", "uses", "nodes"])


def _block_of(outer: bytes, inner: bytes, sums: bytes, uses: bytes) -> tuple[np.ndarray, ...]:
    return (np.frombuffer(outer, "<f4").reshape(-1, CLASSES), np.frombuffer(inner, "<f4").reshape(-1, WIDTH),
            np.frombuffer(sums, "<f4").reshape(2, -1), np.frombuffer(uses, "<i8").reshape(2, -1))


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's mean over learners, a learner counting as often as its tokens used the row; likewise of each node's place."""
    total: dict[int, list] = {}
    for batch in batches:
        for block, *raw, last in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            outer, inner, sums, uses = _block_of(*raw)
            weights, squares, often = np.frombuffer(last, "<f4").reshape(3, -1).astype(float)
            have = total.setdefault(block, [0.0, 0.0, 0.0, 0, 0.0])
            for i, x in enumerate((outer * uses[0][:, None].astype(float), inner * uses[1][:, None].astype(float), sums * uses.astype(float), uses,
                                   np.stack((weights * often, squares * often, often)))):
                have[i] = have[i] + x
    for block, (outer, inner, sums, uses, nodes) in total.items():
        often = np.maximum(uses, 1)
        nodes[:2] /= np.maximum(nodes[2], 1)
        yield _block(block, (outer / often[0][:, None], inner / often[1][:, None], sums / often, uses, nodes))


def train(ready: DataFrame, vocab: Vocabulary, rounds: int | None = None) -> Model:
    """Distributed gradient training over all documents that aren't held out, each once.

    A round takes its share of the chunks, dealt to as many learners as their
    tokens fill, however many files the table has. Every learner starts from the
    common weights and sums of squared gradients and makes gradient steps over its own
    tokens. A row's next start is its mean over the learners, each counting as often as
    its tokens used the row; a row that no token used stays. Rounds grow with the
    logarithm of the learners. What reaches the driver is one set of weights a round.
    """
    spark = ready.sparkSession
    model = Model.start(vocab.class_counts(), vocab.counts)
    sums, node_sums = np.ones((2, ROWS), np.float32), np.ones(NODES, np.float32)
    words = spark.sparkContext.broadcast(vocab.sent())
    rounds = rounds or max(ROUNDS, (vocab.tokens // LEARNER_TOKENS).bit_length())
    learners = max(1, -(-vocab.tokens // (LEARNER_TOKENS * rounds)))
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((model.flat(), sums, node_sums))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            flat, before, nodes_before = shared.value
            local, own_sums, uses = Model.of(flat), before.copy(), np.zeros((2, ROWS), np.int64)
            own_nodes, node_uses = nodes_before.copy(), np.zeros(NODES, np.int64)
            for _, apart, sizes, ids, entries in _chunks(batches):
                flat = ids[~np.repeat(apart, sizes)]
                own = sizes[~apart]
                if flat.size:
                    _, hashes, codes, *_ = entries
                    one, two = contexts(hashes[flat], np.cumsum(own) - own)
                    local.learn(one, two, codes[flat], own_sums, uses)
                    local.learn_turns(one, two, flat, paths_of(words.value, *entries)[0], own_nodes, node_uses)
            yield from _blocks(local.outer, local.inner, own_sums, uses, np.stack((local.nodes, own_nodes, node_uses.astype(np.float32))))

        mine = ready.where(F.pmod(F.xxhash64("chunk"), F.lit(rounds)) == turn).coalesce(learners)
        for r in mine.drop("chunk").mapInArrow(run, MOVED).repartition("block").mapInArrow(_mean, MOVED).collect():
            outer, inner, squares, uses = _block_of(*r[1:5])
            rows = np.arange(r["block"] * BLOCK, r["block"] * BLOCK + BLOCK)
            a, b = uses[0] > 0, uses[1] > 0
            model.outer[rows[a]], model.inner[rows[b]] = outer[a], inner[b]
            sums[0, rows[a]], sums[1, rows[b]] = squares[0][a], squares[1][b]
            weights, squares, often = np.frombuffer(r["nodes"], "<f4").reshape(3, -1)
            places = np.flatnonzero(often) + r["block"] * often.size
            model.nodes[places], node_sums[places] = weights[often > 0], squares[often > 0]
        model = Model.of(model.flat())  # with the exponentials of the new weights
        shared.unpersist()
    return model


def score(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the base-10 log probability of the whole text, its end
    included: of each token's class given the two words before, then of the word in
    its class given them too. Within the classes of frequent words that is a softmax; in
    the others a way down a tree of all words of the class, a logistic choice at each
    node. A leaf has one known word (or those whose hashes are equal) and one more place
    that stands for all unseen words there. NULL text counts as empty (the end alone).
    Without training documents every token has its class's even share.

    Counts are exact and cover the whole corpus. A word crosses the shuffle
    with its chunk's other words of the same bucket, once per chunk, and its total
    comes back to those chunks only.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = chunked(docs, buckets)
    vocab = vocabulary(parts.where("bucket >= 0"))
    ready = with_counts(parts, vocab)
    model = train(ready, vocab, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((model.flat(), vocab.sent()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, words = shared.value
        local = Model.of(flat)
        for chunk in _chunks(batches):
            yield from _scored(local, words, *chunk)

    return ready.drop("chunk").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _scored(model: Model, vocab: Vocabulary, doc_ids: list, apart: np.ndarray, sizes: np.ndarray, ids: np.ndarray,
            entries: tuple) -> Iterator[pa.RecordBatch]:
    """Scores of one chunk's documents, in runs of bounded size."""
    count, hashes, codes, *_ = entries
    base = np.log10((count + ADDED) / (vocab.tokens + ADDED * (vocab.words + 1)))
    paths, share = paths_of(vocab, *entries)
    ends = np.cumsum(sizes)
    at = 0
    while at < sizes.size:
        begin = int(ends[at] - sizes[at])
        stop = max(at + 1, int(np.searchsorted(ends, begin + (1 << 18), "right")))
        flat, first = ids[begin:int(ends[stop - 1])], ends[at:stop] - sizes[at:stop] - begin
        one, two = contexts(hashes[flat], first)
        logs = model.logs(one, two, codes[flat]) + model.turn_logs(one, two, flat, paths) + share[flat]
        n = stop - at
        yield pa.RecordBatch.from_arrays([
            pa.array(doc_ids[at:stop], pa.int64()), pa.array(apart[at:stop]), pa.array(sizes[at:stop]),
            pa.array(np.add.reduceat((count[flat] > 0).astype(np.int64), first)), pa.array(np.full(n, vocab.tokens, np.int64)),
            pa.array(np.add.reduceat(base[flat], first)), pa.array(np.add.reduceat(logs, first) / np.log(10))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        at = stop


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document."""
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op6_lm_score": op6_lm_score}
ORACLE: dict[str, str] = {}
