"""Multi-pattern matching: which of any number of keywords a text contains.

The keywords are compiled into an Aho-Corasick automaton of flat arrays, broadcast once. Texts
are run over it as UTF-8 bytes, cut into windows that advance in lockstep, so a step is
a few array operations for thousands of windows and the time for a text doesn't depend on the number of keywords.

A list as long as the corpus is joined instead (``keyword_counts``): texts are cut at the characters that no keyword
has, the distinct runs between them are matched once, and what they contain goes back to the texts by chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crisismap.session import stored

# Bytes of keywords in one automaton (about 20 bytes of arrays for each); longer lists make several.
AUTOMATON_BYTES = 4 << 20
WINDOW = 512  # bytes of text that a window owns
SHORT_LIST = 100_000  # keywords that are fetched at once
SLICE_BYTES = 4 << 20  # bytes of text in lockstep at once
# A chunk of texts shares one dictionary of runs; it ends at so many runs, their uses or characters.
CHUNK_RUNS, CHUNK_USES, CHUNK_CHARS = 250_000, 1_500_000, 16 << 20
PIECE = 24  # characters; longer keywords are found by their first ones
PIECE_ROWS = 1 << 16
# Hashes of keywords set a bit each, among 16 times as many or more, but at most 2 ** MARK_BITS; tasks set blocks of them.
MARK_BITS, BLOCK_BITS = 28, 20
TASK_BYTES = 8 << 20  # of keywords that a task of the join holds, in a table of some ten times as much
PAIRS = 1 << 21  # of text and keyword in work at once


class Automaton:
    """States 1, 2, ... in breadth-first order (0 is the root); edges as sorted keys ``state * 256 + byte``."""

    def __init__(self, patterns: list[bytes]):
        self.longest = max(map(len, patterns), default=0)
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for number, pattern in enumerate(patterns):
            state = 0
            for byte in pattern:
                state = children[state].setdefault(byte, len(children))
                if state == len(children):
                    children.append({})
            ends.setdefault(state, number)
        order, fail = [0], [0] * len(children)
        for state in order:
            for byte, child in children[state].items():
                order.append(child)
                at = fail[state]
                while state and at and byte not in children[at]:
                    at = fail[at]
                fail[child] = children[at].get(byte, 0) if state else 0
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.fail = place[np.array(fail)[order]].astype(np.int32)
        self.pattern = np.array([ends.get(state, -1) for state in order], np.int32)
        pairs = sorted((int(place[state]) * 256 + byte, int(place[child])) for state in order for byte, child in children[state].items())
        self.keys = np.array([key for key, _ in pairs], np.int64)
        self.goto = np.array([child for _, child in pairs], np.int32)
        self.start = np.zeros(256, np.int32)
        for byte, child in children[0].items():
            self.start[byte] = place[child]
        # the next state along the fails at which a pattern ends; parents come first
        self.next_end = np.zeros(len(order), np.int32)
        for state in range(1, len(order)):
            behind = self.fail[state]
            self.next_end[state] = behind if self.pattern[behind] >= 0 and behind else self.next_end[behind]
        self.ends_here = (self.pattern >= 0) | (self.next_end > 0)
        self.ends_here[0] = False  # the empty pattern is in every text, which needs no automaton
        self.has_empty = bool(self.pattern[0] >= 0)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """States after one more byte each: along edges, fails followed where there is none."""
        out = self.start[byte]
        open_ = np.flatnonzero(state)
        if open_.size and self.keys.size:
            at, byte = state[open_].astype(np.int64), byte[open_].astype(np.int64)
            while open_.size:
                key = at * 256 + byte
                found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[found] == key
                out[open_[hit]] = self.goto[found[hit]]
                at = self.fail[at[~hit]].astype(np.int64)
                open_, byte = open_[~hit], byte[~hit]
                inner = at > 0  # back at the root: ``start`` holds
                at, open_, byte = at[inner], open_[inner], byte[inner]
        return out

    def find(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, pattern) pairs, each once and in order, of texts that lie in ``data`` from ``begins`` to ``ends``."""
        lengths = ends - begins
        windows = -(-lengths // WINDOW)
        text = np.repeat(np.arange(len(begins)), windows)
        number = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
        own = begins[text] + number * WINDOW  # hits that end at own or after belong to this window
        at = np.maximum(begins[text], own - max(self.longest - 1, 0))
        stop = np.minimum(own + WINDOW, ends[text])
        order = np.argsort(at - stop, kind="stable")  # longest first: those that are done fall off the end
        text, own, at, span = text[order], own[order], at[order], (stop - at)[order]
        state = np.zeros(len(text), np.int32)
        hit_text, hit_state = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        running = len(text)
        for i in range(int(span[0]) if len(span) else 0):
            running = int(np.searchsorted(-span, -i, side="left"))
            state = self.step(state[:running], data[at[:running] + i])
            ended = np.flatnonzero(self.ends_here[state])
            if ended.size:
                ended = ended[at[ended] + i >= own[ended]]
                hit_text.append(text[ended])
                hit_state.append(state[ended])
        pairs = np.unique(np.stack([np.concatenate(hit_text), np.concatenate(hit_state).astype(np.int64)]), axis=1)
        texts, states, out = pairs[0], pairs[1], [np.zeros((2, 0), np.int64)]
        while states.size:  # patterns that end where a longer one does
            here = self.pattern[states] >= 0
            out.append(np.stack([texts[here], self.pattern[states[here]].astype(np.int64)]))
            states = self.next_end[states].astype(np.int64)
            texts, states = texts[states > 0], states[states > 0]
        if self.has_empty:
            out.append(np.stack([np.arange(len(begins)), np.full(len(begins), self.pattern[0])]))
        found = np.unique(np.concatenate(out, axis=1), axis=1)
        return found[0], found[1]


def found_in(texts: pa.Array, automaton: Automaton, names: pa.Array) -> pa.Array:
    """List of the names of the patterns in each text (in the patterns' order); NULL for NULL."""
    texts = texts.cast(pa.large_string())
    out = []
    for part in _slices(texts):
        _, offsets, data = part.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(part) + 1, part.offset * 8)
        values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        text, pattern = automaton.find(values, bounds[:-1], bounds[1:])
        starts = np.searchsorted(text, np.arange(len(part) + 1)).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(starts), names.take(pa.array(pattern, pa.int64())),
                                            mask=part.is_null() if part.null_count else None))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + SLICE_BYTES, side="right")) - 1)
        yield texts.slice(start, stop - start)
        start = stop


def keywords_in(text: Column, keywords: DataFrame, column: str = "keyword", automaton_bytes: int | None = None) -> Column:
    """Array of the distinct lower-cased ``keywords`` that the lower-cased ``text`` contains; NULL for a NULL text.

    Keywords reach the driver in sorted order, one automaton's worth at a time, and are
    broadcast; a text is lower-cased once and run over every automaton, of which a usual list makes one. NULL keywords
    don't count, the empty one is in every text.
    """
    spark = keywords.sparkSession
    words = keywords.select(F.lower(F.col(column)).alias("k")).where(F.col("k").isNotNull()).distinct().orderBy("k")
    parts, block, size, limit = [], [], 0, automaton_bytes or AUTOMATON_BYTES

    def close() -> None:
        held = spark.sparkContext.broadcast((Automaton([w.encode() for w in block]), pa.array(block, pa.string())))

        @F.arrow_udf("array<string>")
        def match(texts: pa.Array) -> pa.Array:
            return found_in(texts, *held.value)

        parts.append(match(F.lower(text)))

    rows = words.limit(SHORT_LIST + 1).collect()  # one job does for a usual list
    for row in rows if len(rows) <= SHORT_LIST else words.toLocalIterator():
        if block and size + len(row["k"].encode()) > limit:
            close()
            block, size = [], 0
        block.append(row["k"])
        size += len(row["k"].encode())
    if block or not parts:
        close()
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def keyword_counts(texts: DataFrame, column: str, keywords: DataFrame, keyword: str = "keyword") -> DataFrame:
    """``keyword`` and ``documents``: in how many rows the lower-cased text contains each lower-cased keyword, if in any.

    A list that fits one automaton is matched by ``keywords_in``. A longer one meets the
    distinct runs of its characters: every piece of a run, up to ``PIECE`` characters, is joined with the keywords, longer
    keywords by their first characters and then tested. Work grows with texts and keywords, not with their product.
    """
    words = stored(keywords.select(F.lower(F.col(keyword)).alias("keyword")).where("keyword is not null").distinct(), "keywords")
    size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("keyword")), F.lit(0))).first()
    if size[0] <= SHORT_LIST and size[1] <= AUTOMATON_BYTES:
        found = texts.select(F.explode(keywords_in(F.col(column), words)).alias("keyword"))
        return found.groupBy("keyword").agg(F.count("*").alias("documents"))
    least, most, letters = _extent(words)
    lowered = texts.select(F.lower(F.col(column)).alias("text")).where("text is not null")
    parts = stored(lowered.mapInArrow(_chunked(letters, least), "chunk long, sizes binary, ids binary, runs array<string>"), "keyword-chunks")
    used = parts.select("chunk", F.posexplode("runs").alias("n", "run"))
    runs = stored(used.select("run").distinct().withColumn("id", F.monotonically_increasing_id()), "keyword-runs")
    # pieces far outnumber keywords: those are hashed, few enough in a task, and nothing is sorted
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size[1] // TASK_BYTES))
    pieces = runs.mapInArrow(_pieces(least, PIECE, _marks(words, size[0])), "id long, piece string").repartition(tasks, "piece")
    hashed = words.select("keyword", F.col("keyword").alias("piece")).repartition(tasks, "piece").hint("shuffle_hash")
    hits = pieces.join(hashed, "piece").select("id", "keyword")
    if most > PIECE:
        firsts = runs.where(F.length("run") > PIECE).mapInArrow(_pieces(PIECE, PIECE), "id long, piece string")
        long = words.where(F.length("keyword") > PIECE).withColumn("piece", F.substring("keyword", 1, PIECE))
        # a block of a run has a piece once, the run may have it in many blocks
        pairs = firsts.distinct().join(long, "piece").select("id", "keyword").join(runs, "id")
        hits = hits.unionByName(pairs.where(F.contains("run", "keyword")).select("id", "keyword"))
    by_run = hits.groupBy("id").agg(F.collect_set("keyword").alias("found")).join(runs, "id").select("run", "found")
    found = used.join(by_run, "run").select(F.col("chunk").alias("of"), "n", "found")
    counts = parts.select("chunk", "sizes", "ids").groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(_counted, "keyword string, documents long")
    every = words.where("keyword = ''").crossJoin(lowered.agg(F.count("*").alias("documents"))).where("documents > 0")
    return counts.groupBy("keyword").agg(F.sum("documents").alias("documents")).unionByName(every)


def _extent(words: DataFrame) -> tuple[int, int, str]:
    """Least and most characters of the keywords, and all characters they have; the empty one doesn't count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, letters = set(), set()
        for batch in batches:
            own = batch.column(0).to_pylist()
            sizes.update(map(len, own))
            letters.update("".join(own))
        sizes.discard(0)
        if sizes:
            yield pa.RecordBatch.from_pydict({"least": [min(sizes)], "most": [max(sizes)], "letters": ["".join(sorted(letters))]})

    rows = words.mapInArrow(run, "least long, most long, letters string").collect()
    return (min((r["least"] for r in rows), default=1), max((r["most"] for r in rows), default=1),
            "".join(sorted(set().union(*(r["letters"] for r in rows)))))


def _chunked(letters: str, least: int):
    """Texts as numbers of the runs that each has, once each, and the chunk's runs in the order of their numbers."""
    pattern = f"[{''.join(map(re.escape, letters))}]{{{least},}}" if letters else "(?!)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, part, done = re.compile(pattern).findall, TaskContext.get().partitionId() << 32, 0
        numbers, ids, uses, chars = {}, [], 0, 0

        def chunk() -> pa.RecordBatch:
            sizes = np.array([x.size for x in ids], "<i4")
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array([part + done]), "sizes": pa.array([sizes.tobytes()], pa.binary()),
                "ids": pa.array([np.concatenate(ids).tobytes()], pa.binary()), "runs": pa.array([list(numbers)], pa.list_(pa.string()))})

        for batch in batches:
            for text in batch.column(0):
                own, known = set(find(text.as_py())), len(numbers)
                ids.append(np.array([numbers.setdefault(x, len(numbers)) for x in own], "<i4"))
                uses += len(own)
                if len(numbers) > known:
                    chars += sum(map(len, own))
                if len(numbers) > CHUNK_RUNS or uses > CHUNK_USES or chars > CHUNK_CHARS:
                    yield chunk()
                    numbers, ids, uses, chars, done = {}, [], 0, 0, done + 1
        if uses:
            yield chunk()

    return run


def _marks(words: DataFrame, count: int) -> Broadcast:
    """Bits at the first bits of the keywords' hashes, of bounded size: a piece whose bit isn't set is no keyword."""
    bits = min(max(BLOCK_BITS, (16 * count).bit_length()), MARK_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked: dict[int, np.ndarray] = {}
        for batch in batches:
            block, at = (batch.column(i).to_numpy() for i in range(2))
            for one in set(block.tolist()):
                marked.setdefault(one, np.zeros(1 << BLOCK_BITS, bool))[at[block == one] & ((1 << BLOCK_BITS) - 1)] = True
        for one, some in marked.items():
            yield pa.RecordBatch.from_pydict({"block": [one], "marks": pa.array([np.packbits(some, bitorder="little").tobytes()], pa.binary())})

    places = words.select(F.shiftrightunsigned(F.xxhash64("keyword"), 64 - bits).alias("at"))
    blocks = places.select(F.shiftright("at", BLOCK_BITS).alias("block"), "at").repartition("block").mapInArrow(mark, "block long, marks binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in blocks.toLocalIterator():
        out[row["block"] << (BLOCK_BITS - 3):(row["block"] + 1) << (BLOCK_BITS - 3)] = np.frombuffer(row["marks"], np.uint8)
    return words.sparkSession.sparkContext.broadcast(out)


def _pieces(least: int, most: int, marks: Broadcast | None = None):
    """Each run's distinct pieces of ``least`` to ``most`` characters; of a long run, those of a block of it at a time.

    Pieces that ``marks`` prove to be no keyword are left out.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, set[str]]]:
        for batch in batches:
            for run, number in zip(batch.column("run"), batch.column("id").to_pylist(), strict=True):
                run = run.as_py()
                for at in range(0, len(run) - least + 1, PIECE_ROWS):
                    stop = min(at + PIECE_ROWS, len(run))
                    yield number, {run[i:i + n] for n in range(least, min(most, len(run)) + 1) for i in range(at, min(stop, len(run) - n + 1))}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, out = [], [], []

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), sizes)), pa.array(out, pa.string())], ["id", "piece"])
            if marks is None:
                return batch
            held = marks.value
            hashes = np.fromiter((xxhash.xxh64_intdigest(piece, 42) for piece in out), np.uint64, len(out))  # as Spark's xxhash64
            at = (hashes >> np.uint64(64 - 3 - (held.size.bit_length() - 1))).astype(np.int64)
            return batch.filter(pa.array((held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

        for number, pieces in rows(batches):
            ids.append(number)
            sizes.append(len(pieces))
            out.extend(pieces)
            if len(out) >= PIECE_ROWS:
                yield made()
                ids, sizes, out = [], [], []
        if out:
            yield made()

    return make


def _counted(docs: pa.Table, found: pa.Table) -> pa.Table:
    """Of one chunk: the texts that have each keyword, from the runs of each text and the keywords of each run."""
    if not docs.num_rows or not found.num_rows:
        return pa.table({"keyword": pa.array([], pa.string()), "documents": pa.array([], pa.int64())})
    sizes, ids = np.frombuffer(docs["sizes"][0].as_py(), "<i4").astype(np.int64), np.frombuffer(docs["ids"][0].as_py(), "<i4")
    found = found.sort_by("n")
    lists = found["found"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    has = np.zeros(int(ids.max()) + 1, np.int64)
    has[found["n"].to_numpy()] = lists.value_lengths().to_numpy()
    begins = np.cumsum(has) - has
    ends = np.cumsum(sizes)
    pairs = np.concatenate(([0], np.cumsum(has[ids])))[ends]  # of all texts up to each
    before, total, at = 0, np.zeros(len(coded.dictionary), np.int64), 0
    while at < sizes.size:
        start = int(ends[at] - sizes[at])
        stop = max(at + 1, int(np.searchsorted(pairs, before + PAIRS, "right")))
        own = ids[start:int(ends[stop - 1])]
        if own.size:
            n = has[own]
            place = np.arange(int(n.sum())) + np.repeat(begins[own] - (np.cumsum(n) - n), n)
            text = np.repeat(np.repeat(np.arange(stop - at), sizes[at:stop]), n)
            each = np.sort(text * total.size + codes[place])
            each = each[np.concatenate(([True], each[1:] != each[:-1]))[:each.size]]
            total += np.bincount(each % total.size, minlength=total.size)
        before, at = int(pairs[stop - 1]), stop
    return pa.table({"keyword": coded.dictionary, "documents": total})
