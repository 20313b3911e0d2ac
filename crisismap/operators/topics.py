"""Text statistics and topic evaluation.

The corpus is handled as long tables — ``(doc_id, word, tf)`` and
``(w1, w2, joint)`` — never as one giant string or a dense matrix. All
topics are evaluated in one corpus pass (the reference re-vectorised the
corpus once per topic).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from crisismap.functions.text import tokens as token_array
from crisismap.session import keep, maybe_broadcast, spread, stored


def tokens(df: DataFrame, text: str = "text", key: str = "doc_id", also: tuple[str, ...] = ()) -> DataFrame:
    """One row per token (lower-case words of >= 2 word characters).

    ``also`` names columns of the text's row that each token carries, e.g. its topic.
    """
    return spread(df).where(F.col(text).isNotNull()).select(key, *also, F.explode(token_array(text)).alias("word"))


def term_counts(toks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Document-term counts ``(doc_id, word, tf)``."""
    return toks.groupBy(key, "word").agg(F.count(F.lit(1)).alias("tf"))


def topic_terms(toks: DataFrame, topics: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Document-term counts of the topics' words only, and the corpus' number of tokens ``n`` (one row).

    Tokens meet the topic words (broadcast if proven small) where they are read and are
    counted there: what is shuffled is a row for each document and topic word in it, and one for all its other
    words. The counts are stored, as several branches read them.
    """
    return known_terms(counted_terms(toks, topics, key))


def counted_terms(toks: DataFrame, topics: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, word, tf), stored: as ``topic_terms``, with a NULL word for all others of a document."""
    words, _ = maybe_broadcast(topics.select(F.explode("words").alias("_w")).distinct())
    return stored(toks.join(words, toks["word"] == words["_w"], "left").groupBy(key, F.col("_w").alias("word"))
                  .agg(F.count(F.lit(1)).alias("tf")), "topic-terms")


def known_terms(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms of ``counted_terms`` that have a word, and the number of all tokens ``n`` (one row)."""
    return counted.where(F.col("word").isNotNull()), counted.agg(F.sum("tf").alias("n"))


def word_totals(tf: DataFrame) -> DataFrame:
    """Corpus frequency and document frequency per word."""
    return tf.groupBy("word").agg(F.sum("tf").alias("freq"), F.count(F.lit(1)).alias("df"))


# ---------------------------------------------------------------- N3 (M1) --
def _lg(c: Column) -> Column:
    return F.log2(c)


def pmi(f1, f2, joint, n) -> Column:
    """log2(p(w1,w2) / (p(w1) p(w2))); NULL for a zero joint (the reference gives -inf)."""
    f1, f2, joint, n = (F.col(x) if isinstance(x, str) else x for x in (f1, f2, joint, n))
    p12, p1, p2 = joint / n, f1 / n, f2 / n
    return F.when(joint > 0, _lg(p12 / (p1 * p2)))


def ppmi(f1, f2, joint, n) -> Column:
    return F.greatest(F.lit(0.0), pmi(f1, f2, joint, n))


def _norm(value: Column, joint, n, zero: float) -> Column:
    joint, n = (F.col(x) if isinstance(x, str) else x for x in (joint, n))
    return F.when(joint == 0, F.lit(zero)).otherwise(F.try_divide(value, -_lg(joint / n)))


def npmi(f1, f2, joint, n) -> Column:
    """Normalised PMI; joint 0 -> -1; joint = N divides by zero -> NULL (documented)."""
    return _norm(pmi(f1, f2, joint, n), joint, n, -1.0)


def nppmi(f1, f2, joint, n) -> Column:
    """Normalised positive PMI; joint 0 -> 0; joint = N -> NULL."""
    return _norm(ppmi(f1, f2, joint, n), joint, n, 0.0)


# ------------------------------------------------------------------- N4 ----
def topic_word_positions(topics: DataFrame, vocab: DataFrame) -> DataFrame:
    """topic words present in the vocabulary, order and duplicates kept, re-indexed 0..n-1."""
    pos = topics.select("topic_id", F.posexplode("words").alias("pos", "word"))
    kept = pos.join(vocab.select("word"), "word", "left_semi")
    w = Window.partitionBy("topic_id").orderBy("pos")
    return kept.withColumn("idx", F.row_number().over(w) - 1).drop("pos")


def cooccurrence(tf: DataFrame, words: DataFrame, key: str = "doc_id") -> DataFrame:
    """For places i < j of each topic, joint = sum over documents of tf(word i) * tf(word j).

    Terms take the topics and places of their word (an equi join; broadcast if
    the topic words are proven small), and only a document's own words of one
    topic are paired: n (n - 1) / 2 pairs at most for a topic of n words, however
    long the text and however many the topics.
    """
    places, _ = maybe_broadcast(words.select("topic_id", "idx", "word"))
    here = (tf.join(places, "word").groupBy(key, "topic_id")
            .agg(F.collect_list(F.struct("idx", "tf")).alias("_t")))
    pair = F.expr("""flatten(transform(_t, a -> transform(filter(_t, b -> b.idx > a.idx),
                     b -> named_struct('i', a.idx, 'j', b.idx, 'p', a.tf * b.tf))))""")
    return (here.select("topic_id", F.explode(pair).alias("_p")).select("topic_id", "_p.*")
            .groupBy("topic_id", "i", "j").agg(F.sum("p").alias("joint")))


def cooccurrence_in_tasks(tf: DataFrame, words: DataFrame, key: str = "doc_id") -> DataFrame:
    """``cooccurrence`` for terms (key, word, tf) counted before, with less to move where topics share words.

    All terms of a document meet in one task, which forms the pairs of its topics there, in arrays of
    bounded size, and sends one sum for each pair of places.
    """
    if not maybe_broadcast(words, 1 << 18)[1]:
        return cooccurrence(tf, words, key)
    places = words.select("topic_id", "idx", "word").orderBy("word").collect()
    topics = list(dict.fromkeys(r["topic_id"] for r in places))
    number = {t: i for i, t in enumerate(topics)}
    topic_at, idx_at = (np.array(v, np.int64) for v in ([number[r["topic_id"]] for r in places], [r["idx"] for r in places]))
    vocabulary = list(dict.fromkeys(r["word"] for r in places))
    start = np.searchsorted(np.array([r["word"] for r in places], object), np.array(vocabulary, object)) if places else np.zeros(0, np.int64)
    length, wide = np.diff(start, append=len(places)), int(idx_at.max(initial=0)) + 1

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        word = pc.index_in(table["word"].combine_chunks(), value_set=pa.array(vocabulary, pa.string())).fill_null(-1).to_numpy().astype(np.int64)
        doc = table[key].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)  # NULL: one document
        some = np.flatnonzero(word >= 0)
        some = some[np.argsort(doc[some], kind="stable")]
        word, doc, tf = word[some], doc[some], table["tf"].to_numpy()[some]
        rows = np.cumsum(length[word])  # terms x topics that have the word
        ends = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1 if len(doc) else np.zeros(0, np.int64)
        total, at = np.zeros(len(topics) * wide * wide, np.int64), 0
        while at < len(doc):
            before = rows[at - 1] if at else 0
            end = ends[max(np.searchsorted(rows[ends - 1], before + WORD_ROWS, "right") - 1, np.searchsorted(ends, at, "right"))]
            n = length[word[at:end]]
            term = np.repeat(np.arange(at, end), n)
            place = start[word[term]] + np.arange(len(term)) - np.repeat(np.cumsum(n) - n, n)
            group, idx = doc[term] * len(topics) + topic_at[place], idx_at[place]
            order = np.argsort(group * wide + idx)
            group, idx, topic, count = group[order], idx[order], topic_at[place][order], tf[term][order]
            for off in range(1, wide):
                same = np.flatnonzero(group[off:] == group[:-off])
                if not len(same):
                    break
                cell = (topic[same] * wide + idx[same]) * wide + idx[same + off]
                total += np.bincount(cell, count[same] * count[same + off], len(total)).astype(np.int64)
            at = end
        cell = np.flatnonzero(total)
        yield from pa.table({"_n": (cell // wide // wide).astype(np.int32), "i": (cell // wide % wide).astype(np.int32),
                             "j": (cell % wide).astype(np.int32), "joint": total[cell]}).to_batches()

    parts = max(1, -(-tf.count() // WORD_ROWS))
    sums = tf.select(key, "word", "tf").repartition(parts, key).mapInArrow(pair, "_n int, i int, j int, joint long")
    kinds = StructType([StructField("_n", IntegerType()), words.schema["topic_id"]])
    named = F.broadcast(tf.sparkSession.createDataFrame(list(enumerate(topics)), kinds))  # a row for each topic
    return sums.groupBy("_n", "i", "j").agg(F.sum("joint").alias("joint")).join(named, "_n").select("topic_id", "i", "j", "joint")


def topic_pairs(tf: DataFrame, topics: DataFrame, key: str = "doc_id", totals: DataFrame | None = None,
                tw: DataFrame | None = None, n: DataFrame | None = None, together: Callable = cooccurrence) -> DataFrame:
    """All word pairs i < j of each topic with marginal and joint counts and N.

    ``n``: the number of tokens (one row), if ``tf`` holds the topics' words only (``topic_terms``).
    """
    totals = totals if totals is not None else word_totals(tf)
    n = n if n is not None else tf.agg(F.sum("tf").alias("n"))
    tw = tw if tw is not None else topic_word_positions(topics, totals)
    a = tw.select("topic_id", F.col("idx").alias("i"), F.col("word").alias("wa"))
    b = tw.select("topic_id", F.col("idx").alias("j"), F.col("word").alias("wb"))
    pairs = a.join(b, "topic_id").where(F.col("i") < F.col("j"))
    pairs = pairs.join(together(tf, tw, key), ["topic_id", "i", "j"], "left")
    # a repeated word pairs with itself as 0 (the co-occurrence diagonal is zeroed)
    pairs = pairs.withColumn("joint", F.when(F.col("wa") == F.col("wb"), F.lit(0)).otherwise(
        F.coalesce(F.col("joint"), F.lit(0))))
    f = totals.select("word", "freq")
    pairs = (pairs.join(f.select(F.col("word").alias("wb"), F.col("freq").alias("fb")), "wb")
             .join(f.select(F.col("word").alias("wa"), F.col("freq").alias("fa")), "wa"))
    return pairs.crossJoin(n)


def topic_coherence(tf: DataFrame, topics: DataFrame, positive: bool = True, key: str = "doc_id",
                    n: DataFrame | None = None, together: Callable = cooccurrence) -> DataFrame:
    """Mean N(P)PMI over the word pairs of each topic; fewer than 2 known words -> 0."""
    both = topic_coherence_variants(tf, topics, key, n, together)
    col = "coherence" if positive else "coherence_npmi"
    return both.select("topic_id", "n_words", F.col(col).alias("coherence"))


def topic_coherence_variants(tf: DataFrame, topics: DataFrame, key: str = "doc_id", n: DataFrame | None = None,
                             together: Callable = cooccurrence) -> DataFrame:
    """N4, both variants from one pass over the pairs: ``coherence`` (NPPMI) and ``coherence_npmi``.

    The topic and topic-word tables are tiny and read several times; the latter is stored.
    """
    topics = topics.select("topic_id", "words")
    totals = word_totals(tf)
    tw = stored(topic_word_positions(topics, totals), "topic-words")
    pairs = topic_pairs(tf, topics, key, totals, tw, n, together)
    sums = pairs.groupBy("topic_id").agg(F.sum(nppmi("fb", "fa", "joint", "n")).alias("sp"),
                                         F.sum(npmi("fb", "fa", "joint", "n")).alias("sn"))
    sizes = tw.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_words"))
    out = topics.select("topic_id").join(sizes, "topic_id", "left").join(sums, "topic_id", "left")
    out = out.fillna(0, subset=["n_words"])
    comb = F.col("n_words") * (F.col("n_words") - 1) / 2

    def mean(s: str) -> Column:
        return F.when(F.col("n_words") < 2, F.coalesce(F.col(s), F.lit(0.0))).otherwise(
            F.coalesce(F.col(s), F.lit(0.0)) / comb)

    return out.select("topic_id", "n_words", mean("sp").alias("coherence"), mean("sn").alias("coherence_npmi"))


def avg_coherence(coherence: DataFrame) -> DataFrame:
    """N5."""
    return coherence.agg(F.avg("coherence").alias("avg_coherence"))


def topic_diversity(topics: DataFrame, *by: str) -> DataFrame:
    """Unique words over all topic words, for each value of the columns ``by`` apart."""
    w = topics.select(*by, F.explode("words").alias("word"))
    return w.groupBy(*by).agg(F.try_divide(F.count_distinct("word").cast("double"), F.count(F.lit(1)).cast("double"))
                 .alias("diversity"))


# ------------------------------------------------------------------ N15 ----
def class_tfidf(toks: DataFrame, clusters: DataFrame, stop: DataFrame | None = None, key: str = "doc_id",
                label: str = "topic_id") -> DataFrame:
    """c-TF-IDF per (topic, word): L1-normalised class term frequency x ln(1 + A / f(word)),
    A = integer mean of words per class, f = word frequency over all classes.

    Tokens that carry their ``label`` are counted where they are; others are
    joined to their document's row of ``clusters`` first, which moves every token.
    """
    t = toks if stop is None else toks.join(maybe_broadcast(stop.select("word"))[0], "word", "left_anti")
    t = t if label in toks.columns else t.join(clusters.select(key, label), key)
    # the class-term table (topics x vocabulary, small next to the corpus) feeds three aggregates:
    # cache it so the corpus is tokenised once
    tc = keep(t.groupBy(label, "word").agg(F.count(F.lit(1)).alias("tf")))
    f = tc.groupBy("word").agg(F.sum("tf").alias("f"))
    sizes = tc.groupBy(label).agg(F.sum("tf").alias("class_total"))
    avg = sizes.agg(F.floor(F.avg("class_total")).alias("A"))
    out = tc.join(f, "word").join(sizes, label).crossJoin(avg)
    return out.select(label, "word", "tf", _tfidf().alias("score"))


def _tfidf() -> Column:
    return (F.col("tf") / F.col("class_total")) * F.log(F.col("A") / F.col("f") + 1)


WORD_ROWS = 1 << 20  # counted words that one task holds at a time


def best_class_words(df: DataFrame, labels: dict[int, str], text: str, stop: DataFrame | None = None, n: int = 10) -> DataFrame:
    """(config, topic_id, word, score) for several ``labels`` (config -> column) of the same texts: c-TF-IDF as in
    ``class_tfidf``, of all words that may be among the ``n`` best of their topic.

    Texts are read once, and their tokens counted by all labels together. Then all rows of a word meet in one task, which
    knows its frequency and so the score in each topic, and lets go what is below the task's own n-th best.
    """
    first, *others = labels.values()
    t = tokens(df, text, first, also=tuple(others))
    t = t if stop is None else t.join(maybe_broadcast(stop.select("word"))[0], "word", "left_anti")
    counted = stored(t.groupBy(first, *others, "word").agg(F.count(F.lit(1)).alias("tf")), "class-terms")
    each = F.array(*[F.struct(F.lit(i).alias("config"), F.col(c).alias("topic_id")) for i, c in labels.items()])
    sizes = counted.groupBy(first, *others).agg(F.sum("tf").alias("tf")).select(F.explode(each).alias("_c"), "tf")
    sizes = stored(sizes.groupBy("_c.config", "_c.topic_id").agg(F.sum("tf").alias("class_total")), "class-sizes")
    avg = sizes.groupBy("config").agg(F.floor(F.avg("class_total")).alias("A"))
    known = sizes.join(avg, "config").orderBy("config", "topic_id").collect()  # a row for each topic
    of = {i: [np.array([r[c] for r in known if r["config"] == i], kind) for c, kind in (("topic_id", np.int64), ("class_total", float), ("A", float))]
          for i in labels}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        words = table["word"].combine_chunks().dictionary_encode()
        code, size, tf = words.indices.to_numpy().astype(np.int64), len(words.dictionary), table["tf"].to_numpy()
        f = np.bincount(code, tf, size)
        for i, column in labels.items():
            topics, totals, average = of[i]
            cell, place = np.unique(np.searchsorted(topics, table[column].to_numpy()) * size + code, return_inverse=True)
            topic, word, here = cell // size, cell % size, np.bincount(place, tf)
            score = here / totals[topic] * np.log(average[topic] / f[word] + 1)
            order = np.lexsort((-score, topic))
            head = np.searchsorted(topic, np.arange(len(topics)))
            enough = np.bincount(topic, minlength=len(topics)) >= n
            least = np.full(len(topics), -np.inf)
            least[enough] = score[order[head[enough] + n - 1]] * (1 - 1e-9)
            some = np.flatnonzero(score >= least[topic])
            yield from pa.table({"config": np.full(len(some), i, np.int32), "topic_id": topics[topic[some]].astype(np.int32),
                                 "word": words.dictionary.take(pa.array(word[some])), "tf": here[some].astype(np.int64),
                                 "f": f[word[some]].astype(np.int64)}).to_batches()

    parts = max(1, -(-counted.count() // WORD_ROWS))
    picked = counted.repartition(parts, "word").mapInArrow(pick, "config int, topic_id int, word string, tf long, f long")
    small = maybe_broadcast(sizes.join(avg, "config"))[0]
    return picked.join(small, ["config", "topic_id"]).select("config", "topic_id", "word", _tfidf().alias("score"))


def ranked_words(scores: DataFrame, n: int = 10, label: str = "topic_id") -> DataFrame:
    """N best words per topic (score desc, word asc) with their rank.

    ``row_number() <= n`` lets Spark insert a partial window-group limit before
    the shuffle, so a huge topic sends only its local top n per task.
    """
    w = Window.partitionBy(label).orderBy(F.desc("score"), F.asc("word"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_words(scores: DataFrame, n: int = 10, label: str = "topic_id") -> DataFrame:
    """Top words per topic as a ``words`` array in rank order."""
    top = ranked_words(scores, n, label)
    return (top.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("_r"))
            .select(label, F.expr("transform(_r, x -> x.word)").alias("words")))


def topic_info(clusters: DataFrame, words: DataFrame, label: str = "topic_id") -> DataFrame:
    """Topic id, size (documents), top words."""
    sizes = clusters.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(words, label, "left")


def with_topic_label(df: DataFrame, topics: DataFrame, label: str = "topic_id") -> DataFrame:
    """Attach topic words and ``topic_label`` = words joined by ', ' (topics table is small)."""
    t = topics.select(label, F.col("words").alias("keywords"), F.array_join("words", ", ").alias("topic_label"))
    return df.join(maybe_broadcast(t)[0], label, "left")


def word_counts(df: DataFrame, stop: DataFrame, text: str = "text", n: int = 200) -> DataFrame:
    """Word frequencies of posts without stop words, pure digits or a trailing 's; a plural in s counts as
    its singular if that occurs.

    The per-token clean-up is done once per text: tokens are maximal runs of
    word characters and apostrophes, so stripping "'s" at a run end and then
    every apostrophe on the whole text yields the same tokens as doing it
    token by token, with two regex passes per text instead of three per token.
    """
    low = F.lower(F.col(text))
    low = F.regexp_replace(low, r"'s(?![\p{L}\p{N}_'])", "")
    low = F.replace(low, F.lit("'"), F.lit(""))
    toks = spread(df).where(F.col(text).isNotNull()).select(
        F.explode(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]{2,}"), 0)).alias("word"))
    toks = toks.where(F.translate("word", "0123456789", "") != "")
    toks = toks.join(maybe_broadcast(stop.select("word"))[0], "word", "left_anti")
    # a stem has its singular and its plural at the most, of which the singular comes first
    stem = F.when(F.col("word").endswith("s") & ~F.col("word").endswith("ss"), F.expr("left(word, length(word) - 1)")).otherwise(F.col("word"))
    counts = toks.groupBy(stem.alias("_stem")).agg(F.min("word").alias("word"), F.count(F.lit(1)).alias("count")).drop("_stem")
    return counts.orderBy(F.desc("count"), F.asc("word")).limit(n)
