import math

from pyspark.sql import functions as F

from crisismap.operators import topics as T


def test_pmi_family_edges(spark):
    rows = [(10, 10, 0, 100), (10, 10, 100, 100), (50, 50, 150, 100), (50, 50, 5, 100), (10, 20, 5, 100)]
    df = spark.createDataFrame(rows, "f1 long, f2 long, j long, n long")
    got = df.select(T.pmi("f1", "f2", "j", "n").alias("pmi"), T.npmi("f1", "f2", "j", "n").alias("npmi"),
                    T.nppmi("f1", "f2", "j", "n").alias("nppmi")).collect()
    assert got[0].npmi == -1.0 and got[0].nppmi == 0.0 and got[0].pmi is None
    assert got[1].npmi is None  # joint = N divides by zero (documented)
    assert got[2].npmi < 0 < got[2].pmi  # joint > N flips the sign (reference formula)
    assert got[3].pmi < 0 and got[3].nppmi == 0.0  # negative PMI is clipped by the positive variant
    assert math.isclose(got[4].pmi, math.log2(0.05 / (0.1 * 0.2)))


def test_coherence_edge_topics(spark):
    docs = spark.createDataFrame([(1, "flood river rain"), (2, "flood river"), (3, "rain sun"), (4, "sun sun")],
                                 "doc_id long, text string")
    tf = T.term_counts(T.tokens(docs))
    topics = spark.createDataFrame([(0, ["flood", "river"]), (1, ["flood", "unknownword", "rain"]),
                                    (2, ["sun", "sun"]), (3, ["rain"]), (4, ["zz"])], "topic_id int, words array<string>")
    out = {r.topic_id: r for r in T.topic_coherence(tf, topics).collect()}
    assert out[1].n_words == 2  # unknown word dropped, order kept
    assert out[2].n_words == 2 and out[2].coherence == 0.0  # repeated word pairs with itself as 0
    assert out[3].coherence == 0.0 and out[4].n_words == 0 and out[4].coherence == 0.0
    # flood/river: joint = 1*1 + 1*1 = 2 of N = 11 tokens
    n, j, f = 11, 2, 2
    expected = max(0.0, math.log2((j / n) / ((f / n) * (f / n)))) / -math.log2(j / n)
    assert math.isclose(out[0].coherence, expected)


def test_diversity(spark):
    t = spark.createDataFrame([(0, ["a", "b"]), (1, ["b", "c"])], "topic_id int, words array<string>")
    assert math.isclose(T.topic_diversity(t).first()[0], 3 / 4)


def test_ctfidf_ranks(spark):
    docs = spark.createDataFrame([(1, "flood flood river", 0), (2, "flood rain", 0), (3, "sun beach", 1)],
                                 "doc_id long, text string, topic_id int")
    words = {r.topic_id: r.words for r in T.top_words(T.class_tfidf(T.tokens(docs), docs), 2).collect()}
    assert words[0][0] == "flood" and set(words[1]) == {"beach", "sun"}


def test_plurals_count_as_their_singular(spark):
    posts = spark.createDataFrame([("Floods flood flood's glass glas",), ("bus buses floods rivers the this",), (None,), ("",)], "text string")
    stop = spark.createDataFrame([("the",), ("this",)], "word string")
    got = {r.word: r["count"] for r in T.word_counts(posts, stop).collect()}
    assert got == {"flood": 4, "glass": 1, "glas": 1, "bus": 1, "buses": 1, "rivers": 1}


def test_pairs_formed_in_tasks_equal_joined_ones(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [(None if d % 9 == 0 else d % 40, f"w{rng.randrange(12)}", 1 + rng.randrange(4)) for d in range(400)]
    tf = spark.createDataFrame(rows, "doc_id int, word string, tf long").groupBy("doc_id", "word").agg(F.sum("tf").alias("tf"))
    places = [((c, t), i, w) for c in range(2) for t in (-1, 5) for i, w in enumerate(rng.sample([f"w{n}" for n in range(15)], 6) + ["w1"])]
    words = spark.createDataFrame(places, "topic_id struct<config: int, topic_id: int>, idx int, word string")
    want = sorted(map(str, T.cooccurrence(tf, words).collect()))
    for size in (1 << 20, 30, 1):  # several tasks, several slices of a task
        monkeypatch.setattr(T, "WORD_ROWS", size)
        assert sorted(map(str, T.cooccurrence_in_tasks(tf, words).collect())) == want and len(want) >= 50
    assert T.cooccurrence_in_tasks(tf.limit(0), words).count() == T.cooccurrence_in_tasks(tf, words.limit(0)).count() == 0


def test_best_words_of_several_labels_equal_those_of_each(spark, monkeypatch):
    import random

    rng = random.Random(5)
    rows = [(i, " ".join(f"word{int(rng.expovariate(0.05))}" for _ in range(30)) if i % 7 else None, i % 3 - 1, i % 5) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, a int, b int")
    stop = spark.createDataFrame([("word1",)], "word string")
    for size in (1 << 20, 50):
        monkeypatch.setattr(T, "WORD_ROWS", size)
        got = T.best_class_words(docs, {0: "a", 4: "b"}, "text", stop, 4).withColumn("topic_id", F.struct("config", "topic_id"))
        mine = {(r.topic_id.config, r.topic_id.topic_id): r.words for r in T.top_words(got, 4).collect()}
        want = {}
        for config, column in ((0, "a"), (4, "b")):
            one = docs.withColumnRenamed(column, "topic_id")
            words = T.top_words(T.class_tfidf(T.tokens(one, also=("topic_id",)), one, stop), 4).collect()
            want |= {(config, r.topic_id): r.words for r in words}
        assert mine == want and len(want) == 8
