import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from crisismap.operators import clustering as C
from crisismap.operators import harvest as H
from crisismap.operators import posts as P
from crisismap.operators import scoring as SC
from crisismap.operators import topics as T
from crisismap.plans import enrich as E
from crisismap.plans import fixtures as fx


def _docs(spark):
    docs = [(i, f"{w} {w} rain number{i % 3}") for i, w in enumerate(["flood", "fire", "quake"] * 20)]
    return SC.hashed_embed(spark.createDataFrame(docs, "doc_id long, cleaned_text string"), "cleaned_text", 16)


def test_grid_reports_failures_and_counts_noise(spark):
    docs = _docs(spark)
    rows = E.evaluate_topics(docs, ks=(3, None, "auto"), algos=("kmeans", "density", "nothing"), min_cluster_size=70).collect()
    by = {(r.clustering_algorithm, r.nr_topics, r.status[:6]) for r in rows}
    assert ("kmeans", 3, "ok") in by and ("density", None, "ok") in by and ("nothing", None, "failed") in by
    assert len(rows) == 7  # kmeans takes a number of topics only
    density = next(r for r in rows if r.clustering_algorithm == "density")
    assert density.actual_topics == 1  # every cluster is too small, so all is noise: one topic, with words and scores
    assert E.best_config(spark.createDataFrame(rows)).first().status == "ok"


@pytest.mark.parametrize("parallel", [1, 3])
def test_grid_ends_where_a_fit_fails(spark, monkeypatch, parallel):
    def lost(*args, **kwargs):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(E, "hierarchical_topics", lost)
    with pytest.raises(RuntimeError, match="executor lost"):  # the kmeans rows alone must not pass for the whole grid
        E.evaluate_topics(_docs(spark), ks=(3,), algos=("kmeans", "hdbscan"), parallel=parallel)


def test_best_config_and_enrich_need_the_whole_grid(spark, monkeypatch):
    from crisismap.plans import q_topics

    def lost(*args, **kwargs):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(E, "hierarchical_topics", lost)
    with pytest.raises(RuntimeError, match="executor lost"):
        q_topics.best_topic_config_q(spark, SF_SMALL).collect()
    posts = _docs(spark).selectExpr("string(doc_id) AS cid", "cleaned_text AS text", "0 AS disaster_related")
    labelled = posts.selectExpr("text", "int(text LIKE 'flood%') AS label")
    emotions = labelled.selectExpr("text", "label AS anger")
    more = {"ks": (2,), "dim": 16, "emotions": emotions, "emotion_labels": ("anger",)}
    with pytest.raises(RuntimeError, match="executor lost"):
        E.enrich(posts, labelled, **more)
    with pytest.raises(ValueError, match="unknown clustering"):
        E.enrich(posts, labelled, algos=("kmeans", "nothing"), **more)


def test_sample_is_reproducible(spark):
    docs = _docs(spark)
    a = [r.doc_id for r in E.sample_rows(docs, 7).collect()]
    assert a == [r.doc_id for r in E.sample_rows(docs.repartition(5), 7).collect()] and len(a) == 7
    assert E.sample_rows(docs, 1000).count() == 60


def test_nested_samples_equal_sorted_ones(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") * 2).alias("twice")).repartition(7)
    got = E.nested_samples(docs, [40, 7, 900, 9000], key="doc_id").collect()
    for i, size in enumerate([7, 40, 900, 9000]):
        mine = {(r.doc_id, r.twice) for r in got if r.sample <= i}
        assert mine == {(r.doc_id, r.twice) for r in E.sample_rows(docs, size).collect()} and len(mine) == min(size, 5000)
    assert E.nested_samples(docs.limit(0), [5]).count() == 0


def test_zero_shot_parts_are_clustered_apart(spark):
    docs = _docs(spark)
    flood = docs.where("cleaned_text LIKE 'flood%'").limit(1).select(F.lit(0).alias("topic_id"), "embedding")
    alone = {r.doc_id: r.topic_id for r in E.fit_topics(docs, "kmeans", 2, zero_shot=flood, least_similarity=0.8).collect()}
    words = {r.doc_id: r.cleaned_text.split()[0] for r in docs.collect()}
    assert len(alone) == 60  # every document in exactly one part
    assert {alone[i] for i in words if words[i] == "flood"} == {0}
    parts = [{alone[i] for i in words if words[i] == w} for w in ("fire", "quake")]
    assert set.union(*parts) == {1, 2} and not parts[0] & parts[1]
    none = E.fit_topics(docs, "kmeans", 3, zero_shot=flood, least_similarity=1.1)
    assert {r.topic_id for r in none.select("topic_id").distinct().collect()} == {1, 2, 3}


def test_auto_merges_alike_topics(spark):
    rng = __import__("random").Random(1)
    groups = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    rows = [(i, 3 * g + j, [x + rng.uniform(0, 0.03) for x in v]) for g, v in enumerate(groups) for j in range(3) for i in range(5)]
    out = C.merge_alike(spark.createDataFrame(rows, "id long, topic_id int, embedding array<double>"))
    pairs = {(r.topic_id, r.old // 3) for r in out.withColumn("old", F.lit(0)).collect()}
    assert {t for t, _ in pairs} == {0, 1, 2}


def test_enrich_refuses_repeated_keys(spark):
    posts = spark.createDataFrame([("a", "x y"), ("a", "x y")], "cid string, text string")
    with pytest.raises(ValueError, match="repeats"):
        E.enrich(posts, posts)


def test_class_words_count_each_text_once(spark):
    docs = spark.createDataFrame([(1, "aa bb aa", 0), (2, "bb cc", 1)], "doc_id long, text string, topic_id int")
    carried = T.class_tfidf(T.tokens(docs, also=("topic_id",)), docs)
    joined = T.class_tfidf(T.tokens(docs), docs)
    rows = {(r.topic_id, r.word): r.tf for r in carried.collect()}
    assert rows == {(0, "aa"): 2, (0, "bb"): 1, (1, "bb"): 1, (1, "cc"): 1}
    assert carried.exceptAll(joined).count() == 0


def test_multilabel_scores(spark):
    rows = [("so angry and sad", 1, 1), ("angry now", 1, 0), ("sad day", 0, 1), ("plain text", 0, 0)] * 10
    train = spark.createDataFrame(rows, "text string, anger int, sadness int")
    model = SC.train_multilabel(train, ["anger", "sadness"], num_features=1 << 10)
    df = spark.createDataFrame([(1, "angry and sad"), (2, "angry"), (3, None)], "id int, body string")
    got = {r.id: r for r in SC.apply_multilabel(model, df, text="body").collect()}
    assert got[1].p_anger > 0.5 and got[1].p_sadness > 0.5 and got[2].p_anger > 0.5 and got[2].p_sadness < 0.5
    assert got[3].body is None and set(got[1].asDict()) == {"id", "body", "p_anger", "p_sadness"}


def test_user_model_and_encoder(spark):
    rows = [(i, f"{'vile awful' if i % 3 == 0 else 'kind calm'} words{i % 5}", int(i % 3 == 0)) for i in range(60)]
    train = spark.createDataFrame(rows, "doc_id long, text string, label int")
    more = spark.createDataFrame([(100, "awful and vile"), (101, "calm"), (102, None), (103, "")], "doc_id long, text string")
    got = {r.doc_id: r.p_toxic for r in SC.score_texts(more, SC.word_model(train), ["clean", "toxic"]).collect()}
    assert got[100] > 0.9 > 0.3 > got[101] and got[102] == got[103] == pytest.approx(21 / 62, abs=1e-3)
    vectors = {r.doc_id: r.embedding for r in SC.embed(more.union(more.limit(1)), SC.trigram_encoder(32), "text", 32).collect()}
    assert {len(v) for v in vectors.values()} == {32} and not any(vectors[102]) and not any(vectors[103])
    assert sum(x * x for x in vectors[100]) == pytest.approx(1, abs=1e-5)


def test_encoders(spark):
    docs = _docs(spark)
    red = SC.reduce_dims(docs, k=3)
    assert {len(r.reduced) for r in red.collect()} == {3}
    norms = [sum(x * x for x in r.embedding) for r in docs.collect()]
    assert all(abs(n - 1) < 1e-5 for n in norms)


def test_merged_topics_are_the_similar_ones(spark):
    rows = [(i, t, v) for t, v in enumerate([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.1, 0.9], [-1.0, 0.0]]) for i in range(3)]
    df = spark.createDataFrame(rows, "id int, topic_id int, embedding array<double>")
    out, mapping = C.reduce_topics(df, 3)
    new = {r.old: r.new for r in mapping.collect()}
    assert new[0] == new[1] and new[2] == new[3] and len(set(new.values())) == 3
    assert out.count() == 15


def test_null_crawl_order_keeps_a_whole_row(spark):
    df = spark.createDataFrame([("a", None, "x"), ("a", None, "x"), ("b", None, "late"), ("b", 3, "first")],
                               "cid string, crawl_seq int, text string")
    assert {r.cid: r.text for r in P.dedupe_keep_first(df).collect()} == {"a": "x", "b": "first"}


def test_empty_image_ref_gives_no_url(spark):
    from crisismap.schemas import RAW_POST

    record = '{"cid":"a","record":{"embed":{"$type":"app.bsky.embed.images","images":[{"image":{"ref":{}}}]}}}'
    raw = spark.createDataFrame([(record,)], "j string").select(F.from_json("j", RAW_POST).alias("p")).select("p.*")
    assert P.parse_posts(raw).first().urls == []


def test_every_interval_that_begins_is_a_task(spark):
    kws = spark.createDataFrame([("a",), ("b",), ("a",)], "keyword string")
    def since(end):
        return sorted({str(r.since)[11:16] for r in H.harvest_tasks(kws, "2024-09-05 00:00:00", end).collect()})
    assert since("2024-09-05 01:10:00") == ["00:00", "00:30", "01:00"]
    assert since("2024-09-05 00:10:00") == ["00:00"]
    assert since("2024-09-05 00:00:00") == []


def test_keywords_in_several_automata(spark, monkeypatch):
    posts = fx.posts(spark, SF_SMALL).select("cid", "crawl_seq", "ts", "text")
    whole = H.harvest_match(posts, fx.keywords(spark), H.day_span(posts), tiebreak=("crawl_seq",))
    monkeypatch.setattr("crisismap.operators.multipattern.AUTOMATON_BYTES", 12)  # several automata
    parts = H.harvest_match(posts, fx.keywords(spark), H.day_span(posts), tiebreak=("crawl_seq",))
    assert whole.count() > 0 and whole.exceptAll(parts.select(whole.columns)).count() == 0
