"""Registered queries: similarity, labels and model scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from crisismap.operators import scoring as SC
from crisismap.operators import similarity as SIM
from crisismap.operators import stats as S
from crisismap.plans import fixtures as fx
from crisismap.plans.oracle_views import with_views
from crisismap.sources.tables import read_table

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None, views=()):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        return fn
    return deco


RETRIEVE_T = 0.3
ZERO_SHOT_T = 0.25


def _cos_sql(a: str, b: str) -> str:
    dot = f"list_sum(list_transform(range(1, len({a}) + 1), i -> CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
    na = f"sqrt(list_sum(list_transform({a}, x -> CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
    nb = f"sqrt(list_sum(list_transform({b}, x -> CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
    return f"(CASE WHEN {na} * {nb} = 0 THEN 0.0 ELSE {dot} / ({na} * {nb}) END)"


SIMS_SQL = f"""s AS (SELECT p.query_id, e.vec_id, e.label, {_cos_sql('e.embedding', 'p.embedding')} AS sim
  FROM prototypes p, embeddings e)"""
BEST_SQL = f"""{SIMS_SQL},
b AS (SELECT vec_id, label, max(sim) AS best_sim, arg_max(query_id, struct_pack(s := sim, n := -query_id)) AS q
      FROM s GROUP BY vec_id, label),
pr AS (SELECT vec_id, label, best_sim, CASE WHEN best_sim > {ZERO_SHOT_T} THEN q ELSE -1 END AS prediction FROM b)"""


@register("retrieve_samples", views=("prototypes",), sql=f"""
WITH {SIMS_SQL},
h AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS rn FROM s
      WHERE sim > {RETRIEVE_T})
SELECT p.query_id, CAST(count(h.vec_id) AS INTEGER) AS n_samples,
  coalesce(string_agg(CAST(h.vec_id AS VARCHAR), '|' ORDER BY h.vec_id), '') AS samples
FROM prototypes p LEFT JOIN (SELECT * FROM h WHERE rn <= 10) h USING (query_id) GROUP BY p.query_id""")
def retrieve_samples_q(spark, base):
    """N22 + J11 + W2: first 10 texts (in id order) per class prototype with cosine > t."""
    out = SIM.retrieve(fx.embeddings(spark, base), fx.label_prototypes(spark, base), "vec_id", "embedding",
                       threshold=RETRIEVE_T, n=10)
    return out.select(F.col("query_id"), F.size("samples").alias("n_samples"),
                      F.array_join(F.transform("samples", lambda x: x.cast("string")), "|").alias("samples"))


@register("zero_shot_assign", views=("prototypes",), sql=f"""
WITH {BEST_SQL} SELECT vec_id, CAST(prediction AS INTEGER) AS prediction, round(best_sim, 6) AS best_sim FROM pr""")
def zero_shot_assign_q(spark, base):
    """Each vector's best prototype, -1 at or below the threshold."""
    out = SIM.best_match(fx.embeddings(spark, base), fx.label_prototypes(spark, base), "vec_id", "embedding",
                         threshold=ZERO_SHOT_T)
    return out.select("vec_id", F.col("prediction").cast("int").alias("prediction"),
                      F.round("best_sim", 6).alias("best_sim"))


@register("zero_shot_accuracy", views=("prototypes",), sql=f"""
WITH {BEST_SQL} SELECT round(avg(CAST(prediction = label AS DOUBLE)), 6) AS accuracy, count(*) AS n FROM pr""")
def zero_shot_accuracy_q(spark, base):
    """N23 + A18: zero-shot classification accuracy against the true labels."""
    emb = fx.embeddings(spark, base)
    pred = SIM.best_match(emb, fx.label_prototypes(spark, base), "vec_id", "embedding", threshold=ZERO_SHOT_T)
    joined = pred.join(emb.select("vec_id", "label"), "vec_id")
    acc = S.accuracy(joined, "prediction", "label")
    return acc.select(F.round("accuracy", 6).alias("accuracy")).crossJoin(joined.agg(F.count(F.lit(1)).alias("n")))


@register("vector_lookup", sql="""
WITH r AS (SELECT embedding, embedding[1:5] AS reduced, vec_id AS seq FROM embeddings
           UNION ALL SELECT embedding, list_transform(embedding[1:5], x -> -x), vec_id + 1000000 FROM embeddings
           WHERE label = 0),
d AS (SELECT embedding, arg_max(reduced, seq) AS reduced FROM r GROUP BY embedding)
SELECT e.vec_id, round(CAST(d.reduced[1] AS DOUBLE), 6) AS r1,
  round(list_sum(list_transform(d.reduced, x -> CAST(x AS DOUBLE))), 6) AS rsum
FROM embeddings e JOIN d ON e.embedding = d.embedding""")
def vector_lookup_q(spark, base):
    """Exact-vector join to precomputed reduced vectors; later duplicates win."""
    emb = fx.embeddings(spark, base)
    red = emb.select("embedding", F.slice("embedding", 1, 5).alias("reduced"), F.col("vec_id").alias("seq"))
    dup = emb.where("label = 0").select("embedding", F.transform(F.slice("embedding", 1, 5), lambda x: -x)
                                        .alias("reduced"), (F.col("vec_id") + 1000000).alias("seq"))
    joined, _missing = SIM.lookup_reduced(emb.select("vec_id", "embedding"), red.unionByName(dup))
    return joined.select("vec_id", F.round(F.col("reduced")[0].cast("double"), 6).alias("r1"),
                         F.round(F.expr("aggregate(reduced, 0D, (s, x) -> s + CAST(x AS DOUBLE))"), 6).alias("rsum"))


@register("threshold_labels", views=("posts",), sql="""
SELECT cid, crawl_seq, p_anger > 0.5 AS anger, p_fear > 0.5 AS fear, p_joy > 0.5 AS joy, p_sadness > 0.5 AS sadness,
  NOT (p_anger > 0.5 OR p_fear > 0.5 OR p_joy > 0.5 OR p_sadness > 0.5) AS no_emotion FROM posts""")
def threshold_labels_q(spark, base):
    """Multi-label emotions, strict p > 0.5, plus no_emotion."""
    out = SC.threshold_labels(fx.posts(spark, base), [f"p_{e}" for e in fx.EMOTIONS], 0.5)
    return out.select("cid", "crawl_seq", *fx.EMOTIONS, "no_emotion")


@register("argmax_label", views=("posts",), sql="""
SELECT cid, crawl_seq,
  CASE WHEN p_anger = greatest(p_anger, p_fear, p_joy, p_sadness) THEN 'anger'
       WHEN p_fear = greatest(p_anger, p_fear, p_joy, p_sadness) THEN 'fear'
       WHEN p_joy = greatest(p_anger, p_fear, p_joy, p_sadness) THEN 'joy' ELSE 'sadness' END AS sentiment,
  CASE WHEN p_sadness > p_joy THEN 1 ELSE 0 END AS disaster_flag FROM posts""")
def argmax_label_q(spark, base):
    """Single label by argmax (first wins ties) and the binary LABEL_1 rule."""
    p = fx.posts(spark, base)
    return p.select("cid", "crawl_seq", SC.argmax_label([f"p_{e}" for e in fx.EMOTIONS]).alias("sentiment"),
                    SC.binary_label(["p_joy", "p_sadness"], positive="sadness").alias("disaster_flag"))


@register("score_texts")
def score_texts_q(spark, base):
    """Emotions that don't exclude each other, fitted on the labelled posts and scored for every post text."""
    p = fx.posts(spark, base).where(F.col("text").isNotNull()).select("cid", "crawl_seq", "text")
    model = SC.train_multilabel(fx.emotion_rows(spark, base), list(fx.EMOTIONS))
    out = SC.apply_multilabel(model, p)
    probs = [f"p_{e}" for e in fx.EMOTIONS]
    return out.select("cid", "crawl_seq", *probs, SC.argmax_label(probs).alias("strongest"))


@register("word_model_scores")
def word_model_scores_q(spark, base):
    """N7 + X4: a user model (naive Bayes of the toxic labels) scored over Arrow batches for every document."""
    docs = read_table(spark, base, "documents", ["doc_id", "text"])
    lab = read_table(spark, base, "labels", ["doc_id", "toxic"]).withColumnRenamed("toxic", "label")
    model = SC.word_model(docs.join(lab, "doc_id"))
    return SC.score_texts(docs, model, ["clean", "toxic"]).select("doc_id", "p_clean", "p_toxic")


@register("trigram_embeddings")
def trigram_embeddings_q(spark, base):
    """N11 + X4: a user encoder (letter trigrams) over Arrow batches for every document."""
    docs = read_table(spark, base, "documents", ["doc_id", "text"])
    return SC.embed(docs, SC.trigram_encoder(64)).select("doc_id", "embedding")


@register("disaster_classifier")
def disaster_classifier_q(spark, base):
    """N7 + N9 in-repo default: TF-IDF + logistic regression fitted on the labelled documents, applied to all."""
    docs = read_table(spark, base, "documents", ["doc_id", "text"])
    lab = read_table(spark, base, "labels", ["doc_id", "quality"])
    train = docs.join(lab, "doc_id").withColumnRenamed("quality", "label")
    model = SC.train_text_classifier(train, num_features=1 << 16, max_iter=20)
    scored = SC.apply_classifier(model, docs, ["LABEL_0", "LABEL_1"])
    return scored.select("doc_id", "p_LABEL_0", "p_LABEL_1",
                         SC.binary_label(["p_LABEL_0", "p_LABEL_1"]).alias("disaster_related"))


@register("embed_texts")
def embed_texts_q(spark, base):
    """N11 in-repo default encoder (hashed term vectors, no training) over whole documents."""
    docs = read_table(spark, base, "documents", ["doc_id", "text"])
    return SC.hashed_embed(docs, dim=64).select("doc_id", "embedding")


@register("reduce_dims")
def reduce_dims_q(spark, base):
    """N12 (re-aimed): 5 principal components of the L2-normalised embeddings."""
    return SC.reduce_dims(fx.embeddings(spark, base), k=5).select("vec_id", "reduced")
