"""Registered queries: clustering, topic merging, model selection and enrichment.

These are iterative or model-fitting operators; the driver checks them
rows-only, and tests pin their invariants (sizes, label sets, ranges).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from crisismap.operators import clustering as C
from crisismap.operators import scoring as SC
from crisismap.plans import enrich as E
from crisismap.plans import fixtures as fx
from crisismap.session import stored
from crisismap.sources.tables import read_table

QUERIES: dict = {}
ORACLE: dict = {}


def register(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@register("kmeans_topics")
def kmeans_topics_q(spark, base):
    """KMeans (k = 10, seed 42) over the embeddings; each vector's topic."""
    return C.cluster_kmeans(fx.embeddings(spark, base), 10).select("vec_id", "topic_id")


@register("density_topics")
def density_topics_q(spark, base):
    """N14 (re-aimed): grid density clustering of the 2 leading components; noise = -1."""
    red = SC.reduce_dims(fx.embeddings(spark, base), k=2)
    out = C.cluster_density(red, "vec_id", "reduced", eps=0.25, min_pts=5, min_cluster_size=20)
    return out.select("vec_id", "label", "topic_id")


@register("reduce_topics")
def reduce_topics_q(spark, base):
    """N18 (re-aimed): the 10 classes merged down to 5 topics by vector similarity."""
    emb = fx.embeddings(spark, base).withColumn("topic_id", F.col("label"))
    out, _ = C.reduce_topics(emb, 5)
    return out.select("vec_id", "label", "topic_id")


def _embedded(spark, base):
    docs = read_table(spark, base, "documents", ["doc_id", "text"]).withColumnRenamed("text", "cleaned_text")
    return SC.hashed_embed(docs, text="cleaned_text", dim=64)


@register("hdbscan_topics")
def hdbscan_topics_q(spark, base):
    """N12 + N14: hierarchical density clusters (at least 100 texts) of 5 components of the embedded documents."""
    docs = stored(_embedded(spark, base).select("doc_id", "embedding"), "embedded")
    return E.hierarchical_topics(docs, min_cluster_size=100).select("doc_id", "topic_id")


@register("zero_shot_topics")
def zero_shot_topics_q(spark, base):
    """Documents near a given topic (the mean of each language's texts) go to it, all others are clustered."""
    docs = stored(_embedded(spark, base).select("doc_id", "embedding"), "embedded")
    lang = read_table(spark, base, "documents", ["doc_id", "lang"])
    ids = lang.where("lang IS NOT NULL").select("lang").distinct().withColumn("topic_id", F.row_number().over(Window.orderBy("lang")) - 1)
    means = docs.join(lang, "doc_id").join(ids, "lang")
    given = C.topic_vectors(means).select("topic_id", F.col("vec").alias("embedding"))
    return E.fit_topics(docs, "hdbscan", 10, zero_shot=given, least_similarity=0.9, min_cluster_size=20).select("doc_id", "topic_id")


@register("topic_grid")
def topic_grid_q(spark, base):
    """Hdbscan and kmeans x {10, 20, 30} over embedded documents, run side by side."""
    return E.evaluate_topics(stored(_embedded(spark, base), "embedded"), ks=(10, 20, 30), algos=("hdbscan", "kmeans"), stop=fx.stopwords(spark),
                             parallel=6, min_cluster_size=100)


@register("topic_grid_samples")
def topic_grid_samples_q(spark, base):
    """The kmeans grid over nested samples of a quarter, a half and all of the documents."""
    docs = stored(_embedded(spark, base), "embedded")
    n = docs.count()
    return E.evaluate_topics(docs, ks=(10,), algos=("kmeans",), stop=fx.stopwords(spark), parallel=3,
                             sample_sizes=[max(1, n // 4), max(1, n // 2), n])


@register("nested_samples")
def nested_samples_q(spark, base):
    """The smallest of the samples of 100, 300 and 1,000 documents that holds a document."""
    docs = read_table(spark, base, "documents", ["doc_id", "source"])
    return E.nested_samples(docs, [100, 300, 1000]).select("doc_id", "source", "sample")


@register("enrich")
def enrich_q(spark, base):
    """Clean -> embed -> best topic config -> topic labels -> emotions -> disaster flag."""
    posts = fx.posts(spark, base).select("cid", "crawl_seq", "text", "disaster_related")
    docs = read_table(spark, base, "documents", ["doc_id", "text"])
    lab = read_table(spark, base, "labels", ["doc_id", "quality"])
    labelled = docs.join(lab, "doc_id").select("text", F.col("quality").alias("label"))
    out = E.enrich(posts, labelled, fx.stopwords(spark), emotions=fx.emotion_rows(spark, base))
    return out.select("cid", "crawl_seq", "topic_id", "topic_label", "anger", "fear", "joy", "sadness",
                      "no_emotion", "disaster_related")


@register("sample_posts")
def sample_posts_q(spark, base):
    """K4 / K5: reproducible 100-post sample (hash order on the key, independent of partitioning)."""
    posts = fx.posts(spark, base).withColumn("doc_key", F.concat_ws("#", "cid", "crawl_seq"))
    return E.sample_rows(posts, 100, seed=42, key="doc_key").select("cid", "crawl_seq", "text")


@register("best_topic_config")
def best_topic_config_q(spark, base):
    """K1: the best configuration of the whole grid by train quality (top-1 is the feature)."""
    return E.best_config(topic_grid_q(spark, base))
