"""Model-backed scoring, labels and embeddings.

Inference runs where the data is: ``predict_batch_udf`` feeds Arrow batches
of a user model to every executor (the reference's GPU batches); the in-repo
default models are Spark ML pipelines trained and applied distributed.
"""

from __future__ import annotations

import math
import re
from typing import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from crisismap.functions.text import strip_prefix
from crisismap.session import keep


def threshold_labels(df: DataFrame, prob_cols: list[str], min_score: float = 0.5,
                     none_name: str = "no_emotion") -> DataFrame:
    """One boolean per class, ``p > min_score`` (strict), plus ``no_emotion`` when none holds."""
    names = [strip_prefix(c) for c in prob_cols]
    out = df
    for c, n in zip(prob_cols, names):
        out = out.withColumn(n, F.col(c) > F.lit(min_score))
    none = ~F.greatest(*[F.col(n) for n in names]) if len(names) > 1 else ~F.col(names[0])
    return out.withColumn(none_name, none)


def argmax_label(prob_cols: list[str], labels: list[str] | None = None) -> Column:
    """Label of the highest probability; the first column wins ties; NULL scores lose."""
    labels = labels or [strip_prefix(c) for c in prob_cols]
    entries = [F.struct(F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))).alias("s"),
                        F.lit(-i).alias("o"), F.lit(lab).alias("label"))
               for i, (c, lab) in enumerate(zip(prob_cols, labels))]
    return F.array_max(F.array(*entries))["label"]


def binary_label(prob_cols: list[str], positive: str = "LABEL_1") -> Column:
    """N9 binary form: 1 iff the argmax label is the positive one."""
    labels = [strip_prefix(c, "p_") for c in prob_cols]
    return (argmax_label(prob_cols, labels) == F.lit(positive)).cast("int")


def score_texts(df: DataFrame, make_predict_fn: Callable, labels: list[str], text: str = "text",
                batch_size: int = 16) -> DataFrame:
    """User model over Arrow batches; one ``p_<label>`` column per class.

    ``make_predict_fn()`` is called once per Python worker and returns
    ``predict(texts: np.ndarray) -> np.ndarray[n, len(labels)]``.
    """
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size)
    scored = df.withColumn("_p", udf(F.col(text)))
    for i, lab in enumerate(labels):
        scored = scored.withColumn(f"p_{lab}", F.col("_p")[i].cast("double"))
    return scored.drop("_p")


def train_text_classifier(train: DataFrame, text: str = "text", label: str = "label", num_features: int = 1 << 18,
                          max_iter: int = 50):
    """In-repo default scorer: RegexTokenizer -> HashingTF -> IDF -> LogisticRegression (distributed fit).

    Both fits read the kept word counts, so texts are cut into words once.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    rows = train.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double"))
    words = PipelineModel([
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False, toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
    ])
    seen = keep(words.transform(rows).select("_tf", label))
    idf = IDF(inputCol="_tf", outputCol="_feat").fit(seen)
    model = LogisticRegression(featuresCol="_feat", labelCol=label, maxIter=max_iter, probabilityCol="_prob",
                               predictionCol="_pred", rawPredictionCol="_raw").fit(idf.transform(seen))
    seen.unpersist()
    return PipelineModel([*words.stages, idf, model])


def apply_classifier(model, df: DataFrame, labels: list[str]) -> DataFrame:
    """Score with a fitted pipeline; class probabilities become ``p_<label>`` columns."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df).withColumn("_pa", vector_to_array("_prob"))
    for i, lab in enumerate(labels):
        out = out.withColumn(f"p_{lab}", F.col("_pa")[i])
    return out.drop("_tok", "_tf", "_feat", "_raw", "_prob", "_pred", "_pa")


def train_multilabel(train: DataFrame, labels: list[str], text: str = "text", num_features: int = 1 << 16,
                     max_iter: int = 20):
    """N7 default for labels that don't exclude each other: shared TF-IDF, one logistic regression for each 0/1 column.

    Returns ``(features, {label: model})``, both fitted by Spark ML over all rows; NULL labels count as 0.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    rows = train.where(F.col(text).isNotNull()).select(text, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                                                               for c in labels])
    words = PipelineModel([
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False, toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
    ])
    seen = keep(words.transform(rows).select("_tf", *labels))  # one pass over the texts for all fits
    idf = IDF(inputCol="_tf", outputCol="_feat").fit(seen)
    weighed = idf.transform(seen).select("_feat", *labels)
    models = {c: LogisticRegression(featuresCol="_feat", labelCol=c, maxIter=max_iter, regParam=0.01,
                                    probabilityCol="_prob", predictionCol="_pred", rawPredictionCol="_raw").fit(weighed)
              for c in labels}
    seen.unpersist()
    return PipelineModel([*words.stages, idf]), models


def apply_multilabel(model, df: DataFrame, text: str = "text") -> DataFrame:
    """``p_<label>`` columns, each a probability of its own; NULL texts score like empty ones."""
    from pyspark.ml.functions import vector_to_array

    features, models = model
    column = features.stages[0].getInputCol()
    out = features.transform(df.withColumn("_given", F.col(column) if column in df.columns else F.lit(None))
                             .withColumn(column, F.coalesce(F.col(text), F.lit("")))).drop("_tok", "_tf")
    for label, fitted in models.items():
        out = fitted.transform(out).withColumn(f"p_{label}", vector_to_array("_prob")[1]).drop("_prob", "_pred", "_raw")
    out = out.drop("_feat")
    return out.withColumn(column, F.col("_given")).drop("_given") if column in df.columns else out.drop("_given", column)


def embed(df: DataFrame, make_encode_fn: Callable, text: str = "text", dim: int = 64,
          batch_size: int = 64) -> DataFrame:
    """User sentence encoder over Arrow batches -> ``embedding array<float>``."""
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(make_encode_fn, return_type=ArrayType(FloatType()), batch_size=batch_size,
                            input_tensor_shapes=None)
    return df.withColumn("embedding", udf(F.col(text)))


def word2vec_embed(df: DataFrame, text: str = "text", dim: int = 64, seed: int = 42) -> DataFrame:
    """In-repo default encoder: Word2Vec document vectors (mean of word vectors), fitted distributed."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import RegexTokenizer, Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
        Word2Vec(inputCol="_tok", outputCol="_vec", vectorSize=dim, seed=seed, minCount=1, maxIter=1),
    ]).fit(df)
    return model.transform(df).withColumn("embedding", vector_to_array("_vec", "float32")).drop("_tok", "_vec")


def hashed_embed(df: DataFrame, text: str = "text", dim: int = 64) -> DataFrame:
    """In-repo default encoder without training: hashed term counts in ``dim`` buckets, L2-normalised.

    Tokenise -> HashingTF -> Normalizer are narrow, JVM-side transforms: no
    fit on the driver, no shuffle, any text length.
    """
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    tok = RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False)
    out = tok.transform(df.withColumn(text, F.coalesce(F.col(text), F.lit(""))))
    out = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim).transform(out)
    out = Normalizer(inputCol="_tf", outputCol="_n", p=2.0).transform(out)
    return out.withColumn("embedding", vector_to_array("_n", "float32")).drop("_tok", "_tf", "_n")


def reduce_dims(df: DataFrame, k: int = 5, col: str = "embedding", out: str = "reduced") -> DataFrame:
    """N12 (re-aimed UMAP): PCA to ``k`` components on L2-normalised vectors (cosine geometry)."""
    from pyspark.ml.feature import PCA, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vec = df.withColumn("_v", array_to_vector(F.col(col).cast("array<double>")))
    vec = Normalizer(inputCol="_v", outputCol="_n", p=2.0).transform(vec)
    model = PCA(k=k, inputCol="_n", outputCol="_r").fit(vec)
    return model.transform(vec).withColumn(out, vector_to_array("_r", "float32")).drop("_v", "_n", "_r")


# Words that a word model may hold: the most frequent ones of the training rows.
MODEL_WORDS = 50_000


def word_model(train: DataFrame, text: str = "text", label: str = "label", most: int = MODEL_WORDS) -> Callable:
    """A user model for ``score_texts``: naive Bayes over the words of a text, of which each counts once.

    Document counts are taken by Spark over all rows; the driver gets one row for each of the ``most`` most frequent words
    (a documented bound of the model) and hands them on as a plain dictionary.
    """
    words = train.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(
        F.col(label).cast("int").alias("y"), F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("w"))
    n = {r["y"]: r["n"] for r in words.groupBy("y").agg(F.count("*").alias("n")).collect()}
    neg, pos = n.get(0, 0), n.get(1, 0)
    counts = words.select("y", F.explode("w").alias("word")).groupBy("word").agg(
        F.count_if(F.col("y") == 0).alias("neg"), F.count_if(F.col("y") == 1).alias("pos"))
    top = counts.orderBy(F.desc(F.col("neg") + F.col("pos")), "word").limit(most).collect()
    weight = {r["word"]: math.log((r["pos"] + 1) / (pos + 2)) - math.log((r["neg"] + 1) / (neg + 2)) for r in top}
    start = math.log((pos + 1) / (neg + 1))

    def make_predict_fn():
        def predict(texts):
            logits = np.array([start + sum(weight.get(w, 0.0) for w in set(re.findall(r"\w{2,}", (t or "").lower()))) for t in texts])
            p = 1 / (1 + np.exp(-np.clip(logits, -50, 50)))
            return np.stack([1 - p, p], axis=1).astype(np.float32)
        return predict

    return make_predict_fn


def trigram_encoder(dim: int = 64) -> Callable:
    """A user encoder for ``embed``: signed hashes of a text's letter trigrams, at length 1."""
    def make_encode_fn():
        def encode(texts):
            out = np.zeros((len(texts), dim), np.float32)
            for i, t in enumerate(texts):
                points = np.frombuffer((t or "").lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
                if len(points) > 2:
                    mixed = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1] * np.uint64(0x85EBCA6B) + points[2:] * np.uint64(0xC2B2AE35))
                    mixed ^= mixed >> np.uint64(15)
                    np.add.at(out[i], (mixed % np.uint64(dim)).astype(int), np.where(mixed >> np.uint64(20) & np.uint64(1), 1.0, -1.0))
            size = np.sqrt((out ** 2).sum(axis=1, keepdims=True))
            return out / np.where(size, size, 1)
        return encode

    return make_encode_fn
