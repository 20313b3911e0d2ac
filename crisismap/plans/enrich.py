"""Topic model selection and the text enrichment flow.

The evaluation grid fits its configurations from a thread pool (Spark schedules their jobs side by side) and puts
their topics into columns of one table, so that the texts are read twice, however many configurations there are: to
count the words of all topics of all configurations, and to count the best words of these in each document.
A configuration whose algorithm doesn't exist is reported in ``status``;
any other failure ends the grid, as the best of what is left would look like the best of all.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from crisismap.operators import clustering as C
from crisismap.operators import density as D
from crisismap.operators import posts as P
from crisismap.operators import scoring as SC
from crisismap.operators import similarity as SIM
from crisismap.operators import topics as T
from crisismap.schemas import TOPIC_EVALUATION
from crisismap.session import cut_lineage, stored


ALGORITHMS = ("kmeans", "hdbscan", "density")


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """K4 / K5: reproducible sample of n rows (hash order, independent of partitioning); keyed rows keep
    their vectors aligned."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def nested_samples(df: DataFrame, sizes: list[int], seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Samples of all ``sizes`` at once: ``sample`` is the place (from 0) of the smallest one that has the row.

    Each sample equals ``sample_rows`` of its size and lies inside the next, with
    all columns (so vectors stay aligned). Nothing is sorted as a whole: hashes are counted by
    their leading bits, and only the rows of the one bucket in which a sample ends are
    ranked. ``key`` must be unique; rows outside the largest sample are left out.
    """
    sizes = sorted(sizes)
    digest = F.xxhash64(F.col(key), F.lit(seed))
    hashed = df.withColumn("_h", digest).withColumn("_bucket", F.shiftright("_h", 48))
    counts = sorted(hashed.groupBy("_bucket").count().collect())  # 65,536 at most
    ends, total, buckets = [], 0, iter(counts)
    held = (None, 0)
    for size in sizes:
        while total < size and (held := next(buckets, None)) is not None:
            total += held[1]
        # (bucket in which the sample ends, rows of that bucket that belong to it)
        ends.append((held[0], size - (total - held[1])) if held is not None else (None, 0))
    last = sorted({bucket for bucket, _ in ends if bucket is not None})
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", key))
    within = hashed.where(~F.col("_bucket").isin(last)).withColumn("_rank", F.lit(0)) if last else hashed.withColumn("_rank", F.lit(0))
    if last:
        within = within.unionByName(hashed.where(F.col("_bucket").isin(last)).withColumn("_rank", rank))
    sample = F.lit(None).cast("int")
    for i, (bucket, rows) in reversed(list(enumerate(ends))):
        fits = F.lit(True) if bucket is None else (F.col("_bucket") < bucket) | ((F.col("_bucket") == bucket) & (F.col("_rank") <= rows))
        sample = F.when(fits, F.lit(i)).otherwise(sample)
    return within.withColumn("sample", sample).where(F.col("sample").isNotNull()).drop("_h", "_bucket", "_rank")


def hierarchical_topics(docs: DataFrame, vec: str = "embedding", key: str = "doc_id", min_cluster_size: int = 100,
                        min_samples: int | None = None, dims: int = 5) -> DataFrame:
    """N12 + N14: clusters of the ``dims`` leading components by hierarchical density; -1 is noise."""
    reduced = SC.reduce_dims(docs, k=dims, col=vec, out="_reduced")
    return D.cluster_hdbscan(reduced, key, "_reduced", min_cluster_size, min_samples).drop("_reduced")


def fit_topics(docs: DataFrame, algo: str, k: int | str | None, vec: str = "embedding", key: str = "doc_id",
               min_cluster_size: int = 10, eps: float | None = None, min_pts: int = 5, seed: int = 42,
               min_samples: int | None = None, zero_shot: DataFrame | None = None, least_similarity: float = 0.5) -> DataFrame:
    """Cluster documents with one configuration; ``topic_id`` per document (-1 = noise).

    N16: with ``zero_shot`` topics (topic_id, embedding; ids from 0), each document goes to the most similar
    one if the cosine is at least ``least_similarity`` (the smaller id wins ties); only the others are clustered, and
    their topics are numbered after the given ones. ``k`` says how far topics are merged ('auto': those that belong together).
    """
    if zero_shot is not None:
        given = F.broadcast(zero_shot.agg((F.max("topic_id") + 1).alias("_given")))
        best = SIM.best_match(docs, zero_shot.withColumnRenamed("topic_id", "query_id"), key, vec, threshold=-2.0)
        near = cut_lineage(docs.join(best, key, "left"))
        fits = F.coalesce(F.col("best_sim") >= least_similarity, F.lit(False))
        rest = fit_topics(near.where(~fits).drop("best_sim", "prediction"), algo, k, vec, key, min_cluster_size, eps, min_pts,
                          seed, min_samples)
        rest = rest.crossJoin(given).withColumn("topic_id", F.when(F.col("topic_id") >= 0, F.col("topic_id") + F.col("_given"))
                                                .otherwise(-1).cast("int")).drop("_given")
        return near.where(fits).withColumn("topic_id", F.col("prediction").cast("int")).drop("best_sim", "prediction").unionByName(rest)
    if algo == "kmeans":
        return C.cluster_kmeans(docs, k, vec, seed)
    if algo == "hdbscan":
        out = hierarchical_topics(docs, vec, key, min_cluster_size, min_samples)
    elif algo == "density":
        # density clustering runs on 2 leading components (the reference clusters a reduced copy too)
        red = SC.reduce_dims(docs, k=2, col=vec, out="_reduced")
        out = C.cluster_density(red, key, "_reduced", eps or 0.5, min_pts, min_cluster_size).drop("_reduced")
    else:
        raise ValueError(f"unknown clustering algorithm {algo!r}")
    mapping = topic_mapping(out, algo, k, vec)
    return out if mapping is None else C.relabelled(out, mapping)


def topic_mapping(clusters: DataFrame, algo: str, k: int | str | None, vec: str, vectors: DataFrame | None = None) -> DataFrame | None:
    """How topics are merged (old, new) for ``k``; None if they stay. ``vectors``: those of the topics, if known."""
    if k == "auto" and algo == "hdbscan":
        return C.alike(C.topic_vectors(clusters, vec) if vectors is None else vectors)
    n = (clusters.where(F.col("topic_id") >= 0).select("topic_id").distinct() if vectors is None else vectors).count()
    if isinstance(k, int) and n > k:
        return C.reduced(C.topic_vectors(clusters, vec) if vectors is None else vectors, k)
    return None


def _side_by_side(train: DataFrame, configs: dict[int, tuple], vec: str, key: str, seed: int, least: dict,
                  run) -> tuple[DataFrame, dict[int, str]]:
    """The rows with topics, stored, and the column of each configuration; ``configs``: i -> (kmeans or hdbscan, k).

    hdbscan is fitted once, as it doesn't depend on the number of topics; configurations that merge none of its topics share
    a column. ``run`` maps a function over a list, in order.
    """
    merged = {i: k for i, (a, k) in configs.items() if a == "hdbscan"}
    means = {i: k for i, (a, k) in configs.items() if a == "kmeans"}

    def fit(i):
        if i is not None:
            return C.kmeans_model(train, means[i], vec, seed)
        base = stored(hierarchical_topics(train, vec, key, **least), "base")
        return base, stored(C.topic_vectors(base, vec), "topic-vectors")

    fitted = dict(zip([None] * bool(merged) + [*means], run(fit, [None] * bool(merged) + [*means])))
    rows, labels = train, {}
    if merged:
        rows, vectors = fitted.pop(None)
        mappings = run(lambda k: topic_mapping(rows, "hdbscan", k, vec, vectors), merged.values())
        rows = rows.withColumnRenamed("topic_id", "_t")
        for i, mapping in zip(merged, mappings):
            labels[i] = "_t" if mapping is None else f"_t{i}"
            rows = rows if mapping is None else C.relabelled(rows.withColumn(f"_t{i}", F.col("_t")), mapping, f"_t{i}")
        rows = rows if "_t" in labels.values() else rows.drop("_t")
    for i, model in fitted.items():
        labels[i] = f"_t{i}"
        rows = C.kmeans_labels(model, rows, vec, f"_t{i}")
    return stored(rows, "clusters"), labels


def _score(counted: DataFrame, words: DataFrame, key: str) -> dict[int, tuple[float, float]]:
    """config -> coherence and diversity, from the terms that ``T.counted_terms`` kept of the documents."""
    terms, n = T.known_terms(counted)
    coh = T.topic_coherence(terms, words, True, key, n, T.cooccurrence_in_tasks).groupBy(F.col("topic_id.config").alias("config")).agg(F.avg("coherence").alias("c"))
    div = T.topic_diversity(words.withColumn("config", F.col("topic_id.config")), "config")
    return {r["config"]: (float(r["c"] or 0.0), float(r["diversity"] or 0.0)) for r in coh.join(div, "config").collect()}


def evaluate_topics(docs: DataFrame, eval_docs: DataFrame | None = None, ks=(10, 20, 30),
                    algos=("kmeans", "density"), stop: DataFrame | None = None, text: str = "cleaned_text",
                    vec: str = "embedding", key: str = "doc_id", parallel: int = 1, sample_sizes=None, **cluster_args) -> DataFrame:
    """Algorithms x topic counts (x sample sizes) -> coherence, diversity, quality = c x d.

    A failed job raises: only algorithms that don't exist get a ``status`` that isn't 'ok'.
    """
    rows, _ = topic_grid(docs, eval_docs, ks, algos, stop, text, vec, key, parallel, sample_sizes, **cluster_args)
    return docs.sparkSession.createDataFrame(rows, TOPIC_EVALUATION)


def topic_grid(docs: DataFrame, eval_docs: DataFrame | None, ks, algos, stop: DataFrame | None, text: str, vec: str, key: str,
               parallel: int, sample_sizes=None, **cluster_args) -> tuple[list[Row], Callable[[Row], tuple[DataFrame, DataFrame]]]:
    """Rows of ``evaluate_topics``, and a function from such a row to the clusters and topic words of its configuration."""
    sizes = sorted(sample_sizes or [])
    samples = stored(nested_samples(docs, sizes, key=key), "samples") if sizes else None
    trains = {s: samples.where(F.col("sample") <= sizes.index(s)).drop("sample") for s in sizes} or {None: docs}
    every = [(a, k, s) for s in trains for a in algos for k in ks if not (a == "kmeans" and k in (None, "auto"))]
    configs = {i: c for i, c in enumerate(every) if c[0] in ALGORITHMS}
    least = {c: cluster_args[c] for c in ("min_cluster_size", "min_samples") if c in cluster_args}

    def run(what, items):
        items = list(items)
        if parallel > 1 and len(items) > 1:
            with ThreadPoolExecutor(max_workers=parallel) as pool:
                return list(pool.map(what, items))
        return [what(x) for x in items]

    # tables of documents with the topics of one or several configurations: (rows, {configuration: column})
    together = [i for i, (a, _, _) in configs.items() if a != "density" and "zero_shot" not in cluster_args]
    by_size = {s: [i for i in together if configs[i][2] == s] for s in trains}

    def family(what):
        if what in by_size:
            mine = {i: configs[i][:2] for i in by_size[what]}
            return _side_by_side(trains[what], mine, vec, key, cluster_args.get("seed", 42), least, run)
        i = what[0]
        algo, k, size = configs[i]
        one = fit_topics(trains[size], algo, k, vec, key, **cluster_args)
        return stored(one.withColumnRenamed("topic_id", f"_t{i}"), "clusters"), {i: f"_t{i}"}

    families = run(family, [s for s in trains if by_size[s]] + [(i,) for i in configs if i not in together])
    # equal columns are counted and scored once, for the first configuration that has them
    alike = {i: next(j for j in labels if labels[j] == labels[i]) for _, labels in families for i in labels}
    columns = [(table, {i: c for i, c in labels.items() if alike[i] == i}) for table, labels in families]
    scores, n_topics, n_docs = {}, {}, {s: d.count() for s, d in trains.items()}
    n_eval = n_docs[None] if eval_docs is None and None in n_docs else (docs if eval_docs is None else eval_docs).count()
    if configs:
        best = reduce(DataFrame.unionByName, [T.best_class_words(table, labels, text, stop) for table, labels in columns])
        # the noise topic -1 gets words and scores like any other
        words = stored(T.top_words(best.withColumn("topic_id", F.struct("config", "topic_id")), 10), "topic-words")
        counted = T.counted_terms(T.tokens(docs, text, key), words, key)
        counted_eval = counted if eval_docs is None else T.counted_terms(T.tokens(eval_docs, text, key), words, key)
        for size, train in trains.items():
            mine = words.where(F.col("topic_id.config").isin([i for i in configs if configs[i][2] == size]))
            here = counted if size is None else stored(counted.join(train.select(key), key, "left_semi"), "topic-terms")
            scored = _score(here, mine, key)
            # evaluation on the training documents themselves (the default) is not computed twice
            tested = scored if here is counted_eval else _score(counted_eval, mine, key)
            scores |= {i: (*scored.get(i, (0.0, 0.0)), *tested.get(i, (0.0, 0.0))) for i in configs if configs[i][2] == size}
        for table, labels in columns:
            found = table.select(*labels.values()).distinct().agg(*[F.count_distinct(c).alias(c) for c in labels.values()]).first()
            n_topics |= {i: found[c] for i, c in labels.items()}

    def row(i):
        algo, k, size = every[i]
        count = k if isinstance(k, int) else None  # density also takes None and 'auto'
        if i not in configs:
            return Row(algo, count, None, None, None, None, None, None, None, None, None,
                       f"failed: ValueError: unknown clustering algorithm {algo!r}")
        c_tr, d_tr, c_te, d_te = scores[alike[i]]
        return Row(algo, count, n_topics[alike[i]], n_docs[size], n_eval, c_te, d_te, c_te * d_te, c_tr, d_tr, c_tr * d_tr, "ok")

    rows = [row(i) for i in range(len(every))]

    def topics_of(chosen: Row) -> tuple[DataFrame, DataFrame]:
        i = next(i for i, r in enumerate(rows) if tuple(r) == tuple(chosen))
        table, labels = next(f for f in families if i in f[1])
        return (table.drop(*[c for c in labels.values() if c != labels[i]]).withColumnRenamed(labels[i], "topic_id"),
                words.where(F.col("topic_id.config") == alike[i]).select("topic_id.topic_id", "words"))

    return rows, topics_of


def best_config(grid: DataFrame) -> DataFrame:
    """K1: the configuration with the highest train quality (top-1 is the feature)."""
    return grid.where(F.col("status") == "ok").orderBy(F.desc("train_quality"), "clustering_algorithm",
                                                         "nr_topics").limit(1)


def enrich(posts: DataFrame, labelled: DataFrame, stop: DataFrame | None = None, ks=(10, 20, 30),
           algos=("hdbscan", "kmeans"), key: str = "cid", dim: int = 64, min_cluster_size: int = 100,
           zero_shot: DataFrame | None = None, emotions: DataFrame | None = None,
           emotion_labels: tuple[str, ...] = ("anger", "fear", "joy", "sadness"), emotion_model=None) -> DataFrame:
    """Clean -> embed -> choose the best topic configuration -> topics and labels -> emotions -> flag.

    Two reliable checkpoints cut the lineage: after embedding and at the end.
    ``labelled`` holds (text, label) rows for the disaster classifier, ``emotions`` (text, one 0/1 column for
    each emotion) rows that the emotion scorer is fitted on; ``emotion_model`` is a user model instead
    (see ``score_texts``). With ``zero_shot`` topics (see ``fit_topics``) only the posts that none of them fits are clustered.
    """
    if missing := [a for a in algos if a not in ALGORITHMS]:
        raise ValueError(f"unknown clustering algorithms {missing}")
    if "crawl_seq" in posts.columns:
        posts = P.dedupe_keep_first(posts, key, "crawl_seq")  # one row for each key
    elif not posts.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} repeats: tokens of such posts would count once for every pair of copies")
    cleaned = P.ensure_cleaned(posts.where(F.col("text").isNotNull())).withColumn("doc_id", F.col(key))
    embedded = cut_lineage(SC.hashed_embed(cleaned, text="cleaned_text", dim=dim))
    more = {"min_cluster_size": min_cluster_size, **({} if zero_shot is None else {"zero_shot": zero_shot})}
    rows, topics_of = topic_grid(embedded, None, ks, algos, stop, "cleaned_text", "embedding", "doc_id", 6, **more)
    best = best_config(posts.sparkSession.createDataFrame(rows, TOPIC_EVALUATION)).first()
    if best is None:
        raise ValueError("no configuration of topics to choose from")
    clusters, words = topics_of(best)
    out = T.with_topic_label(clusters, words)
    if emotion_model is not None:
        out = SC.score_texts(out, emotion_model, list(emotion_labels), text="cleaned_text")
    elif emotions is not None:
        out = SC.apply_multilabel(SC.train_multilabel(emotions, list(emotion_labels)), out, text="cleaned_text")
    else:
        raise ValueError("emotions need labelled rows or a model")
    out = SC.threshold_labels(out, [f"p_{e}" for e in emotion_labels], 0.5)
    model = SC.train_text_classifier(labelled, text="text", label="label", num_features=1 << 16, max_iter=20)
    out = SC.apply_classifier(model, out.withColumnRenamed("disaster_related", "_given"), ["LABEL_0", "LABEL_1"])
    out = out.withColumn("disaster_related", SC.binary_label(["p_LABEL_0", "p_LABEL_1"]))
    return cut_lineage(out.drop("embedding", "_given", "doc_id"))
