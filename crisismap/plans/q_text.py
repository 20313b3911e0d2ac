"""Registered queries: text statistics and topic evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from crisismap.operators import posts as P
from crisismap.operators import topics as T
from crisismap.plans import fixtures as fx
from crisismap.plans.oracle_views import with_views
from crisismap.plans.q_posts import CLEAN_SQL
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


def doc_tokens(spark, base):
    return T.tokens(read_table(spark, base, "documents", ["doc_id", "text"]))


def _evaluated(spark, base):
    """The topics, the counts of their words in each document and the corpus' size."""
    topics = fx.topics(spark, base)
    return topics, *T.topic_terms(doc_tokens(spark, base), topics)


TF_SQL = r"""tok AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word
             FROM documents WHERE text IS NOT NULL),
tf AS MATERIALIZED (SELECT doc_id, word, count(*) AS tf FROM tok GROUP BY ALL),
tot AS (SELECT word, sum(tf) AS freq FROM tf GROUP BY word),
nn AS (SELECT sum(tf) AS n FROM tf)"""

PAIRS_SQL = """tp AS (SELECT topic_id, unnest(range(len(words))) AS pos, unnest(words) AS word FROM topics),
tw AS (SELECT topic_id, word, row_number() OVER (PARTITION BY topic_id ORDER BY pos) - 1 AS idx
       FROM tp WHERE word IN (SELECT word FROM tot)),
pairs AS (SELECT a.topic_id, a.word AS wa, b.word AS wb FROM tw a JOIN tw b ON a.topic_id = b.topic_id AND a.idx < b.idx),
tfw AS MATERIALIZED (SELECT * FROM tf WHERE word IN (SELECT word FROM tw)),
wp AS MATERIALIZED (SELECT DISTINCT least(wa, wb) AS w1, greatest(wa, wb) AS w2 FROM pairs WHERE wa <> wb),
jt AS MATERIALIZED (SELECT wp.w1, wp.w2, sum(x.tf * y.tf) AS joint FROM wp JOIN tfw x ON x.word = wp.w1
       JOIN tfw y ON y.word = wp.w2 AND y.doc_id = x.doc_id GROUP BY ALL),
pj AS (SELECT p.topic_id, p.wa, p.wb, CASE WHEN p.wa = p.wb THEN 0 ELSE coalesce(jt.joint, 0) END AS joint,
         ta.freq AS fa, tb.freq AS fb, nn.n
       FROM pairs p LEFT JOIN jt ON jt.w1 = least(p.wa, p.wb) AND jt.w2 = greatest(p.wa, p.wb)
       JOIN tot ta ON ta.word = p.wa JOIN tot tb ON tb.word = p.wb CROSS JOIN nn),
sc AS (SELECT *,
  CASE WHEN joint > 0 THEN log2((joint / n) / ((fb / n) * (fa / n))) END AS pmi,
  CASE WHEN joint = 0 THEN 0.0 ELSE greatest(0.0, log2((joint / n) / ((fb / n) * (fa / n))))
       / nullif(-log2(joint / n), 0) END AS nppmi,
  CASE WHEN joint = 0 THEN -1.0 ELSE log2((joint / n) / ((fb / n) * (fa / n))) / nullif(-log2(joint / n), 0) END AS npmi
  FROM pj),
sz AS (SELECT topic_id, count(*) AS n_words FROM tw GROUP BY topic_id),
coh AS (SELECT t.topic_id, CAST(coalesce(sz.n_words, 0) AS BIGINT) AS n_words,
  CASE WHEN coalesce(sz.n_words, 0) < 2 THEN coalesce(s.sp, 0.0)
       ELSE coalesce(s.sp, 0.0) / (sz.n_words * (sz.n_words - 1) / 2) END AS coherence,
  CASE WHEN coalesce(sz.n_words, 0) < 2 THEN coalesce(s.sn, 0.0)
       ELSE coalesce(s.sn, 0.0) / (sz.n_words * (sz.n_words - 1) / 2) END AS coherence_npmi
  FROM topics t LEFT JOIN sz USING (topic_id)
  LEFT JOIN (SELECT topic_id, sum(nppmi) AS sp, sum(npmi) AS sn FROM sc GROUP BY topic_id) s USING (topic_id))"""


@register("term_counts", sql=f"""
WITH {TF_SQL} SELECT word, CAST(sum(tf) AS BIGINT) AS freq, count(*) AS df FROM tf GROUP BY word""")
def term_counts_q(spark, base):
    """N1 + N2 + T3: corpus frequency and document frequency of every token (whole texts)."""
    return T.word_totals(T.term_counts(doc_tokens(spark, base)))


@register("topic_words", views=("ctfidf",), sql="SELECT topic_id, rank, word, round(score, 9) AS score FROM ctfidf")
def topic_words_q(spark, base):
    """N15 + W3: top 10 words per topic by class-based TF-IDF (stop words removed)."""
    c = fx.corpus(spark, base)
    scores = T.class_tfidf(T.tokens(c, also=("topic_id",)), c, fx.stopwords(spark))
    out = T.ranked_words(scores, 10)
    return out.select("topic_id", "rank", "word", F.round("score", 9).alias("score"))


@register("pmi_pairs", views=("topics",), sql=f"""
WITH {TF_SQL}, {PAIRS_SQL}
SELECT topic_id, wa, wb, CAST(joint AS BIGINT) AS joint, round(pmi, 6) AS pmi, round(npmi, 6) AS npmi,
  round(nppmi, 6) AS nppmi FROM sc""")
def pmi_pairs_q(spark, base):
    """N3 + J12 + F13: PMI family for every word pair of every topic (tf-product joints)."""
    topics, tf, n = _evaluated(spark, base)
    pairs = T.topic_pairs(tf, topics, n=n)
    return pairs.select("topic_id", "wa", "wb", F.col("joint").cast("long").alias("joint"),
                        F.round(T.pmi("fb", "fa", "joint", "n"), 6).alias("pmi"),
                        F.round(T.npmi("fb", "fa", "joint", "n"), 6).alias("npmi"),
                        F.round(T.nppmi("fb", "fa", "joint", "n"), 6).alias("nppmi"))


@register("topic_coherence", views=("topics",), sql=f"""
WITH {TF_SQL}, {PAIRS_SQL}
SELECT topic_id, n_words, round(coherence, 6) AS coherence, round(coherence_npmi, 6) AS coherence_npmi FROM coh""")
def topic_coherence_q(spark, base):
    """Per-topic coherence, NPPMI and NPMI variants (edge topics: unknown, repeated, single word)."""
    topics, tf, n = _evaluated(spark, base)
    out = T.topic_coherence_variants(tf, topics, n=n)
    return out.select("topic_id", F.col("n_words").cast("long").alias("n_words"),
                      F.round("coherence", 6).alias("coherence"), F.round("coherence_npmi", 6).alias("coherence_npmi"))


@register("avg_coherence", views=("topics",), sql=f"""
WITH {TF_SQL}, {PAIRS_SQL} SELECT round(avg(coherence), 6) AS avg_coherence FROM coh""")
def avg_coherence_q(spark, base):
    """Mean coherence over all topics from one corpus pass."""
    topics, tf, n = _evaluated(spark, base)
    coh = T.topic_coherence(tf, topics, n=n)
    return T.avg_coherence(coh).select(F.round("avg_coherence", 6).alias("avg_coherence"))


@register("topic_diversity", views=("topics",), sql="""
SELECT round(count(DISTINCT w) / count(*), 6) AS diversity FROM (SELECT unnest(words) AS w FROM topics)""")
def topic_diversity_q(spark, base):
    """Unique topic words over all topic words."""
    return T.topic_diversity(fx.topics(spark, base)).select(F.round("diversity", 6).alias("diversity"))


@register("topic_info", views=("corpus", "ctfidf"), sql="""
SELECT c.topic_id, c.size, w.words FROM (SELECT topic_id, count(*) AS size FROM corpus GROUP BY topic_id) c
LEFT JOIN (SELECT topic_id, array_to_string(list(word ORDER BY rank), '|') AS words FROM ctfidf GROUP BY topic_id) w
USING (topic_id)""")
def topic_info_q(spark, base):
    """Topic id, size and top words."""
    c = fx.corpus(spark, base)
    words = T.top_words(T.class_tfidf(T.tokens(c, also=("topic_id",)), c, fx.stopwords(spark)), 10)
    out = T.topic_info(c, words)
    return out.select("topic_id", "size", F.array_join("words", "|").alias("words"))


@register("topic_labels", views=("corpus", "ctfidf"), sql="""
SELECT c.doc_id, c.topic_id, w.topic_label FROM corpus c
LEFT JOIN (SELECT topic_id, array_to_string(list(word ORDER BY rank), ', ') AS topic_label FROM ctfidf
           GROUP BY topic_id) w USING (topic_id)""")
def topic_labels_q(spark, base):
    """Each document gets its topic's words and ``topic_label`` (keyed join, not position)."""
    c = fx.corpus(spark, base)
    words = T.top_words(T.class_tfidf(T.tokens(c, also=("topic_id",)), c, fx.stopwords(spark)), 10)
    return T.with_topic_label(c.select("doc_id", "topic_id"), words).select("doc_id", "topic_id", "topic_label")


@register("word_counts", views=("posts", "stopwords"), sql=r"""
WITH c AS (
  SELECT word, count(*) AS n FROM (
    SELECT replace(regexp_replace(w, '''s$', ''), '''', '') AS word FROM (
      SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_'']{2,}')) AS w FROM posts WHERE text IS NOT NULL))
  WHERE length(word) >= 2 AND NOT regexp_full_match(word, '[0-9]+') AND word NOT IN (SELECT word FROM stopwords)
  GROUP BY word)
SELECT coalesce(one.word, c.word) AS word, CAST(sum(c.n) AS BIGINT) AS count
FROM c LEFT JOIN c AS one ON c.word LIKE '%s' AND c.word NOT LIKE '%ss' AND one.word || 's' = c.word
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200""")
def word_counts_q(spark, base):
    """200 most frequent post words without stop words (a top-k report)."""
    return T.word_counts(fx.posts(spark, base), fx.stopwords(spark))


@register("cleaned_posts", views=("posts",), sql=f"""
SELECT cid, crawl_seq, {CLEAN_SQL.format("text")} AS cleaned_text FROM posts""")
def cleaned_posts_q(spark, base):
    """P10: ensure ``cleaned_text`` (derived from ``text`` when absent)."""
    return P.ensure_cleaned(fx.posts(spark, base)).select("cid", "crawl_seq", "cleaned_text")
