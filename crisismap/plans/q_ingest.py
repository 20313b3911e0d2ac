"""Registered queries: harvest, ingest and geoparsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from crisismap.operators import geoparse as GP
from crisismap.operators import harvest as H
from crisismap.operators.multipattern import keyword_counts
from crisismap.plans import fixtures as fx
from crisismap.plans.oracle_views import with_views
from crisismap.session import spread
from crisismap.sources.tables import read_table
from crisismap.streaming.ingest import ingest_counts_batch

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None, views=()):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        return fn
    return deco


SPAN_SQL = """span AS (SELECT date_trunc('day', min(ts)) AS lo, date_trunc('day', max(ts)) + INTERVAL 1 DAY AS hi
  FROM posts)"""
KW_SQL = "kw AS (SELECT DISTINCT lower(keyword) AS keyword FROM keywords)"


@register("harvest_tasks", views=("posts", "keywords"), sql=f"""
WITH {SPAN_SQL},
k AS (SELECT keyword, row_number() OVER (ORDER BY keyword) - 1 AS j, count(*) OVER () AS n
      FROM (SELECT DISTINCT keyword FROM keywords)),
iv AS (SELECT unnest(generate_series(lo, hi - INTERVAL 30 MINUTE, INTERVAL 30 MINUTE)) AS since FROM span),
ivn AS (SELECT since, row_number() OVER (ORDER BY since) - 1 AS i FROM iv)
SELECT CAST(i * n + j AS BIGINT) AS task_no, keyword, since, since + INTERVAL 30 MINUTE AS until FROM ivn, k""")
def harvest_tasks_q(spark, base):
    """Keyword x 30-minute interval tasks over the day span of the landed posts (duplicate keyword
    dropped), interval-major."""
    span = H.day_span(fx.posts(spark, base))
    kws = fx.keywords(spark).orderBy("keyword")
    return H.harvest_tasks(kws, span)


@register("harvest_match", views=("posts", "keywords"), sql=f"""
WITH {SPAN_SQL}, {KW_SQL},
m AS (SELECT p.cid, p.crawl_seq, p.ts, kw.keyword,
        span.lo + to_minutes(CAST(30 * floor(epoch(p.ts - span.lo) / 1800) AS INTEGER)) AS since
      FROM posts p, span, kw
      WHERE p.ts IS NOT NULL AND p.text IS NOT NULL AND p.ts >= span.lo AND p.ts < span.hi
        AND instr(lower(p.text), kw.keyword) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY keyword, since ORDER BY ts DESC, cid, crawl_seq) AS rank FROM m)
SELECT keyword, since, cid, crawl_seq, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 100""")
def harvest_match_q(spark, base):
    """I1 + F15 + W7: per (keyword, interval) the 100 newest posts containing the keyword."""
    posts = fx.posts(spark, base).select("cid", "crawl_seq", "ts", "text")
    out = H.harvest_match(posts, fx.keywords(spark), H.day_span(posts), tiebreak=("crawl_seq",))
    return out.select("keyword", "since", "cid", "crawl_seq", "rank")


@register("ingest_counts", views=("posts", "keywords"), sql=f"""
WITH {KW_SQL},
f AS (SELECT cid, arg_min(text, crawl_seq) AS text, arg_min(ts, crawl_seq) AS ts FROM posts GROUP BY cid)
SELECT time_bucket(INTERVAL 30 MINUTE, f.ts) AS window_start,
  time_bucket(INTERVAL 30 MINUTE, f.ts) + INTERVAL 30 MINUTE AS window_end, kw.keyword, count(*) AS count
FROM f, kw WHERE f.text IS NOT NULL AND instr(lower(f.text), kw.keyword) > 0 GROUP BY ALL""")
def ingest_counts_q(spark, base):
    """I2 + I5 (batch twin of the streaming ingest): dedupe by cid, 30-minute counts per keyword."""
    return ingest_counts_batch(fx.posts(spark, base), fx.keywords(spark))


@register("corpus_keywords", sql=r"""
WITH runs AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS run FROM documents),
words AS (SELECT DISTINCT run FROM runs),
hits AS (SELECT k.run AS keyword, w.run FROM words k JOIN words w ON length(k.run) >= 3 AND contains(w.run, k.run))
SELECT keyword, count(DISTINCT doc_id) AS documents FROM hits JOIN runs USING (run) GROUP BY keyword""")
def corpus_keywords_q(spark, base):
    """F15 at length: every run of three or more letters a-z of the corpus as a keyword; documents that contain each."""
    docs = read_table(spark, base, "documents", ["doc_id", "text"])
    words = spread(docs).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("keyword"))
    return keyword_counts(spread(docs), "text", words)


GEOPARSE_SQL = r"""
WITH gz AS (SELECT lower(name) AS norm, arg_max(struct_pack(name := name, country_name := country_name,
              latitude := latitude, longitude := longitude, population := population),
              struct_pack(p := population, a := -latitude, b := -longitude)) AS g FROM gazetteer GROUP BY 1),
cand AS (SELECT doc_id, start, run AS g FROM runs WHERE regexp_matches(run, '^[\p{L}\p{N}_]')
         UNION ALL SELECT doc_id, start, run || r1 || r2 FROM runs
           WHERE regexp_matches(run, '^[\p{L}\p{N}_]') AND r1 = ' ' AND r2 IS NOT NULL
         UNION ALL SELECT doc_id, start, run || r1 || r2 || r3 || r4 FROM runs
           WHERE regexp_matches(run, '^[\p{L}\p{N}_]') AND r1 = ' ' AND r3 = ' ' AND r2 IS NOT NULL
             AND r4 IS NOT NULL),
hits AS (SELECT c.doc_id, c.start, c.start + length(c.g) AS fin, c.g AS ngram, gz.g.name AS name,
           gz.g.country_name AS country_name, gz.g.latitude AS latitude, gz.g.longitude AS longitude,
           gz.g.population AS population FROM cand c JOIN gz ON lower(c.g) = gz.norm),
k AS (SELECT *, max(fin) OVER (PARTITION BY doc_id ORDER BY start, fin DESC
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cover FROM hits)
SELECT doc_id, CAST(start AS INTEGER) AS start_char, CAST(fin AS INTEGER) AS end_char, ngram AS text,
  name AS loc_name, country_name, latitude, longitude, round(log10(CAST(population AS DOUBLE) + 1) / 10, 6) AS score
FROM k WHERE cover IS NULL OR cover < fin"""


@register("geoparse", views=("runs", "gazetteer"), sql=GEOPARSE_SQL)
def geoparse_q(spark, base):
    """N6 + P8 (re-aimed): toponyms of every document from a corpus-derived gazetteer, longest match."""
    docs = read_table(spark, base, "documents", ["doc_id", "text"])
    return GP.toponym_rows(docs, fx.gazetteer(spark, base), "doc_id")


@register("geocoded_points", views=("runs", "gazetteer"), sql=f"""
SELECT d.doc_id, d.text, CAST(count(t.start_char) AS INTEGER) AS n_points,
  coalesce(string_agg(t.text || '@' || t.start_char || '=' || t.loc_name || '/' || t.country_name, '|' ORDER BY t.start_char), '')
    AS toponyms, round(coalesce(sum(t.longitude), 0), 6) AS sum_lon, round(coalesce(sum(t.latitude), 0), 6) AS sum_lat
FROM documents d LEFT JOIN ({GEOPARSE_SQL}) t ON t.doc_id = d.doc_id GROUP BY d.doc_id, d.text""")
def geocoded_points_q(spark, base):
    """N6 + P8 -> P7: the geocoded struct of every document and its multipoint."""
    from crisismap.operators.posts import with_points

    docs = read_table(spark, base, "documents", ["doc_id", "text"])
    g = with_points(GP.geoparse(docs, fx.gazetteer(spark, base), "doc_id"), "geocoded_dict.toponyms")
    names = F.transform("geocoded_dict.toponyms", lambda t: F.concat(
        t["text"], F.lit("@"), t["start_char"].cast("string"), F.lit("="), t["loc_name"], F.lit("/"), t["country_name"]))

    def total(field):
        return F.round(F.aggregate("points", F.lit(0.0), lambda s, p: s + p[field]), 6)

    return g.select("doc_id", F.col("geocoded_dict.text").alias("text"), F.size("points").alias("n_points"),
                    F.array_join(names, "|").alias("toponyms"), total("lon").alias("sum_lon"), total("lat").alias("sum_lat"))
