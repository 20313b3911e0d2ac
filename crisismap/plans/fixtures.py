"""Domain views derived from the driver's tables (see FIXTURES.md).

Every builder reads the given Parquet tables and derives the study's tables
from them with integer arithmetic and exact binary fractions, so that the
DuckDB twins in ``crisismap.plans.oracle_views`` build identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crisismap.session import left_join_spread, spread, stored
from crisismap.sources.tables import read_table

# Fixed values of the fixtures (FIXTURES.md): emotion multipliers, stop words,
# harvest keywords, grid origin and size.
EMOTION_FACTORS = {"anger": (31, 17), "fear": (17, 53), "joy": (53, 71), "sadness": (71, 31)}
EMOTIONS = ("anger", "fear", "joy", "sadness")
STOPWORDS = ("the", "of", "and", "to", "in", "is", "it", "on", "as", "be")
KEYWORDS = ("the", "und", "les", "que", "tion", "the")
GRID_ORIGIN = (2.0, 36.0)
GRID_COLS, GRID_ROWS, GRID_STEP = 20, 14, 2.0
HOT_SPOT = (16.375, 48.25)
N_TOPICS = 8


def _p_expr(a: int, b: int) -> str:
    return f"((doc_id * {a}) % 100) / 200 + ((doc_id * {b}) % 100) / 400"


_TOPONYMS_EXPR = f"""
CASE WHEN doc_id % 4 = 0 THEN array() ELSE transform(sequence(1L, doc_id % 4), k -> named_struct(
  'text', concat('place', k),
  'start_char', CAST(k * 10 AS INT),
  'end_char', CAST(k * 10 + 6 AS INT),
  'loc_name', concat('Place ', k),
  'country_name', 'Country',
  'latitude', CASE WHEN (doc_id + k) % 23 = 0 THEN CAST(NULL AS DOUBLE)
                   WHEN doc_id % 5 = 0 AND k = 1 THEN {HOT_SPOT[1]}D
                   ELSE 36 + ((doc_id * 7 + k * 11) % 176) / 8 END,
  'longitude', CASE WHEN doc_id % 5 = 0 AND k = 1 THEN {HOT_SPOT[0]}D
                    ELSE 2 + ((doc_id * 13 + k * 29) % 248) / 8 END,
  'score', CAST(k AS DOUBLE) / 4)) END
"""


def posts(spark: SparkSession, base: str) -> DataFrame:
    """Flat post rows with labels, toponyms and emotion scores (one duplicate copy per 7th post)."""
    docs = spread(read_table(spark, base, "documents", ["doc_id", "text", "lang"]))
    labels = read_table(spark, base, "labels", ["doc_id", "quality"]).select(
        "doc_id", F.col("quality").cast("int").alias("disaster_related"))
    pages = read_table(spark, base, "pages", ["page_id", "url"])
    n_pages = pages.agg(F.count(F.lit(1)).alias("n_pages"))  # one row: a proven broadcast bound

    rows = docs.join(labels, "doc_id", "left")
    rows = rows.withColumn("crawl_seq", F.col("doc_id")).unionByName(
        rows.where("doc_id % 7 = 0").withColumn("crawl_seq", F.expr("doc_id + 1000000")))
    rows = (rows.crossJoin(F.broadcast(n_pages))
            .withColumn("page_id", F.expr("CASE WHEN doc_id % 3 = 0 THEN doc_id % n_pages END")))
    rows = left_join_spread(rows, pages, "page_id", "doc_id", "text")
    m = "((doc_id * 37) % 76320)"
    out = rows.selectExpr(
        "concat('c', doc_id) AS cid",
        "concat('at://post/', doc_id) AS uri",
        "doc_id",
        "crawl_seq",
        "CASE WHEN doc_id % 97 = 0 THEN '' WHEN doc_id % 89 = 0 THEN CAST(NULL AS STRING) ELSE text END AS text",
        f"TIMESTAMP_NTZ'2024-12-24 00:00:00' + make_dt_interval(0, 0, CAST({m} + CASE WHEN ({m} div 1440) % 9 = 4 "
        f"THEN 1440 ELSE 0 END AS INT), 0) AS ts",
        "lang",
        "CASE WHEN doc_id % 10 = 0 THEN CAST(array() AS ARRAY<STRING>) "
        "WHEN doc_id % 10 = 1 THEN array(concat(lang, '-XX'), 'en') ELSE array(lang) END AS langs",
        "CASE WHEN doc_id % 3 = 0 THEN array(url) WHEN doc_id % 3 = 1 THEN array('at://x') "
        "ELSE CAST(array() AS ARRAY<STRING>) END AS urls",
        "CASE WHEN doc_id % 4 = 0 THEN array('t') ELSE CAST(array() AS ARRAY<STRING>) END AS image_thumbnails",
        "CAST(crawl_seq % 47 AS BIGINT) AS likeCount",
        "disaster_related",
        *[f"{_p_expr(a, b)} AS p_{name}" for name, (a, b) in EMOTION_FACTORS.items()],
        f"{_TOPONYMS_EXPR} AS toponyms",
    )
    return out.withColumn("createdAt", F.expr(
        "CASE WHEN doc_id % 10 = 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") "
        "WHEN doc_id % 10 = 1 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\") "
        "ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") END"))


def emotion_rows(spark: SparkSession, base: str) -> DataFrame:
    """Posts with a text and 0/1 columns for the emotions whose given score reaches one half."""
    p = posts(spark, base).where(F.col("text").isNotNull())
    return p.select("text", *[(F.col(f"p_{e}") >= 0.5).cast("int").alias(e) for e in EMOTIONS])


def grid(spark: SparkSession) -> DataFrame:
    """Grid cells (G7): level 4 = 2-degree squares, level 5 = each square cut into two triangles.

    Built from one ``range`` (no cross join), rings closed and counter-clockwise.
    """
    sq = spark.range(GRID_COLS * GRID_ROWS).selectExpr(
        f"id div {GRID_ROWS} AS i", f"id % {GRID_ROWS} AS j").selectExpr(
        "i", "j", f"{GRID_ORIGIN[0]}D + {GRID_STEP}D * i AS x0", f"{GRID_ORIGIN[1]}D + {GRID_STEP}D * j AS y0")
    corner = "named_struct('lon', {x}, 'lat', {y})"
    p00 = corner.format(x="x0", y="y0")
    p10 = corner.format(x=f"x0 + {GRID_STEP}D", y="y0")
    p11 = corner.format(x=f"x0 + {GRID_STEP}D", y=f"y0 + {GRID_STEP}D")
    p01 = corner.format(x="x0", y=f"y0 + {GRID_STEP}D")
    squares = sq.selectExpr("concat('4-', i, '-', j) AS cell_id", "4 AS level",
                            f"array({p00}, {p10}, {p11}, {p01}, {p00}) AS ring")
    tris = sq.selectExpr("*", "explode(array('a', 'b')) AS half").selectExpr(
        "concat('5-', i, '-', j, '-', half) AS cell_id", "5 AS level",
        f"CASE WHEN half = 'a' THEN array({p00}, {p10}, {p11}, {p00}) ELSE array({p00}, {p11}, {p01}, {p00}) END AS ring")
    return squares.unionByName(tris)


def _box_ring(cx: str, cy: str, half: str) -> str:
    c = "named_struct('lon', {x}, 'lat', {y})"
    a = c.format(x=f"{cx} - {half}", y=f"{cy} - {half}")
    b = c.format(x=f"{cx} + {half}", y=f"{cy} - {half}")
    d = c.format(x=f"{cx} + {half}", y=f"{cy} + {half}")
    e = c.format(x=f"{cx} - {half}", y=f"{cy} + {half}")
    return f"array({a}, {b}, {d}, {e}, {a})"


def floods(spark: SparkSession, base: str) -> DataFrame:
    """Flood delineations: a 0.5-degree box per supplier with Equi7 tile attributes."""
    sup = read_table(spark, base, "supplier", ["s_suppkey"])
    cx = "(2 + ((s_suppkey * 37) % 248) / 8)"
    cy = "(36 + ((s_suppkey * 19) % 176) / 8)"
    return sup.selectExpr(
        "s_suppkey AS flood_id",
        f"{_box_ring(cx, cy, '0.25D')} AS ring",
        "'EU' AS equi7grid_cont",
        "concat('E', s_suppkey % 6) AS equi7grid_tile_id",
        "date_add(DATE'2024-09-12', CAST(s_suppkey % 3 AS INT)) AS file_date",
        "TIMESTAMP_NTZ'2024-09-12 04:45:55' + make_dt_interval(CAST(s_suppkey % 3 AS INT), 0, 0, 0) AS sensing_date",
        "'VV' AS polarisation")


def lake_floods(spark: SparkSession, base: str) -> DataFrame:
    """Flood polygons as a reader gives them, one per supplier: a square of a half to six degrees with a square hole an
    eighth of a degree inside it (a dry island), a second part beside it, and every tenth one broken (an open ring)."""
    sup = read_table(spark, base, "supplier", ["s_suppkey"])
    cx, cy, half = "(2 + ((s_suppkey * 37) % 248) / 8)", "(36 + ((s_suppkey * 19) % 176) / 8)", "(0.125D * (2 + s_suppkey % 23))"
    outer, hole = _box_ring(cx, cy, half), _box_ring(cx, cy, f"({half} - 0.125D)")
    part = _box_ring(f"({cx} + {half} + 0.375D)", cy, "0.125D")
    return sup.selectExpr(
        "s_suppkey AS flood_id",
        f"CASE WHEN s_suppkey % 10 = 1 THEN array(array(slice({outer}, 1, 4))) "
        f"ELSE array(array({outer}, {hole}), array({part})) END AS polygons")


def faulty_floods(spark: SparkSession, base: str) -> DataFrame:
    """Flood polygons with the faults that digitised outlines have, one per supplier and by its key: a sound square with a
    hole, a bow-tie, a square with a spike, two overlapping parts, a hole that sticks out."""
    sup = read_table(spark, base, "supplier", ["s_suppkey"])
    cx, cy, h = "(2 + ((s_suppkey * 37) % 248) / 8)", "(36 + ((s_suppkey * 19) % 176) / 8)", "(0.25D * (1 + s_suppkey % 11))"

    def ring(*corners: tuple[float, float]) -> str:
        return "array(" + ", ".join(f"named_struct('lon', {cx} + {x}D * {h}, 'lat', {cy} + {y}D * {h})"
                                    for x, y in [*corners, corners[0]]) + ")"

    def square(x0: float, y0: float, x1: float, y1: float) -> str:
        return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))

    whole = square(-1, -1, 1, 1)
    kinds = [f"array(array({whole}, {square(-0.5, -0.5, 0.5, 0.5)}))",
             f"array(array({ring((-1, -1), (1, 1), (1, -1), (-1, 1))}))",
             f"array(array({ring((-1, -1), (1, -1), (1, 0), (3, 0), (1, 0), (1, 1), (-1, 1))}))",
             f"array(array({whole}), array({square(0, 0, 2, 2)}))",
             f"array(array({whole}, {square(0, -0.5, 2, 0.5)}))"]
    cases = " ".join(f"WHEN {i} THEN {kind}" for i, kind in enumerate(kinds))
    return sup.selectExpr("s_suppkey AS flood_id", f"CASE s_suppkey % 5 {cases} END AS polygons")


def footprints(spark: SparkSession, base: str) -> DataFrame:
    """Satellite footprints: a 6-degree box per nation."""
    nat = read_table(spark, base, "nation", ["n_nationkey"])
    cx = "(2 + ((n_nationkey * 37) % 248) / 8)"
    cy = "(36 + ((n_nationkey * 19) % 176) / 8)"
    return nat.selectExpr(
        f"{_box_ring(cx, cy, '3D')} AS footprint_ring",
        "'EU' AS equi7grid_cont",
        "concat('E', n_nationkey % 6) AS equi7grid_tile_id",
        "date_add(DATE'2024-09-12', n_nationkey % 3) AS file_date",
        "concat('fp', n_nationkey) AS unique_id")


def fires(spark: SparkSession, base: str) -> DataFrame:
    """Fire detections from error events: point, ACQ_DATE and HHMM-style ACQ_TIME."""
    ev = read_table(spark, base, "events", ["event_id", "ts", "user_id", "event_type"])
    return ev.where(F.col("event_type") == "error").selectExpr(
        "event_id AS fire_id",
        "2 + ((user_id * 37) % 248) / 8 AS lon",
        "36 + ((user_id * 19) % 176) / 8 AS lat",
        "to_date(ts) AS ACQ_DATE",
        "CAST(hour(ts) * 100 + minute(ts) AS INT) AS ACQ_TIME")


def corpus(spark: SparkSession, base: str) -> DataFrame:
    """Documents with the given clustering ``topic_id = doc_id % 8``."""
    return spread(read_table(spark, base, "documents", ["doc_id", "text"])).withColumn(
        "topic_id", (F.col("doc_id") % N_TOPICS).cast("int"))


def stopwords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOPWORDS], "word string")


def keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in KEYWORDS], "keyword string")


def embeddings(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "embeddings", ["vec_id", "embedding", "label"])


def label_prototypes(spark: SparkSession, base: str) -> DataFrame:
    """One query vector per class: the mean embedding of its members (a grouped aggregate)."""
    emb = embeddings(spark, base)
    dims = emb.select(F.posexplode("embedding").alias("d", "x"), "label")
    mean = dims.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return (mean.groupBy("label")
            .agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v"))
            .selectExpr("label AS query_id", "label", "transform(v, e -> e.x) AS embedding"))


def topics(spark: SparkSession, base: str, n: int = 10) -> DataFrame:
    """Topic word lists: c-TF-IDF top words of the given clustering, plus three edge topics
    (an unknown word appended, a repeated word, a single word)."""
    from crisismap.operators.topics import class_tfidf, tokens, top_words

    c = corpus(spark, base)
    tw = stored(top_words(class_tfidf(tokens(c, also=("topic_id",)), c, stopwords(spark)), n), "topics")
    t0 = tw.where("topic_id = 0").select(F.lit(100).alias("topic_id"),
                                         F.concat("words", F.array(F.lit("zzzunknownzzz"))).alias("words"))
    t1 = tw.where("topic_id = 1").select(F.lit(101).alias("topic_id"),
                                         F.array(F.col("words")[0], F.col("words")[0], F.col("words")[1]).alias("words"))
    t2 = tw.where("topic_id = 2").select(F.lit(102).alias("topic_id"), F.array(F.col("words")[0]).alias("words"))
    # a (topics x 10) table that feeds several branches: stored, so the corpus is ranked once
    return tw.unionByName(t0).unionByName(t1).unionByName(t2)


def gazetteer(spark: SparkSession, base: str) -> DataFrame:
    """Place names derived from the corpus: every word of 9 or more characters, every space-separated pair
    of words of 6 or more each, and a second, smaller entry for names of a length divisible by 4 (ambiguous names)."""
    docs = spread(read_table(spark, base, "documents", ["doc_id", "text"])).where(F.col("text").isNotNull())
    w = r"[\p{L}\p{N}_]"
    uni = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"{w}{{9,}}"), F.lit(0))).alias("name"))
    # overlapping word pairs in one scan: a zero-width match at each word start captures the pair ahead
    pair = rf"(?<!{w})(?=({w}{{6,}} {w}{{6,}})(?!{w}))"
    bi = docs.select(F.explode(F.regexp_extract_all("text", F.lit(pair), F.lit(1))).alias("p")).select(F.lower("p").alias("name"))
    names = stored(uni.unionByName(bi).groupBy("name").agg(F.count(F.lit(1)).alias("n")), "gazetteer")
    whole = names.selectExpr(
        "name", "concat('C', length(name) % 5) AS country_name",
        "36 + ((length(name) * 7) % 176) / 8 AS latitude", "2 + ((length(name) * 13) % 248) / 8 AS longitude",
        "CAST(n * 1000 AS BIGINT) AS population")
    twins = names.where("length(name) % 4 = 0").selectExpr(
        "name", "'CX' AS country_name", "37.5D AS latitude", "3.5D AS longitude", "CAST(1 AS BIGINT) AS population")
    return whole.unionByName(twins)
