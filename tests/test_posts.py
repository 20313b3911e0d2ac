import os

from pyspark.sql import functions as F

from conftest import DATA, SF_SMALL
from crisismap.operators import posts as P
from crisismap.sources.posts import read_raw_posts_checked


def test_parse_posts_golden(spark):
    good, bad = read_raw_posts_checked(spark, os.path.join(DATA, "raw_posts.jsonl"))
    rows = {r.cid: r for r in P.parse_posts(good).collect()}
    assert set(rows) == {"a1", "a2", "a3", "a4"}
    a1 = rows["a1"]
    assert a1.author_handle == "anna.x" and a1.langs == ["de"]
    assert a1.image_thumbnails == ["t1"] and a1.image_fullsizes == ["f1"]  # falsy "" and null skipped
    assert a1.urls == ["https://ext.example/1", "https://facet.example/1"]  # embed first, then facets
    a2 = rows["a2"]
    assert a2.reply_parent_cid == "a1" and a2.reply_root_cid == "a0"
    assert a2.urls == ["bafy1", "bafy2"]  # image ref null is skipped
    a3 = rows["a3"]
    assert a3.author_displayName is None and a3.reply_parent_cid is None
    assert a3.urls == [] and a3.image_thumbnails == []  # other embed type, empty facet uri
    a4 = rows["a4"]
    assert a4.urls == [] and a4.langs is None and a4.likeCount is None
    assert bad.count() == 1 and "unterminated" in bad.first().record


def test_language_and_flags(spark):
    df = spark.createDataFrame(
        [(["de"], ["https://a"], ["t"]), (["en-GB", "de"], [None], []), ([], ["at://x"], []), (None, None, None),
         ([""], [], [])],
        "langs array<string>, urls array<string>, image_thumbnails array<string>")
    out = P.with_media_flags(P.with_language(df)).collect()
    assert [r.language for r in out] == ["de", "en", None, None, ""]
    assert [r.contains_external_url for r in out] == [True, False, False, False, False]
    assert [r.contains_image for r in out] == [True, False, False, False, False]


def test_non_empty_text_modes(spark):
    df = spark.createDataFrame([("a",), ("",), (None,)], "text string")
    assert P.non_empty_text(df).count() == 1
    assert P.non_empty_text(df, legacy=True).count() == 2  # the reference kept NULL texts


def test_dedupe_keeps_first_in_crawl_order(spark):
    df = spark.createDataFrame([("c1", 5, "late"), ("c1", 1, "first"), ("c2", 3, "only"), ("c1", 9, "later")],
                               "cid string, crawl_seq int, v string")
    out = {r.cid: r.v for r in P.dedupe_keep_first(df).collect()}
    assert out == {"c1": "first", "c2": "only"}


def test_points_drop_null_coordinates(spark):
    from crisismap.plans import fixtures as fx

    p = P.with_points(fx.posts(spark, SF_SMALL))
    bad = p.select(F.explode("points").alias("pt")).where("pt.lon IS NULL OR pt.lat IS NULL").count()
    assert bad == 0
    assert P.explode_points(p).count() == p.select(F.sum(F.size("points"))).first()[0]


def test_top_n_other_sums_to_100(spark):
    from crisismap.operators.stats import top_n_other
    from crisismap.plans import fixtures as fx

    p = P.with_language(fx.posts(spark, SF_SMALL)).withColumn("language", F.coalesce("language", F.lit("unk")))
    out = top_n_other(p, "language", 2).collect()
    assert out[-1].language == "other" or any(r.language == "other" for r in out)
    assert abs(sum(r.rel_count for r in out) - 100.0) < 1e-6
    assert len(out) == 3


def test_concat_fills_missing_columns(spark):
    from crisismap.operators import posts as P

    one, two = spark.createDataFrame([(1, "a")], "id int, label string"), spark.createDataFrame([(2, 0.5)], "id int, score double")
    rows = sorted(tuple(r) for r in P.concat_tables(one, two).select("id", "label", "score").collect())
    assert rows == [(1, "a", None), (2, None, 0.5)]
