import datetime as dt

from pyspark.sql import functions as F

from crisismap.functions import text as T


def test_clean_text_golden(spark):
    cases = [
        ("Hallo @müller_2 wie", "Hallo @user wie"),
        ("mail me at a@b.org", "mail me at a@user.org"),
        ("see https://x.org/@bob now", "see http now"),
        ("go www.site.de/p ok", "go http ok"),
        ("line\nbreak", "linebreak"),
        ("a &amp;lt; b", "a &lt; b"),
        ("caf&eacute; &#39;x&#39;", "café 'x'"),
        (None, None),
    ]
    df = spark.createDataFrame(cases, "text string, expected string")
    for r in df.select(T.clean_text("text").alias("got"), "expected").collect():
        assert r.got == r.expected


def test_tokens_unicode_words(spark):
    df = spark.createDataFrame([("Über Straße a_b 12 x é",)], "t string")
    assert df.select(T.tokens("t").alias("k")).first().k == ["über", "straße", "a_b", "12"]


def test_strict_and_lenient_timestamps(spark):
    df = spark.createDataFrame([("2024-12-24T00:37:00.000Z",), ("2024-12-24T00:37:00Z",),
                                ("2024-12-24T00:37:00+00:00",), ("2024-12-24T00:37:00.1234567Z",)], "c string")
    strict = [r.s for r in df.select(T.parse_created_at("c", strict=True).alias("s")).collect()]
    assert strict[0] is not None and strict[1:] == [None, None, None]
    lenient = [r.s for r in df.select(T.parse_created_at("c", strict=False).alias("s")).collect()]
    assert all(v is not None for v in lenient[:3])


def test_fire_timestamp_padding(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, 8), 5), (dt.date(2025, 1, 8), 45), (dt.date(2025, 1, 8), 930),
                                (dt.date(2025, 1, 8), 2359)], "d date, t int")
    got = [r.x for r in df.select(T.fire_timestamp("d", "t").cast("timestamp_ntz").alias("x")).collect()]
    assert got == [dt.datetime(2025, 1, 8, 0, 5), dt.datetime(2025, 1, 8, 0, 45), dt.datetime(2025, 1, 8, 9, 30),
                   dt.datetime(2025, 1, 8, 23, 59)]


def test_iso_week_across_new_year(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 30),), (dt.date(2025, 1, 5),), (dt.date(2024, 12, 28),)], "d date")
    rows = df.select(T.iso_week("d").alias("w"), T.iso_year("d").alias("y")).collect()
    assert [(r.y, r.w) for r in rows] == [(2025, 1), (2025, 1), (2024, 52)]


def test_percent_label(spark):
    df = spark.createDataFrame([(12.345,), (100.0,)], "x double")
    assert [r.l for r in df.select(T.percent_label("x").alias("l")).collect()] == ["12.3%", "100.0%"]
