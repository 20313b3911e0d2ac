from pyspark.sql import functions as F

from conftest import SF_SMALL
from crisismap.operators import geoparse as GP
from crisismap.plans import fixtures as fx
from crisismap.sources.tables import read_table


def test_longest_match_and_ambiguity(spark):
    docs = spark.createDataFrame([(1, "Floods in New York City and York, new york!"), (2, None), (3, "nothing")],
                                 "doc_id long, text string")
    gaz = spark.createDataFrame([("York", "UK", 53.9, -1.1, 200000), ("York", "US", 40.0, -76.7, 40000),
                                 ("New York", "US", 40.7, -74.0, 8000000), ("New York City", "US", 40.7, -74.0, 8000001)],
                                "name string, country_name string, latitude double, longitude double, population long")
    rows = GP.toponym_rows(docs, gaz).orderBy("start_char").collect()
    assert [(r.start_char, r.end_char, r.text, r.loc_name) for r in rows] == [
        (10, 23, "New York City", "New York City"), (28, 32, "York", "York"), (34, 42, "new york", "New York")]
    assert rows[1].country_name == "UK"  # the most populous entry of an ambiguous name
    out = {r.doc_id: r.toponyms for r in GP.geoparse(docs, gaz).collect()}
    assert out[2] == [] and out[3] == [] and [t.start_char for t in out[1]] == [10, 28, 34]


def test_names_of_any_length_and_joint(spark):
    names = ["San Juan del Sur", "Aix-en-Provence", "L'Aquila", "New York", "St. Louis"]
    docs = spark.createDataFrame([(1, "San Juan del Sur, Aix-en-Provence, L\u2019Aquila; St. Louis to New York. San  Juan")],
                                 "doc_id long, text string")
    gaz = spark.createDataFrame([(n, "C", 1.0, 2.0, 10) for n in names],
                                "name string, country_name string, latitude double, longitude double, population long")
    rows = GP.toponym_rows(docs, gaz).orderBy("start_char").collect()
    text = docs.first().text
    assert [r.loc_name for r in rows] == ["San Juan del Sur", "Aix-en-Provence", "L'Aquila", "St. Louis", "New York"]
    assert all(text[r.start_char:r.end_char] == r.text for r in rows)


def test_shuffled_gazetteer_matches(spark, monkeypatch):
    docs = read_table(spark, SF_SMALL, "documents", ["doc_id", "text"])
    gaz = fx.gazetteer(spark, SF_SMALL)
    a = GP.toponym_rows(docs, gaz)
    monkeypatch.setattr(GP, "maybe_broadcast", lambda df: (df, False))
    b = GP.toponym_rows(docs, gaz)
    assert a.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_only_ngrams_as_long_as_a_name_leave_a_text(spark):
    docs = spark.createDataFrame([(1, "Oslo to San Juan, a fine day by the sea"), (2, None)], "doc_id long, text string")
    gaz = GP.resolve_gazetteer(spark.createDataFrame([("Oslo", "N", 1.0, 2.0, 1), ("San Juan", "P", 1.0, 2.0, 1)],
                               "name string, country_name string, latitude double, longitude double, population long"))
    least = GP.least_lengths(gaz, 2)
    assert least == [4, 8]
    rows = GP.candidates(docs, "doc_id", longest=2, least=least).collect()
    assert {(r.start, r.end, r.ngram) for r in rows} == {(0, 4, "Oslo"), (8, 16, "San Juan"), (12, 16, "Juan"), (20, 24, "fine"), (20, 28, "fine day")}


def test_letters_of_all_scripts(spark):
    names = ["İstanbul", "Москва", "\U00010400\U00010401\U00010402", "東京"]
    text = "İSTANBUL, МОСКВА; \U0001f30d \U00010400\U00010401\U00010402 東京!"
    docs = spark.createDataFrame([(None, text)], "doc_id long, text string")
    gaz = spark.createDataFrame([(n, "C", 1.0, 2.0, 10) for n in names],
                                "name string, country_name string, latitude double, longitude double, population long")
    least = GP.least_lengths(GP.resolve_gazetteer(gaz), 2)
    found = {r.norm: text[r.start:r.end] for r in GP.candidates(docs, "doc_id", longest=2, least=least).collect()}
    norms = [r.norm for r in GP.resolve_gazetteer(gaz).collect()]
    assert set(norms) <= set(found) and found["москва"] == "МОСКВА"
