import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crisismap.operators import multipattern as M


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abé\x00", max_size=6), max_size=12, unique=True), st.lists(st.one_of(st.none(), st.text("abcé\x00", max_size=60)), max_size=8),
       st.sampled_from([1, 3, 7, 512]), st.sampled_from([1, 20, 1 << 20]))
def test_matches_equal_substring_tests(patterns, texts, window, slice_bytes):
    held = M.WINDOW, M.SLICE_BYTES
    M.WINDOW, M.SLICE_BYTES = window, slice_bytes
    try:
        got = M.found_in(pa.array([None, *texts, "x"], pa.string()).slice(1), M.Automaton([p.encode() for p in patterns]), pa.array(patterns, pa.string()))
    finally:
        M.WINDOW, M.SLICE_BYTES = held
    assert got.to_pylist() == [None if t is None else [p for p in patterns if p in t] for t in [*texts, "x"]]


@pytest.mark.parametrize("automaton_bytes", [1 << 20, 9])
def test_keywords_in_any_number_of_automata(spark, automaton_bytes):
    words = spark.createDataFrame([(w,) for w in ["Flood", "flood", "flooding", "oo", None, "", "fire é", "zzz"]], "keyword string")
    texts = spark.createDataFrame([(1, "FLOODING and Fire É"), (2, None), (3, ""), (4, "f" * 100_000 + "lood")], "id int, text string")
    rows = texts.withColumn("k", M.keywords_in(F.col("text"), words, automaton_bytes=automaton_bytes)).collect()
    got = {r.id: r.k if r.k is None else sorted(r.k) for r in rows}
    assert got == {1: ["", "fire é", "flood", "flooding", "oo"], 2: None, 3: [""], 4: ["", "flood", "oo"]}
    none = texts.withColumn("k", M.keywords_in(F.col("text"), words.limit(0))).collect()
    assert [r.k for r in none] == [[], None, [], []]


@pytest.mark.parametrize("limits", [{}, {"PIECE": 4, "PIECE_ROWS": 3, "CHUNK_RUNS": 2, "PAIRS": 1}, {"PIECE": 4, "CHUNK_USES": 0}, {"SHORT_LIST": 100}])
def test_a_list_as_long_as_the_corpus_is_joined_with_its_runs(spark, monkeypatch, limits):
    """Rows that contain each keyword, without a text being run over the list; with SHORT_LIST the automaton does the same."""
    for name, value in {"SHORT_LIST": 0, **limits}.items():
        monkeypatch.setattr(M, name, value)
    words = ["Flood", "flood", "lood", "floodplain", "oo", "é1", "İ", "abcabcabcabcabc", "abcabcabcabcabcx", "zzz", "-]", "😀😀", "o" * 30, "", None]
    texts = ["FLOODING flood", "floodplain, flood é1", "xé1x", None, "", "abc" * 40, "a\\-]^b", "é\u0000😀😀😀", "o" * 1000, "nİn", "flood", "flood"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    got = M.keyword_counts(rows, "t", spark.createDataFrame([(w,) for w in words], "keyword string")).collect()
    plain = {w: sum(w in t.lower() for t in texts if t is not None) for w in {w.lower() for w in words if w is not None}}
    assert sorted((r.keyword, r.documents) for r in got) == sorted((w, n) for w, n in plain.items() if n)


def test_no_keyword_or_no_text(spark, monkeypatch):
    monkeypatch.setattr(M, "SHORT_LIST", -1)
    rows, none = spark.createDataFrame([("ab",), (None,)], "t string"), spark.createDataFrame([], "keyword string")
    assert M.keyword_counts(rows, "t", none).collect() == []
    assert M.keyword_counts(rows.limit(0), "t", rows.withColumnRenamed("t", "keyword")).collect() == []
    assert [tuple(r) for r in M.keyword_counts(rows, "t", spark.createDataFrame([("",)], "keyword string")).collect()] == [("", 1)]
