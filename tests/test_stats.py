import math

from pyspark.sql import functions as F

from crisismap.operators import stats as S


def _bins(spark, counts, edges=S.FLOOD_EDGES, labels=S.FLOOD_LABELS):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "i int, count long")
    return {r.i: r.count_bin for r in S.with_bins(df, "count", edges, labels).collect()}


def test_bins_cases(spark):
    got = _bins(spark, [0, 1, 4, 5, 500])
    assert got == {0: None, 1: "1–4", 2: "1–4", 3: "5–9", 4: "500+"}
    got = _bins(spark, [501, 200, 499])
    assert got == {0: "500+", 1: "200–499", 2: "200–499"}
    got = _bins(spark, [7, 1])  # max 7: edges 1, 5, 8
    assert got == {0: "5–9", 1: "1–4"}
    got = _bins(spark, [0, 0])  # max 0: a single edge, no bin (empty crosstab)
    assert got == {0: None, 1: None}


def test_crosstab_keeps_empty_bins(spark):
    df = spark.createDataFrame([(1, False), (2, True), (30, False), (30, True), (0, True)], "count long, f boolean")
    out = {r.count_bin: (r.no_hazard, r.hazard) for r in
           S.binned_crosstab(df, "count", "f", S.FLOOD_EDGES, S.FLOOD_LABELS).collect()}
    assert out == {"1–4": (1, 1), "5–9": (0, 0), "10–19": (0, 0), "20–49": (1, 1)}


def test_pearson_edges_and_p_values(spark):
    rows = [("n0", None, None), ("n1", 1.0, 2.0), ("n2", 1.0, 2.0), ("n2", 2.0, 3.0),
            ("const", 1.0, 1.0), ("const", 1.0, 2.0), ("const", 1.0, 3.0),
            ("pos", 1.0, 2.0), ("pos", 2.0, 4.0), ("pos", 3.0, 6.0),
            ("neg", 1.0, 3.0), ("neg", 2.0, 2.0), ("neg", 3.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    out = {r.g: r for r in S.pearson_p(S.pearson(df, "x", "y", ["g"])).collect()}
    assert "n0" not in out  # no complete pair
    assert out["n1"].r is None and out["const"].r is None
    assert math.isclose(out["pos"].r, 1.0) and math.isclose(out["neg"].r, -1.0)
    assert out["n2"].p_value is None  # n - 2 = 0 degrees of freedom
    # t-table: df = 8, two-sided 0.05 -> t = 2.306; 0.01 -> t = 3.355
    for t, p in ((2.306, 0.05), (3.355, 0.01)):
        r = t / math.sqrt(8 + t * t)
        assert abs(S.t_two_sided_p(r, 10) - p) < 5e-4


def test_describe_matches_linear_percentiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10)], "v double")
    r = S.describe(df, "v").first()
    assert r["count"] == 5 and r["min"] == 1 and r["max"] == 10
    assert (r["p25"], r["p50"], r["p75"]) == (2.0, 3.0, 4.0)
    assert math.isclose(r["std"], 3.5355339059327378)


def test_mode_frequency(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    assert math.isclose(S.mode_frequency(df, "v").first()[0], 2 / 3)
