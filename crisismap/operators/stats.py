"""Report statistics.

Group-level results only ever leave the shuffle as aggregates: counts and
moments combine map-side, percentiles keep one value->count map per group,
and top-k uses a distributed ordered take instead of a global window.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType

# Fixed bin tables of the hazard comparison (edges are [a, b) lower bounds).
FLOOD_EDGES = [1, 5, 10, 20, 50, 100, 200, 500]
FLOOD_LABELS = ["1–4", "5–9", "10–19", "20–49", "50–99", "100–199", "200–499", "500+"]
FIRE_EDGES = [1, 10, 50, 100, 500, 1000, 10000]
FIRE_LABELS = ["1–10", "11-50", "51-100", "101-500", "501-1,000", "1,001-10,000", "10,000+"]

DESCRIBE_PCTS = (0.25, 0.5, 0.75)
TAIL_PCTS = (0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


def label_totals(df: DataFrame, labels: list[str], subset_col: str = "disaster_related") -> DataFrame:
    """Label sums over all rows and over the related subset, long form (subset, emotion, count)."""
    rel = F.coalesce(F.col(subset_col) == 1, F.lit(False))
    tagged = df.select(F.explode(F.when(rel, F.array(F.lit("all"), F.lit("related")))
                                 .otherwise(F.array(F.lit("all")))).alias("subset"),
                       *[F.col(c).cast("int").alias(c) for c in labels])
    wide = tagged.groupBy("subset").agg(*[F.sum(c).alias(c) for c in labels])
    return wide.unpivot(["subset"], labels, "emotion", "count")


def top_values(df: DataFrame, col: str, n: int, name: str = "count") -> DataFrame:
    """K2/K3: n most common non-NULL values, ties by value ascending (distributed ordered take)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
    return counts.orderBy(F.desc(name), F.asc(col)).limit(n)


def top_n_other(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    """Top ``n`` values plus an always-present 'other' row; percent of total and a '%.1f%%' label."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("abs_count"))
    top = counts.orderBy(F.desc("abs_count"), F.asc(col)).limit(n)
    total = counts.agg(F.sum("abs_count").alias("total"))
    top_sum = top.agg(F.coalesce(F.sum("abs_count"), F.lit(0)).alias("top_sum"))
    other = total.crossJoin(top_sum).select(F.lit("other").alias(col),
                                            (F.col("total") - F.col("top_sum")).alias("abs_count"))
    rows = top.unionByName(other).crossJoin(total)
    rel = F.col("abs_count") * 100.0 / F.col("total")
    return rows.select(col, "abs_count", F.round(rel, 6).alias("rel_count"),
                       F.format_string("%.1f%%", rel).alias("label"))


def scale_to(df: DataFrame, col: str, other: DataFrame, other_col: str, out: str) -> DataFrame:
    """M2 + J14: ``col * (max(other_col) * 1.1) / max(col)`` via a one-row scalar join."""
    a = other.agg(F.max(other_col).alias("_max_a"))
    b = df.agg(F.max(col).alias("_max_b"))
    factor = a.crossJoin(b).select(F.try_divide(F.col("_max_a") * 1.1, F.col("_max_b") * 1.0).alias("_f"))
    return df.crossJoin(factor).withColumn(out, F.col(col) * F.col("_f")).drop("_f")


def bin_edges(max_col: Column, edges: list[int]) -> Column:
    """M3: fixed edges kept up to the maximum, then ``max + 1`` appended as the last edge."""
    fixed = F.array(*[F.lit(int(e)).cast("long") for e in edges])
    return F.concat(F.filter(fixed, lambda e: e <= max_col), F.array((max_col + 1).cast("long")))


def bin_index(value: Column, edges: Column) -> Column:
    """0-based [a, b) bin of ``value``; NULL below the first edge or at/after the last one."""
    i = F.size(F.filter(edges, lambda e: e <= value)) - 1
    return F.when((i >= 0) & (i < F.size(edges) - 1), i)


def _edges_per_group(df: DataFrame, col: str, edges: list[int], keys: list[str]) -> DataFrame:
    """One row per group with its data-dependent edge list (groups = ``keys``, or one global row)."""
    return df.groupBy(*keys).agg(bin_edges(F.max(col), edges).alias("_edges"))


def _attach(df: DataFrame, per_group: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(per_group, keys, "left") if keys else df.crossJoin(per_group)


def with_bins(df: DataFrame, col: str, edges: list[int], labels: list[str], keys: list[str] | None = None) -> DataFrame:
    """Attach ``bin`` (index) and ``count_bin`` (label); the last edge depends on the group's max."""
    keys = keys or []
    lab = F.array(*[F.lit(x) for x in labels])
    out = _attach(df, _edges_per_group(df, col, edges, keys), keys)
    out = out.withColumn("bin", bin_index(F.col(col), F.col("_edges")))
    return out.withColumn("count_bin", F.try_element_at(lab, F.col("bin") + 1)).drop("_edges")


def bins_table(df: DataFrame, col: str, edges: list[int], labels: list[str], keys: list[str] | None = None) -> DataFrame:
    """All bins of the data-dependent edge list per group (index, label, lower, upper)."""
    keys = keys or []
    lab = F.array(*[F.lit(x) for x in labels])
    e = _edges_per_group(df, col, edges, keys)
    ex = e.select(*keys, F.posexplode("_edges").alias("bin", "lower"), "_edges")
    ex = ex.where(F.col("bin") < F.size("_edges") - 1).where(F.col("bin") < len(labels))
    return ex.select(*keys, "bin", F.element_at(lab, F.col("bin") + 1).alias("count_bin"), "lower",
                     F.element_at("_edges", F.col("bin") + 2).alias("upper"))


def binned_crosstab(df: DataFrame, col: str, flag: str, edges: list[int], labels: list[str],
                    names: tuple[str, str] = ("no_hazard", "hazard"), keys: list[str] | None = None) -> DataFrame:
    """A10: bins x flag counts, pivoted with explicit flag values; empty bins kept as zeros."""
    keys = keys or []
    binned = with_bins(df, col, edges, labels, keys).where(F.col("bin").isNotNull())
    piv = (binned.groupBy(*keys, "bin").pivot(flag, [False, True]).agg(F.count(F.lit(1)))
           .withColumnRenamed("false", names[0]).withColumnRenamed("true", names[1]))
    allbins = bins_table(df, col, edges, labels, keys)
    return (allbins.join(piv, [*keys, "bin"], "left").fillna(0, subset=list(names))
            .select(*keys, "bin", "count_bin", "lower", "upper", *names))


def describe(df: DataFrame, col: str, pcts: tuple = DESCRIBE_PCTS, keys: list[str] | None = None) -> DataFrame:
    """Count, mean, sample std, min, exact linear percentiles, max of one column (per group)."""
    keys = keys or []
    c = F.col(col).cast("double")
    q = F.percentile(c, F.array(*[F.lit(p) for p in pcts]))
    out = df.groupBy(*keys).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                                F.min(c).alias("min"), q.alias("_q"), F.max(c).alias("max"))
    return out.select(*keys, "count", "mean", "std", "min",
                      *[F.col("_q")[i].alias(f"p{_pname(p)}") for i, p in enumerate(pcts)], "max")


def describe_columns(df: DataFrame, cols: list[str] | None = None, pcts: tuple = DESCRIBE_PCTS) -> DataFrame:
    """A11 over every numeric column (or those named): one row each, from one pass over the table."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                         for c in cols])).alias("x")).select("x.*")
    return describe(long, "value", pcts, ["column"])


def _pname(p: float) -> str:
    return f"{p * 100:g}".replace(".", "_")


def describe_by(df: DataFrame, keys, col: str, pcts: tuple = TAIL_PCTS) -> DataFrame:
    """Grouped describe, transposed to long form (keys..., stat, value)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    wide = describe(df, col, pcts, keys).withColumn("count", F.col("count").cast("double"))
    stats = [c for c in wide.columns if c not in keys]
    return wide.unpivot(keys, stats, "stat", "value")


def pearson(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """A13 + F7: Pearson r over rows where both are non-NULL; NULL when n <= 1 or a column is constant.

    Built from moments with ``try_divide`` (``corr`` raises under ANSI for a
    constant column). ``pearson_p`` adds the two-sided p-value.
    """
    keys = keys or []
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    m = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.var_pop(xs).alias("_vx"),
                                F.var_pop(ys).alias("_vy"), F.covar_pop(xs, ys).alias("_cxy"))
    r = F.when((F.col("n") > 1) & (F.col("_vx") > 0) & (F.col("_vy") > 0),
               F.try_divide(F.col("_cxy"), F.sqrt(F.col("_vx") * F.col("_vy"))))
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r))  # greatest/least skip NULLs, so guard first
    return m.select(*keys, "n", F.when(r.isNotNull(), clamped).alias("r"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """DLMF 8.17.22, the continued fraction 1/(1 + d1/(1 + d2/(1 + ...))), from its tail to its head.

    Below the mean of the distribution its terms shrink fast; the tail is cut
    where doubling the number of terms no longer changes the value.
    """
    def term(n: int) -> float:
        m = n // 2
        if n % 2:
            return -(a + m) * (a + b + m) * x / ((a + n - 1) * (a + n))
        return m * (b - m) * x / ((a + n - 1) * (a + n))

    terms, known = 16, math.inf
    while True:
        value = 1.0
        for n in range(terms, 0, -1):
            value = 1.0 + term(n) / value
        if abs(value - known) <= 1e-15 * abs(value) or terms > 1 << 20:
            return 1.0 / value
        known, terms = value, 2 * terms


def _betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function; the symmetry I_x(a, b) = 1 - I_{1-x}(b, a) keeps x below the mean."""
    if not 0.0 < x < 1.0:
        return float(x >= 1.0)
    if x > a / (a + b):
        return 1.0 - _betainc(b, a, 1.0 - x) if 1.0 - x <= b / (a + b) else _beta_head(a, b, x)
    return _beta_head(a, b, x)


def _beta_head(a: float, b: float, x: float) -> float:
    logs = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(logs) / a * _beta_fraction(a, b, x)


def t_two_sided_p(r: float | None, n: int | None) -> float | None:
    """Two-sided p of Pearson r with n pairs: t = r sqrt((n-2)/(1-r^2)), df = n - 2."""
    if r is None or n is None or n < 3 or (isinstance(r, float) and math.isnan(r)):
        return None
    if abs(r) >= 1.0:
        return 0.0
    df = n - 2
    t = abs(r) * math.sqrt(df / (1.0 - r * r))
    return _betainc(df / 2.0, 0.5, df / (df + t * t))


@F.pandas_udf(DoubleType())
def _p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(None if pd.isna(a) else float(a), None if pd.isna(b) else int(b))
                      for a, b in zip(r, n)], dtype="float64")


def pearson_p(summary: DataFrame) -> DataFrame:
    """Add the p-value to a ``pearson`` summary (one row per group, so Python sees only those rows)."""
    return summary.withColumn("p_value", _p_udf(F.col("r"), F.col("n")))


def mode_frequency(df: DataFrame, col: str) -> DataFrame:
    """Relative frequency of the most common non-NULL value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.try_divide(F.max("n").cast("double"), F.sum("n").cast("double")).alias("mode_frequency"))


def scalars(df: DataFrame, col: str) -> DataFrame:
    """Max / min / mean."""
    c = F.col(col)
    return df.agg(F.max(c).alias("max"), F.min(c).alias("min"), F.avg(c.cast("double")).alias("mean"))


def preview(df: DataFrame, *order: str, n: int = 5) -> DataFrame:
    """K7: the first n rows in a total order (a top-k, so only n rows of each task move)."""
    return df.orderBy(*order).limit(n)


def accuracy(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """Share of rows where prediction equals truth."""
    return df.agg(F.avg((F.col(pred) == F.col(truth)).cast("double")).alias("accuracy"))
