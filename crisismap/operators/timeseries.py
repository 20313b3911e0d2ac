"""Daily / weekly series with calendar fill.

Pattern everywhere: aggregate first (partial aggregation map-side, one row
per day leaves the shuffle), then join the small per-day table to a calendar
generated from the one-row min/max aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def calendar(df: DataFrame, date: str = "date", end: str | None = None) -> DataFrame:
    """Every day from min(date) to max(date) (or to a fixed ``end``)."""
    hi = F.lit(end).cast("date") if end else F.max(date)
    bounds = df.agg(F.min(date).alias("lo"), hi.alias("hi"))
    return bounds.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias(date))


def complete_days(daily: DataFrame, fill: dict[str, object], date: str = "date",
                  end: str | None = None) -> DataFrame:
    """Left join the per-day table to the full calendar; missing measures -> ``fill``."""
    cal = calendar(daily, date, end)
    out = cal.join(daily, date, "left")
    return out.fillna(fill)


def daily_counts(df: DataFrame, ts: str = "ts", name: str = "count") -> DataFrame:
    """A3: rows per day, NULL timestamps dropped, zero-filled."""
    daily = (df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("date"))
             .agg(F.count(F.lit(1)).alias(name)))
    return complete_days(daily, {name: 0})


def daily_share(df: DataFrame, ts: str = "ts", label: str = "disaster_related") -> DataFrame:
    """A4: per day total, sum of the label and 100 * label / total (0 when total = 0)."""
    daily = (df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("date"))
             .agg(F.count(F.lit(1)).alias("total"),
                  F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("disaster")))
    filled = complete_days(daily, {"total": 0, "disaster": 0})
    return filled.withColumn(
        "prop_disaster",
        F.when(F.col("total") > 0, F.col("disaster") * 100.0 / F.col("total")).otherwise(F.lit(0.0)))


def daily_label_share(df: DataFrame, labels: list[str], ts: str = "ts", name: str = "emotion") -> DataFrame:
    """A5: per-day label sums + total, zero-filled, long form, percentage of the day's total."""
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in labels]
    daily = df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("date")).agg(*aggs)
    filled = complete_days(daily, {c: 0 for c in ["total", *labels]})
    long = filled.unpivot(["date", "total"], labels, name, "count")
    return long.withColumn(
        "percentage", F.when(F.col("total") > 0, F.col("count") * 100.0 / F.col("total")).otherwise(F.lit(0.0)))


def daily_fires(fires: DataFrame, ts: str = "ACQ_DATETIME", end: str = "2025-02-14") -> DataFrame:
    """A9 + J7: detections per day from the first day to a fixed end date."""
    daily = fires.groupBy(F.to_date(ts).alias("date")).agg(F.count(F.lit(1)).alias("fire_count"))
    return complete_days(daily, {"fire_count": 0}, end=end)


def distinct_days(df: DataFrame, ts: str) -> DataFrame:
    """Sorted distinct days."""
    return df.select(F.to_date(ts).alias("date")).where(F.col("date").isNotNull()).distinct().orderBy("date")


def tumbling_counts(df: DataFrame, ts: str, size: str, keys: list[str] | None = None) -> DataFrame:
    """Tumbling event-time windows (e.g. '1 day', '30 minutes') per key."""
    keys = keys or []
    return (df.groupBy(F.window(ts, size).alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("count"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "count"))
