"""Keyword x interval harvest over landed posts.

The reference asked a search service once per (keyword, 30-minute interval)
and kept the first page (<= 100 posts). Over posts already landed in a
table, the interval becomes an equi key (floor of the timestamp to the
step), the keyword match is one run of an automaton over each text (no join of
posts x keywords), and the page cap is a top-100 per task with a deterministic
order (newest first, then cid).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crisismap.operators.multipattern import keywords_in
from crisismap.session import cut_lineage


def _span(spark, start, end) -> DataFrame:
    if isinstance(start, DataFrame):
        return start.select(F.col("start").cast("timestamp_ntz").alias("_lo"), F.col("end").cast("timestamp_ntz").alias("_hi"))
    return spark.range(1).select(F.lit(start).cast("timestamp_ntz").alias("_lo"),
                                 F.lit(end).cast("timestamp_ntz").alias("_hi"))


def harvest_tasks(keywords: DataFrame, start, end=None, step_minutes: int = 30, col: str = "keyword") -> DataFrame:
    """Every (interval, keyword) task, interval-major and keyword-minor, with a task number.

    ``start``/``end`` are timestamps, or ``start`` is a one-row DataFrame with
    ``start`` and ``end`` columns (e.g. the span of the landed posts).
    """
    kw = keywords.select(F.col(col).alias("keyword"), F.monotonically_increasing_id().alias("_o"))
    kw = kw.groupBy("keyword").agg(F.min("_o").alias("_o"))  # Q1: first occurrence of a duplicate wins
    # keywords are numbered by the counts of their ranges, and each unfolds its own intervals: no row or task holds them all
    dealt = kw.repartitionByRange("_o").sortWithinPartitions("_o").select(
        "keyword", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    dealt = cut_lineage(dealt)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_c")).select(
        "_part", "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    step = F.expr(f"make_dt_interval(0, 0, {int(step_minutes)}, 0)")
    span = _span(keywords.sparkSession, start, end)
    # as long as an interval begins before the end, the last one whole even if the end cuts it
    since = F.when(F.col("_lo") < F.col("_hi"), F.filter(
        F.sequence(F.col("_lo"), F.greatest("_lo", "_hi"), step), lambda s: s < F.col("_hi")))
    out = dealt.join(parts, "_part").crossJoin(F.broadcast(span)).select(
        "keyword", (F.col("_at") - F.col("_first") + F.col("_before")).alias("_j"), "_n", F.posexplode(since).alias("_i", "since"))
    return out.select((F.col("_i") * F.col("_n") + F.col("_j")).cast("long").alias("task_no"), "keyword", "since",
                      (F.col("since") + step).alias("until"))


def day_span(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: midnight of the first day and of the day after the last (the harvest span of the data)."""
    return df.agg(F.date_trunc("day", F.min(ts)).cast("timestamp_ntz").alias("start"),
                  (F.date_trunc("day", F.max(ts)).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")).alias("end"))


def harvest_match(posts: DataFrame, keywords: DataFrame, start, end=None, step_minutes: int = 30,
                  limit: int = 100, text: str = "text", ts: str = "ts", key: str = "cid",
                  tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """I1 + F15 + W7: posts per (keyword, interval) whose text contains the keyword and whose time
    lies in [since, until), at most ``limit`` each, newest first then ``key``. A post may match
    several tasks. The interval is an equi key computed per row (no range join)."""
    span = _span(posts.sparkSession, start, end)
    p = posts.where(F.col(ts).isNotNull() & F.col(text).isNotNull()).crossJoin(F.broadcast(span))
    p = p.where((F.col(ts) >= F.col("_lo")) & (F.col(ts) < F.col("_hi")))
    matched = p.withColumn("keyword", F.explode(keywords_in(F.col(text), keywords)))
    # interval index from a zone-free difference of wall-clock times (no session time zone, no DST)
    idx = F.floor(F.expr(f"timestampdiff(MINUTE, _lo, CAST(`{ts}` AS TIMESTAMP_NTZ))") / int(step_minutes))
    matched = matched.withColumn("since", F.col("_lo") + F.make_dt_interval(
        F.lit(0), F.lit(0), (idx * int(step_minutes)).cast("int"), F.lit(0)))
    matched = matched.withColumn("until", F.col("since") + F.expr(f"make_dt_interval(0, 0, {int(step_minutes)}, 0)"))
    w = Window.partitionBy("keyword", "since").orderBy(F.desc(ts), F.asc(key), *[F.asc(c) for c in tiebreak])
    out = matched.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return out.drop("_lo", "_hi")


def dedupe_harvest(df: DataFrame, key: str = "cid", order: str = "crawl_seq") -> DataFrame:
    """I2 (batch): one row per post across tasks, first in crawl order (see ``dedupe_keep_first``)."""
    from crisismap.operators.posts import dedupe_keep_first

    return dedupe_keep_first(df, key, order)
