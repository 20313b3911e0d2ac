"""Incremental ingest of landed post JSON (I2, I3) and its batch twin.

Stream: ``readStream`` of JSON files with the explicit schema -> flatten ->
event-time watermark -> ``dropDuplicatesWithinWatermark(cid)`` -> keyword
match by one automaton of all keywords -> 30-minute tumbling counts per
keyword, appended to Parquet once the watermark closes a window. The
checkpoint folder (offsets, state) lives under the cluster's shared
``spark.checkpoint.dir`` unless a location is given; ``availableNow``
processes what has landed and stops, so the job can run as a batch step and
resume after a failure.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crisismap.functions.text import parse_created_at
from crisismap.operators.multipattern import keywords_in
from crisismap.operators.posts import dedupe_keep_first, parse_posts
from crisismap.schemas import RAW_POST
from crisismap.session import checkpoint_dir


def _windowed_counts(posts: DataFrame, keywords: DataFrame, minutes: int, ts: str = "ts") -> DataFrame:
    m = posts.where(F.col("text").isNotNull()).select(ts, F.explode(keywords_in(F.col("text"), keywords)).alias("keyword"))
    return (m.groupBy(F.window(ts, f"{minutes} minutes").alias("w"), "keyword").agg(F.count(F.lit(1)).alias("count"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "keyword", "count"))


def ingest_counts_batch(posts: DataFrame, keywords: DataFrame, minutes: int = 30, ts: str = "ts",
                        order: str = "crawl_seq") -> DataFrame:
    """Batch twin: keep-first dedupe by cid, keyword match, tumbling counts."""
    first = dedupe_keep_first(posts.select("cid", order, "text", ts), "cid", order)
    return _windowed_counts(first, keywords, minutes, ts)


def ingest_stream(spark: SparkSession, source: str, keywords: DataFrame, sink: str, minutes: int = 30,
                  watermark: str = "1 day", checkpoint: str | None = None, trigger_once: bool = True):
    """Start the streaming ingest; returns the ``StreamingQuery`` (``availableNow`` by default)."""
    raw = spark.readStream.schema(RAW_POST).option("mode", "PERMISSIVE").json(source)
    posts = parse_posts(raw).withColumn("ts", parse_created_at("createdAt", strict=False).cast("timestamp"))
    dedup = posts.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["cid"])
    counts = _windowed_counts(dedup.select("cid", "text", "ts"), keywords, minutes)
    location = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/ingest-{hashlib.sha256(sink.encode()).hexdigest()}"
    writer = (counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", location)
              .option("path", sink))
    writer = writer.trigger(availableNow=True) if trigger_once else writer.trigger(processingTime="1 minute")
    return writer.start()
