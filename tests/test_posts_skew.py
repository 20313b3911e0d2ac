from pyspark.sql import functions as F

from crisismap.session import left_join_spread


def test_rows_without_a_key_are_dealt_over_tasks(spark):
    """Two thirds of all posts have no page: a plain left join shuffles them to one task."""
    left = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.col("id") % 50).alias("page_id"))
    right = spark.range(-20, 40).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), F.col("id")).alias("url"))
    got = left_join_spread(left, right.hint("merge"), "page_id", "doc_id")
    want = left.join(right, "page_id", "left")
    assert sorted(got.select("doc_id", "page_id", "url").collect(), key=str) == sorted(want.select("doc_id", "page_id", "url").collect(), key=str)
    kept, spark_coalesce = got.withColumn("part", F.spark_partition_id()), "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(spark_coalesce)
    spark.conf.set(spark_coalesce, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        sizes = [r["count"] for r in kept.where("page_id IS NULL").groupBy("part").count().collect()]
    finally:
        spark.conf.set(spark_coalesce, before)
        spark.conf.unset("spark.sql.shuffle.partitions")
    assert len(sizes) > 4 and max(sizes) < 1000
