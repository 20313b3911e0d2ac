"""Registered queries: sources and sinks, each written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from crisismap.operators import posts as P
from crisismap.operators import stats as S
from crisismap.plans import fixtures as fx
from crisismap.plans.oracle_views import with_views
from crisismap.plans.q_ingest import ORACLE as INGEST_ORACLE
from crisismap.plans.q_posts import RAW_STRUCT
from crisismap.session import shared_folder
from crisismap.sources import geo as GS
from crisismap.sources import posts as SP
from crisismap.sources import tables as TB
from crisismap.streaming.ingest import ingest_stream

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None, views=()):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        return fn
    return deco


@register("raw_json_scan", views=("posts",), sql="""
SELECT 'good' AS status, cid, createdAt, text, likeCount FROM posts WHERE doc_id % 50 <> 7
UNION ALL
SELECT 'quarantine', 'c' || doc_id, NULL, NULL, NULL FROM posts WHERE doc_id % 50 = 7""")
def raw_json_scan(spark, base):
    """S1 + I4: raw post JSON lines, every 50th cut off in the middle; broken ones go to the quarantine."""
    lines = fx.posts(spark, base).select("doc_id", F.to_json(F.expr(RAW_STRUCT)).alias("json"))
    cut = F.when(F.col("doc_id") % 50 == 7, F.concat(F.lit('{"cid":"c'), F.col("doc_id"), F.lit('","uri":'))).otherwise(F.col("json"))
    path = shared_folder(spark, "raw-posts")
    lines.select(cut.alias("value")).write.text(path)
    good, bad = SP.read_raw_posts_checked(spark, path)
    good = P.parse_posts(good).select(F.lit("good").alias("status"), "cid", "createdAt", "text", "likeCount")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("createdAt", "string"), ("text", "string"), ("likeCount", "long"))]
    bad = bad.select(F.lit("quarantine").alias("status"), F.regexp_extract("record", '"cid":"(c[0-9]+)"', 1).alias("cid"), *none)
    return good.unionByName(bad)


@register("delimited_round_trip", views=("posts",), sql="""
SELECT cid, crawl_seq, ts, disaster_related, likeCount,
  '[' || array_to_string(list_transform(langs, x -> '"' || x || '"'), ',') || ']' AS langs FROM posts""")
def delimited_round_trip(spark, base):
    """S3: tab-separated file with a header; the list column comes back as JSON text."""
    path = shared_folder(spark, "posts-tsv")
    TB.write_delimited(fx.posts(spark, base).select("cid", "crawl_seq", "ts", "disaster_related", "likeCount", "langs"), path)
    return TB.read_delimited(spark, path, "cid string, crawl_seq long, ts timestamp_ntz, disaster_related int, "
                                          "likeCount long, langs string")


@register("partitioned_round_trip", views=("posts",), sql="""
SELECT CAST(ts AS DATE) AS day, count(*) AS count FROM posts WHERE ts IS NOT NULL AND disaster_related = 1 GROUP BY 1""")
def partitioned_round_trip(spark, base):
    """S7 + S8: counts fanned out to a directory for each subset, read back with the directory key pruned."""
    posts = fx.posts(spark, base).where(F.col("ts").isNotNull()).withColumn("day", F.to_date("ts"))
    counts = [posts.where(cond).groupBy("day").agg(F.count("*").alias("count")).withColumn("subset", F.lit(name))
              for name, cond in (("all", F.lit(True)), ("related", F.col("disaster_related") == 1))]
    path = shared_folder(spark, "day-counts")
    TB.write_cell_counts(counts[0].unionByName(counts[1]), path)
    return TB.read_cell_counts(spark, path).where(F.col("subset") == "related").select("day", "count")


@register("embeddings_round_trip", sql="""
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims, CAST(embedding[1] AS DOUBLE) AS first,
  CAST(embedding[len(embedding)] AS DOUBLE) AS last FROM embeddings""")
def embeddings_round_trip(spark, base):
    """Keyed embeddings saved and loaded."""
    path = shared_folder(spark, "embeddings")
    TB.write_embeddings(fx.embeddings(spark, base), path, key="vec_id")
    return TB.read_embeddings(spark, path).select(
        "vec_id", F.size("embedding").alias("dims"), F.get("embedding", F.lit(0)).cast("double").alias("first"),
        F.element_at("embedding", -1).cast("double").alias("last"))


@register("fires_scan", views=("fires",), sql="""
SELECT lon, lat, ACQ_DATE + to_minutes(CAST(ACQ_TIME // 100 * 60 + ACQ_TIME % 100 AS BIGINT)) AS ACQ_DATETIME FROM fires""")
def fires_scan(spark, base):
    """S6 + T5: the fire table as CSV, read with its schema; date and HHMM time become a timestamp."""
    path = shared_folder(spark, "fires-csv")
    fx.fires(spark, base).select("lon", "lat", F.col("ACQ_DATE").cast("string"), "ACQ_TIME").write.option("header", True).csv(path)
    return GS.read_fires(spark, path, "csv").select("lon", "lat", "ACQ_DATETIME")


@register("stream_ingest", sql=None)  # its SQL is that of the batch twin, below
def stream_ingest(spark, base):
    """The streaming ingest over landed JSON, run to the end of what has landed."""
    source, sink = shared_folder(spark, "landed"), shared_folder(spark, "ingested")
    posts = fx.posts(spark, base)
    # one copy of each post, the first: a stream's own choice among copies depends on the order of arrival
    first = P.dedupe_keep_first(posts, "cid", "crawl_seq")
    first.select(F.to_json(F.expr(RAW_STRUCT)).alias("value")).write.text(source)
    # an event far ahead closes all windows
    spark.range(1).select(F.to_json(F.struct(F.lit("end").alias("cid"), F.struct(
        F.lit("2999-01-01T00:00:00Z").alias("createdAt"), F.lit("").alias("text")).alias("record"))).alias("value")
    ).write.mode("append").text(source)
    query = ingest_stream(spark, source, fx.keywords(spark), sink, watermark="1 day")
    query.awaitTermination()
    out = spark.read.parquet(sink)
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")], "keyword", "count")


ORACLE["stream_ingest"] = INGEST_ORACLE["ingest_counts"]


@register("value_range", views=("posts",), sql="""
SELECT max(likeCount) AS max, min(likeCount) AS min, avg(likeCount) AS mean FROM posts""")
def value_range(spark, base):
    """A15."""
    return S.scalars(fx.posts(spark, base), "likeCount")


@register("post_preview", views=("posts",), sql="""
SELECT cid, crawl_seq, likeCount FROM posts ORDER BY likeCount DESC, cid, crawl_seq LIMIT 5""")
def post_preview(spark, base):
    """K7: a preview (five rows are the feature)."""
    posts = fx.posts(spark, base).select("cid", "crawl_seq", "likeCount")
    return S.preview(posts.withColumn("_order", -F.col("likeCount")), "_order", "cid", "crawl_seq").drop("_order")


@register("geoparquet_round_trip", sql="""
SELECT s_suppkey AS flood_id, 'MultiPolygon' AS geom_type, CAST(CASE WHEN broken THEN 1 ELSE 2 END AS INTEGER) AS polygons,
  CAST(CASE WHEN broken THEN 4 ELSE 15 END AS INTEGER) AS vertices,
  CASE WHEN broken THEN 4 * cx ELSE 5 * cx - half + 5 * cx - (half - 0.125) + 5 * (cx + half + 0.375) - 0.125 END AS sum_lon
FROM (SELECT s_suppkey, s_suppkey % 10 = 1 AS broken, 2 + ((s_suppkey * 37) % 248) / 8 AS cx,
        CAST(0.125 * (2 + s_suppkey % 23) AS DOUBLE) AS half FROM supplier)""")
def geoparquet_round_trip(spark, base):
    """S4 + X3: flood polygons with holes and parts written as GeoParquet (WKB) and read back."""
    path = shared_folder(spark, "floods-geo")
    geom = F.struct(F.lit("MultiPolygon").alias("geom_type"), F.array().cast("array<struct<lon:double,lat:double>>").alias("points"),
                    F.col("polygons"))
    GS.write_geoparquet(fx.lake_floods(spark, base).select("flood_id", geom.alias("geom")), path)
    rings = F.flatten(F.flatten("geom.polygons"))
    return GS.read_geoparquet(spark, path).select(
        "flood_id", "geom.geom_type", F.size("geom.polygons").alias("polygons"), F.size(rings).alias("vertices"),
        F.aggregate(rings, F.lit(0.0), lambda a, p: a + p["lon"]).alias("sum_lon"))


def landed_geojson(spark, base) -> str:
    """The flood boxes as GeoJSON files named like the product's, one for each tile and day, and a file of another name."""
    path = shared_folder(spark, "geojson")
    name = F.concat_ws("_", "equi7grid_cont", "equi7grid_tile_id", F.lit("ENSEMBLE_FLOOD"),
                       F.date_format("sensing_date", "yyyyMMdd'T'HHmmss"), "polarisation", F.lit("EU020M"), "equi7grid_tile_id",
                       F.date_format("file_date", "yyyyMMdd"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("flood_id").alias("properties"), F.struct(
        F.lit("Polygon").alias("type"), F.array(F.transform("ring", lambda p: F.array(p["lon"], p["lat"]))).alias("coordinates")).alias("geometry"))
    files = fx.floods(spark, base).select(name.alias("name"), feature.alias("f")).groupBy("name").agg(F.collect_list("f").alias("features"))
    files.select("name", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).unionByName(
        spark.range(1).select(F.lit("readme").alias("name"), F.lit('{"type": "FeatureCollection", "features": []}').alias("value"))
    ).repartition("name").write.partitionBy("name").text(path)
    # Spark names part files itself: each directory's one file gets the product's name
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/name=*/part-*")):
        given = status.getPath().getParent().getName().removeprefix("name=")
        fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, f"{given}.geojson"))
    return path


@register("geojson_scan", views=("floods",), sql="""
SELECT flood_id, equi7grid_cont, equi7grid_tile_id, TIMESTAMP '2024-09-12 04:45:55' + to_days(CAST(flood_id % 3 AS INTEGER)) AS sensing_date,
  'VV' AS polarisation, file_date, 'Polygon' AS geom_type,
  cx - half AS west, cy + half AS north FROM floods""")
def geojson_scan(spark, base):
    """S5 + F10 + P12 + T8 + T9: features of all flood files, with the attributes that the files' names give."""
    floods, _, _ = GS.read_flood_delineations(spark, landed_geojson(spark, base))
    ring = F.flatten(F.flatten("polygons"))
    return floods.select(F.get_json_object("properties", "$.flood_id").cast("long").alias("flood_id"), "equi7grid_cont", "equi7grid_tile_id",
                         "sensing_date", "polarisation", "file_date", "geom_type", F.array_min(F.transform(ring, lambda p: p["lon"])).alias("west"),
                         F.array_max(F.transform(ring, lambda p: p["lat"])).alias("north"))


@register("geojson_report", views=("floods",), sql="""
SELECT 'delineation' AS product, count(DISTINCT equi7grid_tile_id || file_date::VARCHAR) AS files, count(*) AS features FROM floods
UNION ALL SELECT 'footprint', 0, 0 UNION ALL SELECT 'unmatched', 1, 0""")
def geojson_report(spark, base):
    """Files and features of each product, and files whose name fits none."""
    floods, footprints, unmatched = GS.read_flood_delineations(spark, landed_geojson(spark, base))
    more = unmatched.agg(F.lit("unmatched").alias("product"), F.count("*").alias("files"), F.lit(0).cast("long").alias("features"))
    return GS.scan_report(floods, footprints).unionByName(more).select("product", "files", "features")
