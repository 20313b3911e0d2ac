"""Geometry sources: WKB columns (S4), GeoJSON directories (S5, F10, P12, T9, A21), fire tables.

Geometries become arrays of ``struct<lon, lat>`` at read time; decoding WKB is
a small vectorised helper (pandas UDF over Arrow batches), everything else is
plain DataFrame code.
"""

from __future__ import annotations

import struct as _struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import (ArrayType, BinaryType, DoubleType, IntegerType, StringType, StructField,
                               StructType)

from crisismap.functions.text import fire_timestamp
from crisismap.sources.geojson import RANGE_BYTES, can_open, feature_texts, file_name_of, list_files

_PT = StructType([StructField("lon", DoubleType()), StructField("lat", DoubleType())])
GEOMETRY = StructType([
    StructField("geom_type", StringType()),
    StructField("points", ArrayType(_PT)),
    StructField("polygons", ArrayType(ArrayType(ArrayType(_PT)))),
])
_TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}


def _read_geom(buf: bytes, off: int):
    order = "<" if buf[off] == 1 else ">"
    (kind,) = _struct.unpack_from(order + "I", buf, off + 1)
    off += 5
    if kind & 0x20000000:  # EWKB SRID flag
        off += 4
    base = (kind & 0xFFFF) % 1000
    if base == 1:
        x, y = _struct.unpack_from(order + "dd", buf, off)
        return "Point", [(x, y)], [], off + 16
    if base in (2, 3):
        if base == 2:
            (n,) = _struct.unpack_from(order + "I", buf, off)
            pts = list(zip(*[iter(_struct.unpack_from(order + "d" * 2 * n, buf, off + 4))] * 2))
            return "LineString", pts, [], off + 4 + 16 * n
        (nr,) = _struct.unpack_from(order + "I", buf, off)
        off += 4
        rings = []
        for _ in range(nr):
            (n,) = _struct.unpack_from(order + "I", buf, off)
            vals = _struct.unpack_from(order + "d" * 2 * n, buf, off + 4)
            rings.append(list(zip(vals[0::2], vals[1::2])))
            off += 4 + 16 * n
        return "Polygon", [], [rings], off
    if base in (4, 5, 6):
        (n,) = _struct.unpack_from(order + "I", buf, off)
        off += 4
        pts, polys = [], []
        for _ in range(n):
            _, p, q, off = _read_geom(buf, off)
            pts += p
            polys += q
        return _TYPES[base], pts, polys, off
    raise ValueError(f"unsupported WKB geometry type {kind}")


def decode_wkb_value(b):
    if b is None:
        return None
    kind, pts, polys, _ = _read_geom(bytes(b), 0)
    return {"geom_type": kind,
            "points": [{"lon": x, "lat": y} for x, y in pts],
            "polygons": [[[{"lon": x, "lat": y} for x, y in ring] for ring in poly] for poly in polys]}


@F.arrow_udf(GEOMETRY)
def _decode(col: pa.Array) -> pa.Array:
    return pa.array([decode_wkb_value(b) for b in col.to_pylist()], to_arrow_type(GEOMETRY))


def decode_wkb(c) -> Column:
    """WKB/EWKB (either byte order) -> struct(geom_type, points, polygons)."""
    return _decode(F.col(c) if isinstance(c, str) else c)


def encode_point_wkb(lon: float, lat: float) -> bytes:
    return _struct.pack("<BIdd", 1, 1, lon, lat)


def encode_wkb_value(g: dict) -> bytes:
    """Writer side: little-endian WKB of a decoded geometry (Point, MultiPoint, Polygon, MultiPolygon)."""
    kind = g["geom_type"]
    pts = [(p["lon"], p["lat"]) for p in (g.get("points") or [])]
    polys = [[[(p["lon"], p["lat"]) for p in ring] for ring in poly] for poly in (g.get("polygons") or [])]

    def poly_bytes(poly):
        out = _struct.pack("<BII", 1, 3, len(poly))
        for ring in poly:
            out += _struct.pack("<I", len(ring)) + b"".join(_struct.pack("<dd", x, y) for x, y in ring)
        return out

    if kind == "Point":
        return encode_point_wkb(*pts[0])
    if kind == "MultiPoint":
        return _struct.pack("<BII", 1, 4, len(pts)) + b"".join(encode_point_wkb(x, y) for x, y in pts)
    if kind == "Polygon":
        return poly_bytes(polys[0])
    if kind == "MultiPolygon":
        return _struct.pack("<BII", 1, 6, len(polys)) + b"".join(poly_bytes(p) for p in polys)
    raise ValueError(kind)


@F.arrow_udf(BinaryType())
def _encode(col: pa.Array) -> pa.Array:
    return pa.array([encode_wkb_value(g) if g and g["geom_type"] else None for g in col.to_pylist()], pa.binary())


def encode_wkb(c) -> Column:
    return _encode(F.col(c) if isinstance(c, str) else c)


def read_geoparquet(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    """GeoParquet scan; the WKB column is decoded, plain Parquet (no such column) passes through."""
    df = spark.read.parquet(path)
    if geometry not in df.columns:
        return df
    return df.withColumn("geom", decode_wkb(geometry)).drop(geometry)


def write_geoparquet(df: DataFrame, path: str, geom: str = "geom", geometry: str = "geometry") -> None:
    """S4, the other way: a decoded geometry struct goes out as a WKB column; all other columns as they are."""
    df.withColumn(geometry, encode_wkb(geom)).drop(geom).write.parquet(path)


# ---------------------------------------------------------------- S5 -------
# Fixed file-name patterns of the flood products (named groups in order).
FLOOD_NAME = (r"^([A-Za-z]+)_([A-Za-z0-9]+)_ENSEMBLE_FLOOD_([A-Za-z0-9]+)_([A-Za-z]+)_([A-Z]{2}020M)_"
              r"([A-Za-z0-9]+)_([0-9]+)\.geojson$")
FLOOD_GROUPS = ("equi7grid_cont", "equi7grid_tile_id", "sensing_date", "polarisation", "equi7grid_cont_2",
                "equi7grid_tile_id_2", "file_date")
FOOTPRINT_NAME = r"^([A-Za-z]+)_([A-Za-z0-9]+)_sentinel-1_footprint_([0-9]+)_([0-9]+)\.geojson$"
FOOTPRINT_GROUPS = ("equi7grid_cont", "equi7grid_tile_id", "unique_id", "file_date")

_FEATURE = StructType([
    StructField("type", StringType()),
    StructField("properties", StringType()),
    StructField("geometry", StructType([StructField("type", StringType()), StructField("coordinates", StringType())])),
])
_FC = StructType([StructField("type", StringType()), StructField("features", ArrayType(_FEATURE))])


def _rings_from_json(coords: Column, gtype: Column) -> Column:
    """GeoJSON Polygon / MultiPolygon coordinates -> array of polygons (each an array of rings)."""
    poly = F.from_json(coords, "array<array<array<double>>>")
    multi = F.from_json(coords, "array<array<array<array<double>>>>")
    to_pt = "transform({r}, ring -> transform(ring, p -> named_struct('lon', p[0], 'lat', p[1])))"
    one = F.expr(to_pt.format(r="_poly"))
    many = F.expr("transform(_multi, pg -> " + to_pt.format(r="pg") + ")")
    return F.when(gtype == "Polygon", F.array(one)).when(gtype == "MultiPolygon", many), poly, multi


def scan_geojson(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every ``*.geojson`` (any case) under ``root``: one row per feature with file name and polygons.

    Files are read by byte ranges, many tasks to a large one. A file without features gives no row; a feature that breaks
    off at its file's end gives one with its file name only. Where only Spark can open the files, each is
    read whole by one task, and one that isn't JSON gives a row with its name only.
    """
    first = list_files(spark, root).first()
    if first is None or can_open(first["path"]):
        schema = StructType([*_FEATURE.fields, StructField("_broken", StringType())])
        parsed = F.from_json("feature", schema, {"columnNameOfCorruptRecord": "_broken"})
        feats = feature_texts(spark, root, range_bytes).select(file_name_of("path").alias("file_name"), parsed.alias("f")).where(
            "f.type = 'Feature' OR f._broken IS NOT NULL")
    else:
        raw = (spark.read.schema(_FC).option("multiLine", True).option("recursiveFileLookup", True)
               .option("mode", "PERMISSIVE").json(root).withColumn("file_name", F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))))
        raw = raw.where(F.lower("file_name").endswith(".geojson"))
        feats = raw.where("features IS NULL OR size(features) > 0").select("file_name", F.explode_outer("features").alias("f"))
    gtype = F.col("f.geometry.type")
    coords = F.col("f.geometry.coordinates")
    expr, poly, multi = _rings_from_json(coords, gtype)
    out = feats.withColumn("_poly", poly).withColumn("_multi", multi)
    return out.select("file_name", gtype.alias("geom_type"), expr.alias("polygons"),
                      F.col("f.properties").alias("properties"))


def _attach(df: DataFrame, pattern: str, groups: tuple[str, ...]) -> DataFrame:
    for i, g in enumerate(groups, start=1):
        df = df.withColumn(g, F.regexp_extract("file_name", pattern, i))
    return df


def read_flood_delineations(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S5 + P12 + T8/T9: (delineations, footprints, unmatched file report).

    File-level attributes come from the name via the two fixed patterns;
    files matching neither are reported (A21) from the listing, not read as data.
    """
    feats = scan_geojson(spark, root)
    is_flood = F.col("file_name").rlike(FLOOD_NAME)
    is_fp = F.col("file_name").rlike(FOOTPRINT_NAME)
    flood = _attach(feats.where(is_flood), FLOOD_NAME, FLOOD_GROUPS)
    flood = (flood.withColumn("sensing_date", F.to_timestamp("sensing_date", "yyyyMMdd'T'HHmmss").cast("timestamp_ntz"))
             .withColumn("file_date", F.to_date("file_date", "yyyyMMdd")))
    fp = _attach(feats.where(~is_flood & is_fp), FOOTPRINT_NAME, FOOTPRINT_GROUPS)
    fp = fp.withColumn("file_date", F.to_date("file_date", "yyyyMMdd")).withColumnRenamed("polygons",
                                                                                          "footprint_polygons")
    unmatched = list_files(spark, root).select(file_name_of("path").alias("file_name")).where(~is_flood & ~is_fp).distinct()
    return flood, fp, unmatched


def scan_report(flood: DataFrame, fp: DataFrame) -> DataFrame:
    """Files combined and features read, per product."""
    a = flood.agg(F.count_distinct("file_name").alias("files"), F.count(F.lit(1)).alias("features")) \
        .withColumn("product", F.lit("delineation"))
    b = fp.agg(F.count_distinct("file_name").alias("files"), F.count(F.lit(1)).alias("features")) \
        .withColumn("product", F.lit("footprint"))
    return a.unionByName(b)


# ---------------------------------------------------------------- S6 -------
FIRE_SCHEMA = StructType([
    StructField("lon", DoubleType()), StructField("lat", DoubleType()),
    StructField("ACQ_DATE", StringType()), StructField("ACQ_TIME", IntegerType()),
])


def read_fires(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S6 + T5: fire detections with ``ACQ_DATETIME`` derived from date + HHMM time."""
    reader = spark.read
    df = reader.parquet(path) if fmt == "parquet" else reader.schema(FIRE_SCHEMA).option("header", True).csv(path)
    return df.withColumn("ACQ_DATETIME", fire_timestamp(F.to_date("ACQ_DATE"), "ACQ_TIME").cast("timestamp_ntz"))
