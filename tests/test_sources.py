import os
import struct

from pyspark.sql import functions as F

from conftest import DATA, SF_SMALL
from crisismap.sources import geo as GS
from crisismap.sources import tables as TB


def _pt(x, y, order="<"):
    return struct.pack(order + "BIdd", 1 if order == "<" else 0, 1, x, y)


def test_wkb_goldens(spark):
    hole = [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]]

    def poly(rings):
        out = struct.pack("<BII", 1, 3, len(rings))
        for r in rings:
            out += struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", x, y) for x, y in r)
        return out

    values = [
        _pt(1.5, 2.5),
        struct.pack("<BII", 1, 4, 0),
        struct.pack("<BII", 1, 4, 1) + _pt(1, 1),
        struct.pack("<BII", 1, 4, 3) + _pt(1, 1) + _pt(2, 2) + _pt(3, 3, ">"),
        poly(hole),
        struct.pack("<BII", 1, 6, 2) + poly(hole) + poly([[(9, 9), (10, 9), (10, 10), (9, 9)]]),
        _pt(-3.25, 7.0, ">"),
        None,
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, g binary")
    got = {r.i: r.d for r in df.select("i", GS.decode_wkb("g").alias("d")).collect()}
    assert got[0].geom_type == "Point" and (got[0].points[0].lon, got[0].points[0].lat) == (1.5, 2.5)
    assert got[1].geom_type == "MultiPoint" and got[1].points == []
    assert len(got[2].points) == 1 and len(got[3].points) == 3 and got[3].points[2].lon == 3.0
    assert got[4].geom_type == "Polygon" and len(got[4].polygons[0]) == 2 and len(got[4].polygons[0][1]) == 4
    assert got[5].geom_type == "MultiPolygon" and len(got[5].polygons) == 2
    assert (got[6].points[0].lon, got[6].points[0].lat) == (-3.25, 7.0)
    assert got[7] is None or got[7].geom_type is None
    # writer round trip
    for i in (0, 3, 4, 5):
        d = GS.decode_wkb_value(values[i])
        assert GS.decode_wkb_value(GS.encode_wkb_value(d)) == d


def test_geojson_directory_scan(spark):
    flood, fp, unmatched = GS.read_flood_delineations(spark, os.path.join(DATA, "flood_files"))
    rows = flood.collect()
    assert len(rows) == 2 and {r.geom_type for r in rows} == {"Polygon", "MultiPolygon"}
    r = rows[0]
    assert r.equi7grid_cont == "EU" and r.equi7grid_tile_id == "E054N012T3" and r.polarisation == "VV"
    assert str(r.file_date) == "2024-09-29" and str(r.sensing_date) == "2024-09-29 04:45:55"
    assert fp.count() == 1 and fp.first().unique_id == "1"
    assert [u.file_name for u in unmatched.collect()] == ["unrelated_name.geojson"]
    rep = {x["product"]: (x["files"], x["features"]) for x in GS.scan_report(flood, fp).collect()}
    assert rep == {"delineation": (1, 2), "footprint": (1, 1)}


def test_delimited_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([("c1", 3, ["a", "b"]), ("c2", 0, [])], "cell_id string, count int, words array<string>")
    path = os.path.join(tmp_dir, "tsv")
    TB.write_delimited(df, path)
    back = TB.read_delimited(spark, path, "cell_id string, count int, words string")
    got = {r.cell_id: (r["count"], r.words) for r in back.collect()}
    assert got == {"c1": (3, '["a","b"]'), "c2": (0, "[]")}


def test_partitioned_cell_counts(spark, tmp_dir):
    df = spark.createDataFrame([("EU", 4, "all", "c1", 2), ("EU", 5, "related", "c2", 1)],
                               "region string, level int, subset string, cell_id string, count long")
    path = os.path.join(tmp_dir, "cells")
    TB.write_cell_counts(df, path)
    back = TB.read_cell_counts(spark, path).where(F.col("level") == 5)
    plan = back._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "level" in pruned  # the filter reaches the directories
    assert back.count() == 1 and back.first().cell_id == "c2"


def test_fires_scan(spark, tmp_dir):
    path = os.path.join(tmp_dir, "fires")
    spark.createDataFrame([(1.0, 2.0, "2025-01-08", 930)], "lon double, lat double, ACQ_DATE string, ACQ_TIME int") \
        .write.parquet(path)
    r = GS.read_fires(spark, path).first()
    assert str(r.ACQ_DATETIME) == "2025-01-08 09:30:00"


def test_embeddings_round_trip(spark, tmp_dir):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    path = os.path.join(tmp_dir, "emb")
    TB.write_embeddings(emb, path)
    assert TB.read_embeddings(spark, path).count() == emb.count()
