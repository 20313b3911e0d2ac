"""The byte-range GeoJSON reader against json.loads of whole files, at every cut."""

import io
import json
import random

import pyarrow as pa
import pytest

from crisismap.sources import geo as GS
from crisismap.sources import geojson as GJ


def feature(i, props=None, pad=""):
    ring = [[i, 0.5], [i + 1, 0.5], [i + 1, 2.25], [i, 0.5]]
    return {"type": "Feature", "properties": {"id": i, "note": pad, **(props or {})},
            "geometry": {"type": "Polygon", "coordinates": [ring]} if i % 3 else
            {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}


NASTY = ['"', "\\", '\\"', '{"type": "Feature"}', "}]}", "[,{", "\\\\\\", 'é—漢"}', ",\n\t {", "", 'a\\\\"b']


def nasty_files():
    rng = random.Random(3)
    fs = [feature(i, {"x": [{"type": "Feature"}, rng.choice(NASTY)], rng.choice(NASTY): {"y": [[]]}}, "".join(rng.choices(NASTY, k=i % 5)))
          for i in range(12)]
    whole = {"name": 'floods "a" {[', "crs": {"type": "name", "of": [{"type": "Feature"}], "properties": {"name": "x"}},
             "type": "FeatureCollection", "bbox": [0, 0, 1, 1], "features": fs}
    return {"spaces": json.dumps(whole, indent=2), "tight": json.dumps(whole, separators=(",", ":"), ensure_ascii=False),
            "blanks": json.dumps(whole).replace('{"type"', '  \n {"type"'), "none": json.dumps({**whole, "features": []}),
            "bom": "﻿" + json.dumps(whole)}


def read_cut(data: bytes, cuts):
    """All features of a file read by the ranges between ``cuts``."""
    bounds, state, out = [0, *cuts, len(data)], (0, 0), []
    for start, stop in zip(bounds, bounds[1:]):
        file = pa.PythonFile(io.BytesIO(data), mode="r")
        out += GJ.features(file, start, stop, *state)
        flips, outside, inside = GJ.summary(file, start, stop)
        state = (state[0] + flips) % 2, state[1] + (inside if state[0] else outside)
    return out, state


@pytest.mark.parametrize("name", nasty_files())
def test_any_cut_gives_the_same_features(name):
    text = nasty_files()[name]
    data = text.encode()
    want = json.loads(text.lstrip("﻿"))["features"]
    found, state = read_cut(data, [])
    assert [json.loads(t) for _, t in found] == want and state == (0, 0)
    assert all(data[at:at + len(t.encode())].decode() == t for at, t in found)
    for cut in range(1, len(data), 1 if name == "tight" else 7):
        assert read_cut(data, [cut]) == (found, state), cut
    for step in (1, 3, 64) if name == "tight" else (64,):
        assert read_cut(data, range(step, len(data), step)) == (found, state)


def test_long_feature_and_broken_end(monkeypatch):
    monkeypatch.setattr(GJ, "AHEAD_BYTES", 8)
    fs = [feature(1), feature(2, pad="x" * 5000 + "\\" * 9000 + '"'), feature(4)]
    data = json.dumps({"type": "FeatureCollection", "features": fs}).encode()
    for step in (100, 4097):
        assert [json.loads(t) for _, t in read_cut(data, range(step, len(data), step))[0]] == fs
    cut = data[:data.rindex(b'"geometry"') + 30]
    found = read_cut(cut, [50])[0]
    assert [json.loads(t) for _, t in found[:2]] == fs[:2] and cut.endswith(found[2][1].encode())
    assert read_cut(b"", [])[0] == read_cut(b"not json at all", [4])[0] == []


def test_one_file_by_many_tasks_equals_whole_file_reader(spark, tmp_path, monkeypatch):
    (tmp_path / "sub dir").mkdir()
    rng = random.Random(5)
    many = [feature(i, {"k": rng.choice(NASTY)}) for i in range(400)]
    (tmp_path / "sub dir" / "big é.GeoJSON").write_text(json.dumps({"type": "FeatureCollection", "features": many}), encoding="utf-8")
    (tmp_path / "small.geojson").write_text(json.dumps(
        {"type": "FeatureCollection", "links": [{"type": "text/html"}, {"rel": "self"}], "features": [feature(7)]}))
    (tmp_path / "none.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    (tmp_path / "empty.geojson").write_text("")
    (tmp_path / "other.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(9)]}))

    def rows(df):
        return sorted((r.file_name, r.geom_type, str(r.polygons), json.dumps(json.loads(r.properties), sort_keys=True)) for r in df.collect())

    texts = GJ.feature_texts(spark, str(tmp_path), 1024)
    assert texts.rdd.getNumPartitions() > 50
    assert [json.loads(r.feature) for r in texts.where("path like '%GeoJSON'").orderBy("place").collect()] == many
    got = rows(GS.scan_geojson(spark, str(tmp_path), 1024))
    assert len(got) == 401 and got == rows(GS.scan_geojson(spark, str(tmp_path)))
    monkeypatch.setattr(GS, "can_open", lambda path: False)
    whole = GS.scan_geojson(spark, str(tmp_path)).where("file_name <> 'empty.geojson'")
    assert rows(whole) == got


def test_broken_file_gives_its_name(spark, tmp_path):
    text = json.dumps({"type": "FeatureCollection", "features": [feature(1), feature(2)]})
    (tmp_path / "cut.geojson").write_text(text[:-40])
    out = sorted((r.file_name, r.geom_type) for r in GS.scan_geojson(spark, str(tmp_path)).fillna("", ["geom_type"]).collect())
    assert out == [("cut.geojson", ""), ("cut.geojson", "Polygon")]
