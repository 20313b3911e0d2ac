"""GeoJSON files of any size, read by many tasks.

A file is cut into byte ranges. Where a range begins, two things must be known: whether the place lies in a string, and how
many brackets are open. A first pass works out for each range, for both cases, how it changes the two; running sums over a
file's ranges, a few numbers each, then give the true state at every range's start. In the second pass a task
parses what begins in its range, reading on past its end for the last feature. Nothing is guessed from the text,
so a name that looks like a feature's beginning is no danger.
"""

from __future__ import annotations

import urllib.parse
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE_BYTES = 32 << 20
AHEAD_BYTES = 64 << 10
BATCH_CHARS = 4 << 20
# A feature is an object in an array in the outermost object.
FEATURE_DEPTH = 3
QUOTE, BACKSLASH = ord('"'), ord("\\")
BLANKS = b" \t\r\n"
_SIGN = np.zeros(256, np.int8)
_SIGN[[ord("{"), ord("[")]] = 1
_SIGN[[ord("}"), ord("]")]] = -1


def open_file(path: str) -> pa.NativeFile:
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    system, name = fs.FileSystem.from_uri(urllib.parse.quote(path, safe=":/@"))
    return system.open_input_file(name)


def can_open(path: str) -> bool:
    """Whether pyarrow opens the file by the URI that Spark gives."""
    try:
        open_file(path).close()
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def _before(file: pa.NativeFile, start: int) -> bytes:
    """One byte that stands for all before ``start``: a backslash if the next byte is escaped, else the last one that is
    not blank."""
    run = blank = True
    slashes, at = 0, start
    while at > 0 and (run or blank):
        size = min(at, 4096)
        file.seek(at - size)
        data, at = file.read(size), at - size
        if run:
            kept = data.rstrip(b"\\")
            slashes += len(data) - len(kept)
            run = not kept
        if not run and slashes:
            break
        if blank and (kept := data.rstrip(BLANKS)):
            last, blank = kept[-1:], False
    if slashes:
        return b"\\" if slashes % 2 else b" "
    return b" " if blank else last


def _read(file: pa.NativeFile, start: int, stop: int) -> np.ndarray:
    first = _before(file, start)
    file.seek(start)
    return np.frombuffer(first + file.read(stop - start), np.uint8)


def _structure(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of brackets, their signs, and the number of quotes before each (mod 2); the quotes' total is appended.
    The first byte is the one that ``_before`` gives and isn't counted."""
    quotes = np.flatnonzero(data[1:] == QUOTE) + 1
    slashes, left = np.zeros(quotes.size, np.int64), np.flatnonzero(data[quotes - 1] == BACKSLASH)
    while left.size:  # backslashes in a row before each quote
        slashes[left] += 1
        left = left[quotes[left] > slashes[left]]
        left = left[data[quotes[left] - 1 - slashes[left]] == BACKSLASH]
    quotes = quotes[slashes % 2 == 0]
    sign = _SIGN[data]
    sign[0] = 0
    places = np.flatnonzero(sign)
    return places, sign[places], np.append(np.searchsorted(quotes, places), quotes.size) % 2


def summary(file: pa.NativeFile, start: int, stop: int) -> tuple[int, int, int]:
    """Whether a range changes between inside and outside of a string, and by how much it changes the depth if it
    begins outside and if it begins inside."""
    _, sign, odd = _structure(_read(file, start, stop))
    return int(odd[-1]), *(int(sign[odd[:-1] == case].sum(dtype=np.int64)) for case in (0, 1))


def _scan(data: np.ndarray, in_string: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Where features begin and end in ``data``."""
    places, sign, odd = _structure(data)
    outside = odd[:-1] == in_string
    places, sign = places[outside], sign[outside]
    level, char = depth + np.cumsum(sign, dtype=np.int64), data[places]
    begins = places[(char == ord("{")) & (level == FEATURE_DEPTH)]
    ends = places[(char == ord("}")) & (level == FEATURE_DEPTH - 1)]
    # an object in an array follows a comma or a bracket; one after a colon is a member's value
    at = begins - 1
    while (blank := np.flatnonzero(np.isin(data[at], np.frombuffer(BLANKS, np.uint8)) & (at > 0))).size:
        at[blank] -= 1
    return begins[np.isin(data[at], np.frombuffer(b"[,", np.uint8))], ends


def features(file: pa.NativeFile, start: int, stop: int, in_string: int, depth: int) -> Iterator[tuple[int, str]]:
    """(place in the file, text) of the features that begin in a range."""
    data = _read(file, start, stop)
    begins, ends = _scan(data, in_string, depth)
    after = np.searchsorted(ends, begins)
    for begin, i in zip(begins.tolist(), after.tolist(), strict=True):
        place = start + begin - 1
        if i < ends.size:
            yield place, data[begin:int(ends[i]) + 1].tobytes().decode("utf-8", "replace")
        else:  # the last one, which goes on behind the range
            yield place, _rest(file, place, stop - place)


def _rest(file: pa.NativeFile, place: int, size: int) -> str:
    total = file.size()
    while True:
        size = min(2 * size + AHEAD_BYTES, total - place)
        data = _read(file, place, place + size)
        _, ends = _scan(data, 0, FEATURE_DEPTH - 1)
        if ends.size:
            return data[1:int(ends[0]) + 1].tobytes().decode("utf-8", "replace")
        if place + size >= total:  # breaks off
            return data[1:].tobytes().decode("utf-8", "replace")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop")), strict=True):
            with open_file(path) as file:
                rows.append((path, start, stop, *summary(file, start, stop)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, (
            pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
            ["path", "start", "stop", "flips", "outside", "inside"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((
            pa.string(), pa.int64(), pa.string()))], ["path", "place", "feature"])

    for batch in batches:
        for path, start, stop, in_string, depth in zip(*(batch.column(c).to_pylist() for c in (
                "path", "start", "stop", "in_string", "depth")), strict=True):
            rows, held = [], 0
            with open_file(path) as file:
                for place, text in features(file, start, stop, in_string, depth):
                    rows.append((path, place, text))
                    held += len(text)
                    if held > BATCH_CHARS:
                        yield out(rows)
                        rows, held = [], 0
            if rows:
                yield out(rows)


def file_name_of(path: str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every ``*.geojson`` (any case) under ``root``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.where(F.lower("path").endswith(".geojson"))


def feature_texts(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, place, feature) for each feature of all GeoJSON files under ``root``: its first byte's place and its text.

    Features are the objects directly in an array of a file's outermost object, which in a
    FeatureCollection is ``features``. One that breaks off at the end of a file is given as far as it
    goes. The files must be in a store that pyarrow can open by the URI that Spark gives.
    """
    files = list_files(spark, root)
    size = files.agg(F.sum("length").alias("bytes"), F.count("*").alias("files")).first()
    tasks = max(-(-(size["bytes"] or 0) // range_bytes), min(size["files"], spark.sparkContext.defaultParallelism), 1)
    ranges = files.where("length > 0").select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    ).select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("stop")).repartition(tasks)
    changes = ranges.mapInArrow(_summaries, "path string, start long, stop long, flips int, outside long, inside long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = changes.withColumn("in_string", (F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2).cast("int"))
    known = known.withColumn("change", F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside")))
    known = known.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    return known.select("path", "start", "stop", "in_string", "depth").repartition(tasks).mapInArrow(
        _features, "path string, place long, feature string")
