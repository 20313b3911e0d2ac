"""Explicit schemas applied at read time (no inference pass over the data)."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)


def _s(*fields: tuple) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


STR_ARRAY = ArrayType(StringType())

AUTHOR = _s(("displayName", StringType()), ("handle", StringType()), ("did", StringType()))
REPLY = _s(("parent", _s(("cid", StringType()))), ("root", _s(("cid", StringType()))))
RECORD_EMBED = _s(
    ("$type", StringType()),
    ("external", _s(("uri", StringType()))),
    ("images", ArrayType(_s(("image", _s(("ref", _s(("$link", StringType())))))))),
)
FACETS = ArrayType(_s(("features", ArrayType(_s(("uri", StringType()))))))
RECORD = _s(
    ("createdAt", StringType()),
    ("langs", STR_ARRAY),
    ("text", StringType()),
    ("reply", REPLY),
    ("embed", RECORD_EMBED),
    ("facets", FACETS),
)
VIEW_EMBED = _s(("images", ArrayType(_s(("thumb", StringType()), ("fullsize", StringType())))))

# One post as returned by the search service (nested JSON).
RAW_POST = _s(
    ("cid", StringType()),
    ("uri", StringType()),
    ("author", AUTHOR),
    ("record", RECORD),
    ("embed", VIEW_EMBED),
    ("replyCount", LongType()),
    ("repostCount", LongType()),
    ("likeCount", LongType()),
    ("quoteCount", LongType()),
)

# The flat 17-column post row.
POST_COLUMNS = (
    "cid", "uri", "author_displayName", "author_handle", "author_did", "createdAt", "langs", "text",
    "replyCount", "repostCount", "likeCount", "quoteCount", "reply_parent_cid", "reply_root_cid",
    "image_thumbnails", "image_fullsizes", "urls",
)

TOPONYM = _s(
    ("text", StringType()),
    ("start_char", IntegerType()),
    ("end_char", IntegerType()),
    ("loc_name", StringType()),
    ("country_name", StringType()),
    ("latitude", DoubleType()),
    ("longitude", DoubleType()),
    ("score", DoubleType()),
)
GEOCODED = _s(("text", StringType()), ("toponyms", ArrayType(TOPONYM)))

POINT = _s(("lon", DoubleType()), ("lat", DoubleType()))
RING = ArrayType(POINT)

GAZETTEER = _s(("name", StringType()), ("country_name", StringType()), ("latitude", DoubleType()),
               ("longitude", DoubleType()), ("population", LongType()))

TOPIC_EVALUATION = _s(
    ("clustering_algorithm", StringType()), ("nr_topics", IntegerType()), ("actual_topics", LongType()),
    ("train_size", LongType()), ("test_size", LongType()),
    ("test_coherence", DoubleType()), ("test_diversity", DoubleType()), ("test_quality", DoubleType()),
    ("train_coherence", DoubleType()), ("train_diversity", DoubleType()), ("train_quality", DoubleType()),
    ("status", StringType()),
)
