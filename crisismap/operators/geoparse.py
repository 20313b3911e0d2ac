"""Gazetteer geoparsing (N6, P8), re-aimed from the reference's NER + reranker.

Only the output contract is matched: per text, an offset-ordered array of
toponyms ``{text, start_char, end_char, loc_name, country_name, latitude,
longitude, score}``. Recognition is a gazetteer lookup of word n-grams, as long
as the gazetteer's longest name, longest match first. Words of a name may be
parted by one space, hyphen or apostrophe, or a full stop and a space, and a text
must part them alike.

A text's words are found in one pass over it, so its n-grams with their offsets leave
it without any window or shuffle; those shorter than any name of as many words stay behind. They meet the gazetteer in an equi join (broadcast if it is proven
small), and only the hits shuffle by text: a match inside a longer one is
dropped (running max of match ends in start order), an ambiguous name resolves
to its most populous entry, and matches are collected per text in offset order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from crisismap.session import keep, maybe_broadcast, spread

WORD_START = r"^[\p{L}\p{N}_]"
WORD = r"[\p{L}\p{N}_]+"
# How many first words of names are worth a filter, and candidates that leave a task at once.
BATCH_ROWS = 50_000
FIRST_WORDS = 10_000
GAPS = (" ", "-", "'", "\u2019", ". ")


def _norm(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("\u2019"), F.lit("'"))


def resolve_gazetteer(gazetteer: DataFrame) -> DataFrame:
    """One entry per normalised name: the most populous wins (ties: lower latitude, longitude)."""
    bare = F.regexp_replace(F.regexp_replace("name", r"\s+", " "), r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")
    g = gazetteer.withColumn("norm", _norm(bare)).where("norm <> ''")
    best = F.max_by(F.struct("name", "country_name", "latitude", "longitude", "population"),
                    F.struct("population", -F.col("latitude"), -F.col("longitude")))
    return g.groupBy("norm").agg(best.alias("g")).select("norm", "g.*")


@cache
def word_class(spark: SparkSession) -> str:
    """Word characters as ranges of a Python pattern, as Spark sees them (its Unicode version may be another one)."""
    code = F.col("id")
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    of = spark.range(0, 0x110000, 1, 4).where((code < 0xD800) | (code > 0xDFFF)).where(char.rlike(WORD_START))
    codes = [r[0] for r in of.collect()]
    begins = [c for c, before in zip(codes, [-2, *codes], strict=False) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -2], strict=True) if c != after - 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(begins, ends, strict=True))


def least_lengths(gazetteer: DataFrame, longest: int) -> list[float]:
    """Length of the shortest name of 1 to ``longest`` words (infinite where there is none)."""
    words = F.size(F.regexp_extract_all("norm", F.lit(WORD), F.lit(0)))
    # a capital I with a dot becomes two characters, of which the dot is no part of a word
    dotted = F.contains("norm", F.lit("\u0307"))
    least = [float("inf")] * longest
    for n, two, length in gazetteer.groupBy(words.alias("n"), dotted.alias("d")).agg(F.min(F.length("norm"))).collect():
        for i in range(longest):
            if two:
                least[i] = min(least[i], length // 2)
            elif i + 1 == max(n, 1):
                least[i] = min(least[i], length)
    return least


def candidates(df: DataFrame, key: str, text: str = "text", longest: int = 3,
               first_words: list[str] | None = None, least: list[float] | None = None) -> DataFrame:
    """(key, start, end, ngram, norm) for all n-grams of 1 to ``longest`` words of each text.

    With ``first_words`` (normalised) only those that may begin with one of them, with ``least`` only those
    that are as long as that for their number of words.
    """
    pattern = f"[{word_class(df.sparkSession)}]+"
    first = None if first_words is None else frozenset(first_words)
    least = least or [0] * longest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, gaps = re.compile(pattern), frozenset(GAPS)
        for batch in batches:
            rows, starts, ends, grams = [], [], [], []

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()),  # noqa: B023
                                                   pa.array(ends, pa.int64()), pa.array(grams, pa.string())], names)  # noqa: B023

            for row in range(batch.num_rows):
                whole = batch.column(1)[row].as_py()
                spans = [m.span() for m in words.finditer(whole)]
                floor = [n / 2 for n in least] if "\u0130" in whole else least
                for i, (start, end) in enumerate(spans):
                    # what isn't ASCII may be lowered in other ways than here: the join decides
                    if first is not None and (head := whole[start:end]).isascii() and head.lower() not in first:
                        continue
                    for n in range(longest):
                        if n:
                            if i + n == len(spans) or whole[end:spans[i + n][0]] not in gaps:
                                break
                            end = spans[i + n][1]
                        if end - start >= floor[n]:
                            rows.append(row)
                            starts.append(start)
                            ends.append(end)
                            grams.append(whole[start:end])
                if len(rows) > BATCH_ROWS:
                    yield made()
                    rows, starts, ends, grams = [], [], [], []
            if rows:
                yield made()

    names = ["key", "start", "end", "ngram"]
    source = spread(df.select(F.col(key).alias("key"), F.col(text).alias("_text"))).where(F.col("_text").isNotNull())
    schema = StructType([source.schema["key"], StructField("start", LongType()), StructField("end", LongType()), StructField("ngram", StringType())])
    return source.mapInArrow(run, schema).select(F.col("key").alias(key), "start", "end", "ngram", _norm(F.col("ngram")).alias("norm"))


def toponym_rows(df: DataFrame, gazetteer: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per resolved toponym (key, start_char, end_char, text, loc_name, ...)."""
    gaz = keep(resolve_gazetteer(gazetteer))  # read five times
    longest = gaz.agg(F.max(F.size(F.regexp_extract_all("norm", F.lit(WORD), F.lit(0))))).first()[0] or 1
    # a short list of first words goes along as a filter; a longer one would weigh more than it saves
    first = [r[0] for r in gaz.select(F.regexp_extract("norm", WORD, 0)).distinct().limit(FIRST_WORDS + 1).collect()]
    hits = candidates(df, key, text, longest, first if len(first) <= FIRST_WORDS else None,
                      least_lengths(gaz, longest)).join(maybe_broadcast(gaz)[0], "norm")
    w = Window.partitionBy(key).orderBy(F.col("start"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("_cover", F.max("end").over(w))
    kept = hits.where(F.col("_cover").isNull() | (F.col("_cover") < F.col("end")))
    return kept.select(
        key, F.col("start").cast("int").alias("start_char"), F.col("end").cast("int").alias("end_char"),
        F.col("ngram").alias("text"), F.col("name").alias("loc_name"), "country_name", "latitude", "longitude",
        F.round(F.log10(F.col("population").cast("double") + 1) / 10, 6).alias("score"))


def geoparse(df: DataFrame, gazetteer: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """N6 + P8: ``geocoded_dict`` struct (text, toponyms in offset order) for every input row."""
    rows = toponym_rows(df, gazetteer, key, text)
    fields = ["text", "start_char", "end_char", "loc_name", "country_name", "latitude", "longitude", "score"]
    per = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char", *[
        c for c in fields if c not in ("start_char", "end_char")]))).alias("_t"))
    per = per.select(key, F.transform("_t", lambda t: F.struct(*[t[c].alias(c) for c in fields])).alias("toponyms"))
    out = df.join(per, key, "left").withColumn(
        "toponyms", F.coalesce("toponyms", F.array().cast(per.schema["toponyms"].dataType)))
    return out.withColumn("geocoded_dict", F.struct(F.col(text).alias("text"), F.col("toponyms")))
