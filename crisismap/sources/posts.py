"""Raw post scans (S1) with a quarantine for broken input (I4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from crisismap.schemas import RAW_POST

CORRUPT = "_corrupt_record"


def read_raw_posts(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Nested post JSON with the explicit schema. JSON-lines (default) splits across tasks;
    ``multiline=True`` reads whole-file JSON arrays (one task per file)."""
    return spark.read.schema(RAW_POST).option("multiLine", multiline).option("mode", "PERMISSIVE").json(path)


def read_raw_posts_checked(spark: SparkSession, path: str, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """I4: (good rows, quarantine). Malformed records land in the quarantine table with their text
    and source file instead of failing the job; the rest goes on.

    JSON lines are read as text and parsed in the plan, so files of any size
    split across tasks and either table is one scan with nothing kept between.
    """
    schema = StructType(RAW_POST.fields + [StructField(CORRUPT, StringType(), True)])
    if multiline:
        parsed = (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
                  .option("columnNameOfCorruptRecord", CORRUPT).json(path)
                  .select("*", F.col("_metadata.file_path").alias("_source_file")))
        # a scan of the corrupt column alone is refused: the record's id is read along
        broken = F.when(F.col("cid").isNull() | F.col("cid").isNotNull(), F.col(CORRUPT))
    else:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_source_file"))
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
        parsed = (lines.where(F.trim("value") != "").select(F.from_json("value", schema, options).alias("p"), "_source_file")
                  .select("p.*", "_source_file"))
        broken = F.col(CORRUPT)
    good = parsed.where(broken.isNull()).drop(CORRUPT, "_source_file")
    bad = parsed.where(broken.isNotNull()).select(broken.alias("record"), "_source_file")
    return good, bad
