"""Parquet / delimited table scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def read_table(spark: SparkSession, base: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Lazy Parquet scan of ``{base}/{name}.parquet``; ``columns`` prunes the read schema."""
    df = spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Parquet sink (S2); ``partition_by`` gives directory partitions that later scans prune."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def _json_nested(df: DataFrame) -> DataFrame:
    """CSV holds no arrays or structs: serialise them to JSON text (the reference lost them)."""
    cols = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (ArrayType, MapType, StructType)):
            cols.append(F.to_json(F.col(field.name)).alias(field.name))
        else:
            cols.append(F.col(field.name))
    return df.select(*cols)


def write_delimited(df: DataFrame, path: str, sep: str = "\t", mode: str = "overwrite") -> None:
    """CSV / TSV sink with a header (S3). Nested columns are written as JSON text."""
    _json_nested(df).write.mode(mode).option("sep", sep).option("header", True).csv(path)


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = "\t") -> DataFrame:
    """CSV / TSV scan with an explicit schema (no inference pass over the data)."""
    return spark.read.schema(schema).option("sep", sep).option("header", True).csv(path)


def write_embeddings(df: DataFrame, path: str, key: str = "doc_id", column: str = "embedding") -> None:
    """Persist (reduced) embeddings keyed by document id."""
    df.select(key, F.col(column).cast("array<float>").alias(column)).write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_cell_counts(df: DataFrame, path: str, keys: tuple[str, ...] = ("region", "level", "subset")) -> None:
    """Fan-out sink (S7): one directory per region x level (x week) x subset instead of one file each."""
    write_table(df, path, partition_by=[k for k in keys if k in df.columns])


def read_cell_counts(spark: SparkSession, path: str) -> DataFrame:
    """Partition-discovery scan (S8): directory keys come back as columns, filters on them prune."""
    return spark.read.option("basePath", path).parquet(path)
