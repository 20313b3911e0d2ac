"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from crisismap.session import checkpoint_dir

# Characters of text a Python worker holds at once; a single longer text is held alone.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's reader only (any store it can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of a table, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def with_text_columns(docs: DataFrame, fields: list[StructField],
                      make: Callable[[Iterator[list[str]]], Iterator[list[pa.Array]]]) -> DataFrame:
    """``docs`` with new columns made from the text alone, slice by slice, in one map.

    Columns called like the new ones are replaced; all others are kept, whatever
    their names (they travel under plain ones).
    """
    new = {f.name.lower() for f in fields}
    kept = [(name, column) for name, column in zip(docs.columns, own_columns(docs), strict=True) if name.lower() not in new]
    plain = docs.select(*[column for _, column in kept]).toDF(*[f"c{i}" for i in range(len(kept))])
    text = f"c{[name for name, _ in kept].index('text')}"
    names = [*plain.columns, *[f"new{i}" for i in range(len(fields))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(make(texts for _, texts in text_slices(batch, text)))
            if parts:
                made = [pa.concat_arrays(column) for column in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names)

    schema = StructType([*plain.schema.fields, *[StructField(f"new{i}", f.dataType) for i, f in enumerate(fields)]])
    return plain.mapInArrow(run, schema).toDF(*[name for name, _ in kept], *[f.name for f in fields])


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared checkpoint folder, seen by the driver and every executor."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor rereads files, it recomputes nothing)
    and, unlike ``checkpoint()``, lets later readers prune columns.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) slices of an Arrow batch of bounded size; NULL counts as empty."""
    texts = batch.column(column)
    start, size, out = 0, 0, []
    for row in range(batch.num_rows):
        text = texts[row].as_py() or ""
        if out and size + len(text) > limit:
            yield start, out
            start, size, out = row, 0, []
        out.append(text)
        size += len(text)
    if out:
        yield start, out
