"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from palimpsest.plans.storage import cleaned as cleaned
from palimpsest.plans.storage import shared_dir

#: Characters that separate words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut and the copy outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_of(columns: list[str]) -> Column:
    """Some columns as one struct, so that none can clash with a working name; no columns give a struct of one constant."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(0).alias("_"))


def with_row(work: DataFrame, rest: str) -> StructType:
    """The schema of work's struct named row and of some more columns, given as DDL; DDL couldn't name every field of the row."""
    return StructType([StructField("row", work.schema["row"].dataType), *StructType.fromDDL(rest).fields])


#: Rows of a batch that an operator turns into Python objects at a time; a bound of memory, not of results.
SLICE = 512


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in pieces, which share the batches' memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def fresh(columns: list[str], name: str) -> str:
    """A name that no column has."""
    while name in columns:
        name += "_"
    return name


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data directory, whatever store it is in."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession, times: int = 1) -> int:
    """A partition count in proportion to what the session is configured for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * times)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames with equal columns."""
    return reduce(DataFrame.unionByName, frames)
