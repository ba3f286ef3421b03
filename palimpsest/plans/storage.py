"""Written intermediate results."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where it is unset and all runs on this machine (tests)."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
    return sc.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: what is used several times is made once, and outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _set(spark: SparkSession, name: str, value: str, default: str) -> Iterator[None]:
    before = spark.conf.get(name, default)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cleaned(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Shuffle files of a query that ends in here go with it, not when the driver happens to collect its garbage."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true", "false")


def together(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Joins of a query that ends in here take rows dealt by some of their keys as they lie."""
    return _set(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false", "true")
