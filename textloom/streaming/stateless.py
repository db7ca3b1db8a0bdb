"""The operators over streams. They look at one row at a time, so the batch functions serve as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def over_stream(spark: SparkSession, path: str, schema, operator: Callable[[DataFrame], DataFrame], files_per_batch: int = 8) -> DataFrame:
    """``operator`` over the Parquet files that arrive under ``path``."""
    return operator(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))
