"""Stored pages, as a table or as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import PAGE_SCHEMA


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


# What one micro-batch takes from a backlog, so that the first run is many batches.
BATCH_BYTES = 1 << 36


def stream_pages(
    spark: SparkSession, path: str, max_files: int | None = None, max_bytes: int = BATCH_BYTES
) -> DataFrame:
    """New page files as they appear. ``path`` is a folder or a pattern.

    A micro-batch is bounded by the size of its files, or by their number if
    ``max_files`` is given.
    """
    name, value = ("maxFilesPerTrigger", max_files) if max_files else ("maxBytesPerTrigger", max_bytes)
    return spark.readStream.schema(PAGE_SCHEMA).option(name, value).parquet(path)
