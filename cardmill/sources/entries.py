"""The entry table: Parquet, one folder per ``date_scraped``."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import ENTRY_COLUMNS, ENTRY_SCHEMA
from .key_filter import read_filters, write_filters
from .trigrams import read_index, write_index

NO_DATE = "__HIVE_DEFAULT_PARTITION__"  # the folder that Spark gives rows without a date
DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


def read_entries(spark: SparkSession, path: str, dates: Iterable[str] | None = None) -> DataFrame:
    """The stored entries; empty if nothing was written yet.

    With ``dates`` only those folders are listed and scanned, so a small batch
    does not pay for the listing of the whole table; None among them stands for entries without a
    date. If one of them is not written as yyyy-MM-dd, all folders are listed. The schema is always
    given, else Spark would infer ``date_scraped`` as a date.
    """
    reader = spark.read.schema(ENTRY_SCHEMA).option("basePath", path)
    try:
        if dates is None:
            return reader.parquet(path).select(ENTRY_COLUMNS)
        dates = set(dates)
        if not dates:
            return spark.createDataFrame([], ENTRY_SCHEMA)
        days = sorted(d for d in dates if d is not None)
        wanted = F.col("date_scraped").isin(days)
        if None in dates:
            wanted = wanted | F.col("date_scraped").isNull()
        if not all(DATE.fullmatch(d) for d in days):
            return reader.parquet(path).filter(wanted).select(ENTRY_COLUMNS)
        folders = days + [NO_DATE] * (None in dates)
        stored = reader.parquet(f"{path}/date_scraped={{{','.join(folders)}}}")
        return stored.filter(wanted).select(ENTRY_COLUMNS)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY_SCHEMA)


def append_entries(entries: DataFrame, path: str) -> None:
    """Append to the table, and before that to its trigram index and its key filters, if it has them.

    The rebalance hint lets AQE split a date that holds much of the batch over
    several tasks and merge the small ones, so files are neither huge nor many.
    The Bloom filter serves point lookups, whose ids have no useful min/max.
    """
    if read_index(entries.sparkSession, path) is not None:
        write_index(entries, path)
    if read_filters(entries.sparkSession, path) is not None:
        write_filters(entries, path)
    (
        entries.select(ENTRY_COLUMNS)
        .hint("rebalance", F.col("date_scraped"))
        .write.mode("append")
        .partitionBy("date_scraped")
        .option("parquet.bloom.filter.enabled#id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .parquet(path)
    )


def index_entries(spark: SparkSession, path: str) -> None:
    """Give the table a trigram index, of what is stored now and, from here on, of every append."""
    if read_index(spark, path) is None:
        write_index(read_entries(spark, path), path)


def filter_keys(spark: SparkSession, path: str) -> None:
    """Give the table filters of its keys, of what is stored now and, from here on, of every append."""
    if read_filters(spark, path) is None:
        write_filters(read_entries(spark, path), path)


def write_json(records: DataFrame, path: str) -> None:
    """Write the one-column output of ``entry_json``, one record a line."""
    records.select("json").write.mode("errorifexists").text(path)
