"""The digest cache: Parquet, one row per ``title_hash``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators.digest import digest_cache_new
from ..schema import CACHE_SCHEMA


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cached digests; empty if nothing was written yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def append_completions(completions: DataFrame, path: str) -> None:
    """Insert if absent; a text that is there stays as it is."""
    cache = read_cache(completions.sparkSession, path)
    new = digest_cache_new(completions, cache).select(CACHE_SCHEMA.names)
    new.hint("rebalance").write.mode("append").parquet(path)
