"""Token counts as rollups that deltas maintain, with idempotent batch commits.

A batch of signed changes is summed by source, language and tokenizer version and
written to a folder of its own. A row in the table's log then publishes it: readers see the folders that the log names, so a
commit that breaks off leaves nothing to be seen, and a batch whose id is in the log is not committed
again. Totals are additive over batches. Compaction writes their sums anew and logs the same ids with the new folder. One
writer per table is assumed.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"
LOG_SCHEMA = "batch string, folder string, generation long"


def token_count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def changes(docs: DataFrame, version: str, old: Column | None, new: Column | None) -> DataFrame:
    """Signed changes ``(source, lang, version, n_docs, n_tokens)`` for documents.

    With ``new`` alone the documents are inserted, with ``old`` alone deleted, and
    with both their counts are revised. A null count is 0.
    """
    count = lambda value: F.lit(0) if value is None else F.coalesce(value, F.lit(0))
    n_docs = int(new is not None) - int(old is not None)
    return docs.select(
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.lit(version).alias("version"),
        F.lit(n_docs).cast("long").alias("n_docs"),
        (count(new) - count(old)).cast("long").alias("n_tokens"),
    )


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def _log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(f"{path}/log")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA)


def _published(spark: SparkSession, path: str) -> DataFrame:
    """``(batch, folder, generation)`` of each committed batch: where its sums are now."""
    newest = F.max_by("folder", "generation").alias("folder")
    return _log(spark, path).groupBy("batch").agg(newest, F.max("generation").alias("generation"))


def _sums(spark: SparkSession, path: str) -> DataFrame:
    folders = [row[0] for row in _published(spark, path).select("folder").distinct().collect()]
    if not folders:
        return spark.createDataFrame([], SCHEMA)
    return _summed(spark.read.schema(SCHEMA).parquet(*(f"{path}/sums/{folder}" for folder in folders)))


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The ids of the committed batches, also of those that were compacted."""
    return _published(spark, path).select("batch")


def commit(path: str, batch: str, deltas: DataFrame) -> None:
    """Commits the sums of a batch, unless there is one of that id. Sums are partial in each map task, so a hot source shuffles a row a task."""
    if not batch or "/" in batch or "=" in batch:
        raise ValueError(f"not a name for a batch: {batch!r}")
    spark = deltas.sparkSession
    if not committed(spark, path).filter(F.col("batch") == batch).isEmpty():
        return
    folder = str(uuid.uuid4())
    _summed(deltas).write.parquet(f"{path}/sums/{folder}")
    spark.createDataFrame([(batch, folder, 0)], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/log")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """``(source, lang, version, n_docs, n_tokens)`` over all committed batches; keys with no documents left are gone.

    Null sources and languages are keys of their own. A table without a batch has no totals.
    """
    return _sums(spark, path).filter("n_docs <> 0")


def compact(spark: SparkSession, path: str, target: str | None = None) -> None:
    """Writes the sums of all batches as one folder, to read fewer files; to ``target`` if that is given.

    The ids of the batches stay committed, in ``target`` too. What is replaced is no longer read and can be deleted.
    """
    log = _published(spark, path)
    folder, into = str(uuid.uuid4()), target or path
    _sums(spark, path).filter("n_docs <> 0 OR n_tokens <> 0").write.parquet(f"{into}/sums/{folder}")
    moved = log.select("batch", F.lit(folder).alias("folder"), (F.col("generation") + 1).alias("generation"))
    moved.coalesce(1).write.mode("append").parquet(f"{into}/log")
