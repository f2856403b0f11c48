"""A small table that batches carry forward: each writes it anew and publishes that with one row of a log.

Readers see the newest published generation. A batch that breaks off leaves none, and one whose id is in the log changes nothing, so
replays do no harm. One writer is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

LOG_SCHEMA = "batch string, folder string, generation long"


def _log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(f"{path}/log")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA)


def current(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest generation; empty if there is none."""
    newest = _log(spark, path).agg(F.max_by("folder", "generation")).first()[0]
    if newest is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{newest}")


def advance(spark: SparkSession, path: str, batch: str, schema, step: Callable[[DataFrame], DataFrame]) -> bool:
    """Writes what ``step`` makes of the newest generation as the next one, unless ``batch`` was taken before."""
    taken = F.max((F.col("batch") == batch).cast("int"))
    last, known = _log(spark, path).agg(F.max("generation"), taken).first()
    if known:
        return False
    folder = f"generation-{uuid.uuid4()}"
    step(current(spark, path, schema)).write.parquet(f"{path}/{folder}")
    row = spark.createDataFrame([(batch, folder, 0 if last is None else last + 1)], LOG_SCHEMA)
    row.coalesce(1).write.mode("append").parquet(f"{path}/log")
    return True
