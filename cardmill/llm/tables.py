"""Helpers that the operators share: intermediate tables and free column names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder

# Keys of 8 bytes are broadcast up to this many, 8 MB; beyond that both sides are shuffled.
BROADCAST_KEYS = 1_000_000

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# A word between ASCII white space, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"
    writer = df.write
    if by:
        writer = writer.partitionBy(by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def semi_join(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is in ``keys``, a stored table; broadcasts keys that were counted and are few."""
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return rows.join(keys, key, "left_semi")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
