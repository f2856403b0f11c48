"""The trigram index of an entry table: which dates have entries with a trigram in title or content.

The index lies in a folder of the table that other readers pass over, in parts by a hash of the trigram, so a
search opens a few of them. Appends to a table that has an index write there first: what breaks off
between the two leaves an index that says too much, never too little.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.trigrams import trigrams

PARTS = 64
SCHEMA = "trigram string, date_scraped string, part int"


def _folder(path: str) -> str:
    return f"{path}/_trigrams"


def _part(trigram: Column) -> Column:
    return (F.crc32(trigram) % PARTS).cast("int")


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """``(trigram, date_scraped, part)``, a row for each append at most; None if the table has no index."""
    try:
        return spark.read.schema(SCHEMA).parquet(_folder(path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_index(entries: DataFrame, path: str) -> None:
    """Adds the trigrams of some entries. Each is sent once a task and date, whatever the number of entries that have it."""
    held = F.array_union(trigrams(F.col("title")), trigrams(F.col("content")))
    rows = entries.select("date_scraped", F.explode(held).alias("trigram")).distinct()
    (
        rows.withColumn("part", _part(F.col("trigram")))
        .repartition("part")
        .sortWithinPartitions("part", "trigram")
        .write.mode("append")
        .partitionBy("part")
        .parquet(_folder(path))
    )


def dates_holding(spark: SparkSession, path: str, wanted: Sequence[str]) -> list[str | None] | None:
    """The dates whose entries have all the trigrams, though maybe not one entry all of them; None if the index cannot tell.

    None among the dates stands for entries without one.
    """
    index = read_index(spark, path) if wanted else None
    if index is None:
        return None
    parts = [row[0] for row in spark.range(1).select(F.explode(F.array(*(_part(F.lit(w)) for w in wanted)))).distinct().collect()]
    found = index.filter(F.col("part").isin(parts) & F.col("trigram").isin(list(wanted)))
    held = found.groupBy("date_scraped").agg(F.count_distinct("trigram").alias("n")).filter(F.col("n") == len(wanted))
    return [row[0] for row in held.select("date_scraped").collect()]
