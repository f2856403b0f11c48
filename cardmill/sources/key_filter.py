"""Bloom filters of the stored entry keys, one for each append and date.

A filter is a number of blocks of ``BLOCK_BITS`` bits. A key has one block, by its hash, and some
bits in it, so looking for a key reads one row for each append of its date. The filters lie in a folder of the table
that other readers pass over. An append writes its filter first: what breaks off between the two makes
keys look stored that are not, which the join with the table then settles, and never the other way round.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import ENTRY_KEY

BLOCK_BITS = 1 << 15  # what Spark's bitmaps hold
KEY_BITS = 12  # for each key, for about one false answer in a hundred
PROBES = 4
SCHEMA = "day string, n_blocks int, block int, bits binary"


def _folder(path: str) -> str:
    return f"{path}/_keys"


def read_filters(spark: SparkSession, path: str) -> DataFrame | None:
    """``(day, n_blocks, block, bits)``; None if the table has no filters."""
    try:
        return spark.read.schema(SCHEMA).parquet(_folder(path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _hashed(rows: DataFrame) -> DataFrame:
    """``(day, h)`` next to the rows. A missing part of a key has a mark of its own."""
    parts = [F.struct(F.col(c).isNull(), F.coalesce(c, F.lit(""))) for c in ENTRY_KEY]
    return rows.withColumns({"day": F.coalesce("date_scraped", F.lit("")), "h": F.xxhash64(*parts)})


def _positions() -> list[Column]:
    return [F.pmod(F.xxhash64("h", F.lit(i)), F.lit(BLOCK_BITS)) for i in range(PROBES)]


def write_filters(entries: DataFrame, path: str) -> None:
    """Adds the keys of some entries. Counting and setting bits is partial in each task, so no date is hot."""
    keys = _hashed(entries.select(ENTRY_KEY)).select("day", "h")
    blocks = F.ceil(F.count(F.lit(1)) * KEY_BITS / BLOCK_BITS).cast("int").alias("n_blocks")
    sized = keys.join(keys.groupBy("day").agg(blocks), "day")
    bits = sized.select(
        "day", "n_blocks", F.pmod("h", F.col("n_blocks")).cast("int").alias("block"), F.explode(F.array(*_positions())).alias("at")
    )
    filters = bits.groupBy("day", "n_blocks", "block").agg(F.bitmap_construct_agg("at").alias("bits"))
    filters.write.mode("append").parquet(_folder(path))


def _bit(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def maybe_stored(entries: DataFrame, filters: DataFrame) -> DataFrame:
    """The keys of ``entries`` that may be stored: all that are, and few that are not. ``entries`` has a key once at most."""
    hashed = _hashed(entries.select(ENTRY_KEY))
    sizes = filters.select("day", "n_blocks").distinct()
    probes = hashed.join(sizes, "day").withColumn("block", F.pmod("h", F.col("n_blocks")).cast("int"))
    held = F.lit(True)
    for at in _positions():
        held = held & _bit(F.col("bits"), at)
    return probes.join(filters, ["day", "n_blocks", "block"]).filter(held).select(ENTRY_KEY).distinct()
