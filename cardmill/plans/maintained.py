"""Answers that appends carry forward, so that they cost what was appended and not what is stored.

``latest`` holds the newest entries of each source, ``counts`` the number of entries of each date and of
all newer ones. Both are merged with each batch of new entries under the batch's id, and a batch that comes again changes nothing.
Entries may come late, in any order.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.digest import digest_by_source
from ..operators.feed import check_bounds, page_of, page_totals
from ..operators.newest import feed_rank, latest_per_group
from ..schema import DIGEST_SIZE, ENTRY_COLUMNS, ENTRY_SCHEMA, FEED_CAP
from ..sources.entries import read_entries
from ..sources.generations import advance, current

COUNTS = "date_scraped string, n long, before long"


def add_to_latest(entries: DataFrame, path: str, batch: str, limit: int = DIGEST_SIZE) -> bool:
    """Merge new entries into the newest ``limit`` of each source. What is not among these of old and new can never be again."""

    def merge(held: DataFrame) -> DataFrame:
        return latest_per_group(held.unionByName(entries.select(ENTRY_COLUMNS)), "source", limit)

    return advance(entries.sparkSession, path, batch, ENTRY_SCHEMA, merge)


def maintained_digests(spark: SparkSession, path: str, limit: int = DIGEST_SIZE) -> DataFrame:
    """``digest_by_source`` of all entries added so far, for a ``limit`` that is not above that of the state."""
    return digest_by_source(current(spark, path, ENTRY_SCHEMA), limit)


def add_to_counts(entries: DataFrame, path: str, batch: str) -> bool:
    """Merge the number of new entries of each date. The table has a row a date; the sums over newer dates are made anew."""

    def merge(held: DataFrame) -> DataFrame:
        new = entries.groupBy("date_scraped").agg(F.count(F.lit(1)).alias("n"))
        summed = held.select("date_scraped", "n").unionByName(new).groupBy("date_scraped").agg(F.sum("n").alias("n"))
        newer = Window.orderBy(F.col("date_scraped").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
        return summed.select("date_scraped", "n", F.coalesce(F.sum("n").over(newer), F.lit(0)).alias("before"))

    return advance(entries.sparkSession, path, batch, COUNTS, merge)


def maintained_page_meta(spark: SparkSession, path: str, page: int = 1, cap: int | None = FEED_CAP) -> DataFrame:
    """``page_meta`` of all entries added so far, from a row a date."""
    check_bounds(page=page)
    counts = current(spark, path, COUNTS)
    return page_totals(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")), page, cap)


def maintained_page_index(spark: SparkSession, table: str, counts: str, dates: Iterable[str | None]) -> DataFrame:
    """``feed_page_index`` for the entries of some dates of a stored table. Only their folders are read.

    The entries are ranked among these dates; what lies between two of them is known from the counts.
    """
    dates = list(dates)
    ranked = feed_rank(read_entries(spark, table, dates))
    wanted = F.col("date_scraped").isin([d for d in dates if d is not None])
    if None in dates:
        wanted = wanted | F.col("date_scraped").isNull()
    known = current(spark, counts, COUNTS).filter(F.coalesce(wanted, F.lit(None in dates)))
    newer = Window.orderBy(F.col("date_scraped").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    among = F.coalesce(F.sum("n").over(newer), F.lit(0))
    skipped = known.select(F.col("date_scraped").alias("_date"), (F.col("before") - among).alias("_skipped"))
    placed = ranked.join(F.broadcast(skipped), F.col("date_scraped").eqNullSafe(F.col("_date")))
    rank = (F.col("feed_rank") + F.col("_skipped")).alias("feed_rank")
    return placed.select("id", "date_scraped", rank).withColumn("page", page_of("feed_rank"))
