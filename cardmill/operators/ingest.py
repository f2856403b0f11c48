"""Insert if absent on the entry key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import ENTRY_COLUMNS, ENTRY_KEY


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with their key in one column, in which a missing part equals a missing one."""
    return rows.withColumn("_key", F.struct(*ENTRY_KEY))


def _first_of_keys(keyed: DataFrame, order: Sequence[str]) -> DataFrame:
    window = Window.partitionBy("_key").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return keyed.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") == 1).drop("_n")


def dedup_batch(entries: DataFrame, order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """One row per key, the first by ``order``.

    The filter on row number 1 makes Spark keep one row per key in each map
    task before the shuffle, so a key that holds much of the batch sends at
    most one row per task.
    """
    return _first_of_keys(_keyed(entries), order).drop("_key")


def absent_entries(incoming: DataFrame, stored: DataFrame, order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """The first row of each key of ``incoming`` that is not stored.

    The stored keys are reduced to one row each before the join, so no key is
    hot on either side; the join reuses the partitioning of both reductions.
    ``stored`` may be limited to the dates of ``incoming``, which are in the key.
    """
    known = _keyed(stored.select(ENTRY_KEY)).select("_key").distinct()
    fresh = _first_of_keys(_keyed(incoming), order)
    return fresh.join(known, "_key", "left_anti").select(ENTRY_COLUMNS)


def absent_after_filter(
    incoming: DataFrame, maybe: DataFrame, stored: DataFrame, order: Sequence[str] = ("created_at", "id")
) -> DataFrame:
    """As ``absent_entries``, where ``maybe`` has the keys of ``incoming`` that may be stored. Only these are looked for.

    The stored keys of other dates are not read. ``incoming`` and ``maybe`` are read twice.
    """
    known = _keyed(within_dates(stored, maybe).select(ENTRY_KEY)).select("_key")
    found = _keyed(maybe).select("_key").join(known, "_key", "left_semi")
    return _first_of_keys(_keyed(incoming), order).join(found, "_key", "left_anti").select(ENTRY_COLUMNS)


def within_dates(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The stored entries of the dates of ``incoming``, and those without a date.

    The list of dates is a scalar subquery over the date column alone, so
    the partitions of other dates are pruned when the query runs.
    """
    dates = incoming.agg(F.collect_set("date_scraped")).scalar()
    return stored.filter(F.array_contains(dates, F.col("date_scraped")) | F.col("date_scraped").isNull())


def ingest_new(
    incoming: DataFrame, stored: DataFrame, order: Sequence[str] = ("created_at", "id"), by_date: bool = True
) -> DataFrame:
    """The incoming entries to append: one per key, keys already stored left out.

    Reads the dates of ``incoming`` first, to prune ``stored``; say
    ``by_date=False`` where these are known or costly to get.
    """
    known = within_dates(stored, incoming) if by_date else stored
    return absent_entries(incoming, known, order)


def ingest_merged(
    incoming: DataFrame, stored: DataFrame, order: Sequence[str] = ("created_at", "id"), by_date: bool = True
) -> DataFrame:
    """The table after the append."""
    return stored.select(ENTRY_COLUMNS).unionByName(ingest_new(incoming, stored, order, by_date))
