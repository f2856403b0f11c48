"""The newest-first feed: slices, counts, lookups, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keys
from ..schema import API_LIMIT, DIGEST_SIZE, ENTRY_COLUMNS, FEED_CAP, PAGE_SIZE, feed_order
from . import newest


def check_bounds(**values: int) -> None:
    for name, value in values.items():
        least = 1 if name == "page" else 0
        if value < least:
            raise ValueError(f"{name} must be at least {least}, got {value}")


def entry_projection(documents: DataFrame) -> DataFrame:
    """Stored documents as entries: ``_id`` becomes ``id``, as a string."""
    return documents.withColumn("id", F.col("_id").cast("string")).select(ENTRY_COLUMNS)


def entry_payload(entries: DataFrame) -> DataFrame:
    """Entries without ``id``, for a store that assigns its own."""
    return entries.select(ENTRY_COLUMNS).drop("id")


def entry_by_id(entries: DataFrame, entry_id: str) -> DataFrame:
    return entries.filter(F.col("id") == entry_id)


def entries_by_ids(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """The entries whose ``id`` is listed. An id asked for many times is asked for once."""
    return entries.join(ids.select("id").distinct(), "id", "left_semi").select(ENTRY_COLUMNS)


def feed_slice(
    entries: DataFrame, start: int = 0, limit: int | None = API_LIMIT, by_date: bool = True
) -> DataFrame:
    """Rows ``start`` to ``start + limit`` of the feed; without ``limit`` the whole feed in order.

    Looks at the newest dates only, as many as it needs, and ranks their order values alone, whatever the
    depth; the rows of the slice are found by these. That reads ``entries`` a few times. Say
    ``by_date=False`` where rows are costly to find, or do not lie by date and the slice is near the top: they are then read once, and as many as the
    slice reaches down go through the ranking of each task with all columns.
    """
    if limit is None:
        check_bounds(start=start)
        return entries.orderBy(*feed_order()).offset(start)
    check_bounds(start=start, limit=limit)
    if not by_date:
        return newest.newest_in_one_pass(entries, start, limit)
    return newest.newest(newest.newest_dates(entries, start + limit), start, limit)


def feed_page(entries: DataFrame, page: int = 1, by_date: bool = True) -> DataFrame:
    check_bounds(page=page)
    return feed_slice(entries, (page - 1) * PAGE_SIZE, PAGE_SIZE, by_date)


def feed_all(entries: DataFrame, cap: int | None = FEED_CAP, by_date: bool = True) -> DataFrame:
    return feed_slice(entries, 0, cap, by_date)


def feed_latest(entries: DataFrame, limit: int = DIGEST_SIZE, by_date: bool = True) -> DataFrame:
    return feed_slice(entries, 0, limit, by_date)


def page_counts(rows: DataFrame, page: int, cap: int | None) -> DataFrame:
    """``total``, ``pages`` and the neighbours of ``page``, for any set of rows.

    The count is exact and then capped, which gives what counting the capped
    rows would give, without bringing these rows together.
    """
    check_bounds(page=page)
    return page_totals(rows.agg(F.count(F.lit(1)).alias("total")), page, cap)


def page_totals(counted: DataFrame, page: int, cap: int | None) -> DataFrame:
    """The same for a row with the ``total``."""
    total = F.col("total") if cap is None else F.least(F.col("total"), F.lit(cap))
    return (
        counted.select(F.lit(page).cast("long").alias("page"), total.cast("long").alias("total"))
        .withColumn("pages", F.expr(f"(total + {PAGE_SIZE - 1}) div {PAGE_SIZE}"))
        .withColumn("has_next", F.col("page") < F.col("pages"))
        .withColumn("has_prev", F.col("page") > 1)
    )


def page_meta(entries: DataFrame, page: int = 1, cap: int | None = FEED_CAP) -> DataFrame:
    return page_counts(entries, page, cap)


def entry_record() -> Column:
    """An entry as a JSON record."""
    fields = [keys.iso_timestamp(F.col(c)).alias(c) if c == "created_at" else F.col(c) for c in ENTRY_COLUMNS]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def entry_json(entries: DataFrame, start: int = 0, limit: int = API_LIMIT, by_date: bool = True) -> DataFrame:
    """A slice of the feed as ``(id, json)``."""
    return feed_slice(entries, start, limit, by_date).select("id", entry_record().alias("json"))


def feed_page_index(entries: DataFrame) -> DataFrame:
    """The rank and the page number of every entry."""
    return newest.feed_rank(entries).withColumn("page", page_of("feed_rank"))


def page_of(rank: str) -> Column:
    """The page on which the entry of a rank is."""
    return F.expr(f"({rank} - 1) div {PAGE_SIZE} + 1")
