"""Feed and search over the stored table, reading its newest folders only.

One page needs few rows, and a table of many years has many files. These plans
go by the calendar: they look into the folder of one date, then of the two
before it, then of four, until what they found suffices. Older folders are
neither listed nor opened. A search goes by the dates that the trigram index names, if the table has one. ``until`` is a date that no stored entry is later
than, such as the date of the last run; entries of later dates, if there are any, are left out of every answer.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.trigrams import required_trigrams
from ..operators.feed import check_bounds, feed_page, page_meta
from ..operators.search import search, search_meta, search_page
from ..schema import FEED_CAP, PAGE_SIZE, SEARCH_CAP
from ..sources.entries import read_entries
from ..sources.trigrams import dates_holding

# Six steps: 1, 2, 4, 8, 16 and 32 days.
WALK_DAYS = 63


def newest_folders(
    spark: SparkSession, path: str, until: str, rows: int, keep: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The entries of the newest dates that hold at least ``rows`` rows, or that many ``keep`` keeps.

    Each step counts in a window of its own, so no date is counted twice. If
    ``WALK_DAYS`` do not suffice this gives the whole table up to ``until``: what is so rare or
    so old is better looked for once, everywhere.
    """
    last = date.fromisoformat(until)
    dates: list[str] = []
    found = 0
    while len(dates) < WALK_DAYS:
        window = [(last - timedelta(days)).isoformat() for days in range(len(dates), 2 * len(dates) + 1)]
        entries = read_entries(spark, path, window)
        found += (keep(entries) if keep else entries).count()
        dates += window
        if found >= rows:
            return read_entries(spark, path, dates)
    return read_entries(spark, path).filter(F.col("date_scraped") <= until)


def stored_feed_page(spark: SparkSession, path: str, until: str, page: int = 1) -> DataFrame:
    check_bounds(page=page)
    return feed_page(newest_folders(spark, path, until, page * PAGE_SIZE), page)


def stored_page_meta(spark: SparkSession, path: str, until: str, page: int = 1) -> DataFrame:
    """Page counts, which end at the cap and so need the newest rows up to it."""
    check_bounds(page=page)
    return page_meta(newest_folders(spark, path, until, FEED_CAP), page)


def stored_search(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """All matches. With an index only the folders are read that have what a match must hold."""
    return search(read_entries(spark, path, dates_holding(spark, path, required_trigrams(pattern))), pattern)


def _matching_folders(spark: SparkSession, path: str, until: str, pattern: str, rows: int) -> DataFrame:
    """Folders with at least ``rows`` matches: the newest ones, or of those that the index names."""
    named = dates_holding(spark, path, required_trigrams(pattern))
    if named is None:
        return newest_folders(spark, path, until, rows, keep=lambda entries: search(entries, pattern))
    dates = sorted((d for d in named if d is not None and d <= until), reverse=True)
    found, seen = 0, 0
    while seen < len(dates):
        window = dates[seen : 2 * seen + 1] if seen < WALK_DAYS else dates[seen:]
        seen += len(window)
        if seen < len(dates):
            found += search(read_entries(spark, path, window), pattern).count()
            if found >= rows:
                break
    return read_entries(spark, path, dates[:seen])


def stored_search_page(spark: SparkSession, path: str, until: str, pattern: str, page: int = 1) -> DataFrame:
    """A page of the newest matches. A frequent word is found in the newest folders; a rare one takes all."""
    check_bounds(page=page)
    if not pattern:
        return stored_feed_page(spark, path, until, page)
    rows = min(page * PAGE_SIZE, SEARCH_CAP)
    return search_page(_matching_folders(spark, path, until, pattern, rows), pattern, page)


def stored_search_meta(spark: SparkSession, path: str, until: str, pattern: str, page: int = 1) -> DataFrame:
    """Page counts over the newest matches, which end at the cap."""
    check_bounds(page=page)
    if not pattern:
        return stored_page_meta(spark, path, until, page)
    return search_meta(_matching_folders(spark, path, until, pattern, SEARCH_CAP), pattern, page)
