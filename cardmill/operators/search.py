"""Case-insensitive regular expression search."""

from __future__ import annotations

from types import EllipsisType

from pyspark.sql import DataFrame, functions as F

from ..schema import FEED_CAP, PAGE_SIZE, SEARCH_CAP
from .feed import check_bounds, feed_slice, page_counts

Cap = int | EllipsisType | None


def search(entries: DataFrame, pattern: str) -> DataFrame:
    """Entries whose title or content matches; case is folded beyond ASCII, too.

    An empty pattern means no filter. The dialect is Java's.
    """
    if not pattern:
        return entries
    folded = f"(?iu){pattern}"
    return entries.filter(F.col("title").rlike(folded) | F.col("content").rlike(folded))


def search_page(entries: DataFrame, pattern: str, page: int = 1, cap: Cap = ...) -> DataFrame:
    """A page of the newest ``cap`` matches, of all with None.

    By default of the newest 100, or of the whole feed if the pattern is empty.
    """
    check_bounds(page=page)
    if cap is ...:
        cap = SEARCH_CAP if pattern else None
    start = (page - 1) * PAGE_SIZE
    limit = PAGE_SIZE if cap is None else max(0, min(PAGE_SIZE, cap - start))
    # The pattern would be tried twice to count the matches of each date.
    return feed_slice(search(entries, pattern), start, limit, by_date=not pattern)


def search_meta(entries: DataFrame, pattern: str, page: int = 1, cap: Cap = ...) -> DataFrame:
    """Page counts over the newest ``cap`` matches, over all with None.

    By default up to 100, or up to 1000 if the pattern is empty.
    """
    if cap is ...:
        cap = SEARCH_CAP if pattern else FEED_CAP
    return page_counts(search(entries, pattern), page, cap)
