"""The whole way of a refresh: pages in, feed page out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.extract import RuleSet, card_fields, page_cards, page_entries
from ..operators.feed import feed_page
from ..operators.ingest import ingest_new
from ..operators.newest import newest_dates
from ..schema import PAGE_SIZE


def refreshed_feed(
    pages: DataFrame,
    stored: DataFrame,
    rules: RuleSet,
    date_scraped: Column | str,
    created_at: Column | str,
    page: int = 1,
) -> DataFrame:
    """A feed page over the stored entries and the new ones of ``pages``.

    The page can only hold the newest stored rows, so only their dates are read
    for it. The check for known keys reads the key columns, and of one date
    alone if the run has one date.
    """
    incoming = page_entries(card_fields(page_cards(pages, rules), rules), date_scraped, created_at)
    known = stored.filter(F.col("date_scraped") == date_scraped) if isinstance(date_scraped, str) else stored
    new = ingest_new(incoming, known, order=("page_id", "pos"), by_date=False)
    return feed_page(newest_dates(stored, page * PAGE_SIZE).unionByName(new), page, by_date=False)
