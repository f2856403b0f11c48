"""Table schemas, keys and the feed order shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("link", T.StringType(), False),
        T.StructField("date_scraped", T.StringType(), False),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

CACHE_SCHEMA = T.StructType(
    [
        T.StructField("title_hash", T.StringType()),
        T.StructField("ai_summary", T.StringType()),
    ]
)

ENTRY_COLUMNS = ENTRY_SCHEMA.names

# Two entries with equal keys are the same story seen on the same day.
ENTRY_KEY = ["title", "source", "date_scraped"]

# The workload parameters every caller of the feed relies on.
PAGE_SIZE = 30
API_LIMIT = 50
FEED_CAP = 1000
SEARCH_CAP = 100
DIGEST_SIZE = 10


def feed_order() -> list[Column]:
    """Newest first, total: ``id`` breaks every tie."""
    return [
        F.col("date_scraped").desc_nulls_last(),
        F.col("created_at").desc_nulls_last(),
        F.col("id").desc_nulls_last(),
    ]
