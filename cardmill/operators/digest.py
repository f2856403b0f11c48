"""Keyed digests of the newest entries, and the cache of their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import CACHE_SCHEMA, DIGEST_SIZE
from .feed import check_bounds, feed_latest
from .newest import latest_per_group

# The prompt text, which must be the same to give the same completions.
PREAMBLE = "You are an amazing assistant that specializes in summarizing news articles. You are engaging, detailed, and capable of making mini stories with whatever information you have. When presenting, you use easy to understand language, occassional jokes, and always sound informed. However, you always, ALWAYS, only use the information you are given when giving your summaries. Ensure your summaries are no more than 10 sentences, and are easily digestible for older folks as well."
INSTRUCTION = "Summarize the following news articles in a few sentences:"
CLOSING = "Summary:"


def digests(entries: DataFrame, by: str | None = None, limit: int = DIGEST_SIZE, by_date: bool = True) -> DataFrame:
    """``(by, n_entries, title_hash, prompt)`` over the newest entries, in feed order.

    The hash covers titles alone, joined by a space: other content under equal
    titles gives the same digest. An empty feed has no digest. ``by_date`` is as in ``feed.feed_slice``.
    """
    check_bounds(limit=limit)
    latest = latest_per_group(entries, by, limit) if by else feed_latest(entries, limit, by_date)
    # Descending order of this struct is the feed order, missing values last.
    item = F.struct("date_scraped", "created_at", "id", "title", "content")
    keys = [by] if by else []
    collected = latest.groupBy(*keys).agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
    blocks = F.transform(
        "items", lambda e: F.concat(F.lit("Title: "), e["title"], F.lit("\n Content: "), e["content"])
    )
    prompt = F.concat_ws("\n\n", F.lit(PREAMBLE), F.lit(INSTRUCTION), F.array_join(blocks, "\n\n"), F.lit(CLOSING))
    return collected.filter(F.size("items") > 0).select(
        *keys,
        F.size("items").cast("long").alias("n_entries"),
        F.sha2(F.array_join(F.col("items.title"), " "), 256).alias("title_hash"),
        prompt.alias("prompt"),
    )


def digest_key(entries: DataFrame, limit: int = DIGEST_SIZE, by_date: bool = True) -> DataFrame:
    return digests(entries, limit=limit, by_date=by_date).select("title_hash")


def digest_prompt(entries: DataFrame, limit: int = DIGEST_SIZE, by_date: bool = True) -> DataFrame:
    return digests(entries, limit=limit, by_date=by_date).select("title_hash", "prompt")


def digest_by_source(entries: DataFrame, limit: int = DIGEST_SIZE) -> DataFrame:
    return digests(entries, by="source", limit=limit)


def digest_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """The requests with their cached text and ``status``: ``cached`` or ``to_generate``.

    Of several cached texts for one key the smallest is taken.
    """
    known = cache.groupBy("title_hash").agg(F.min("ai_summary").alias("ai_summary"))
    found = requests.join(known, "title_hash", "left")
    status = F.when(F.col("ai_summary").isNull(), "to_generate").otherwise("cached")
    return found.withColumn("status", status)


def digest_requests(entries: DataFrame, cache: DataFrame, limit: int = DIGEST_SIZE, by_date: bool = True) -> DataFrame:
    """One row ``(title_hash, prompt, ai_summary, status)``; ``empty`` if there are no entries."""
    looked_up = digest_lookup(digest_prompt(entries, limit, by_date), cache)
    # An aggregate gives a row for no rows, too.
    one = looked_up.agg(F.max(F.struct("title_hash", "prompt", "ai_summary", "status")).alias("one")).select("one.*")
    return one.withColumn("status", F.coalesce("status", F.lit("empty")))


def digest_cache_new(completions: DataFrame, cache: DataFrame) -> DataFrame:
    """The completions to append. Missing and empty texts are no completions.

    Of several texts for one key the smallest is taken, so that a second run
    takes the same.
    """
    usable = (
        completions.filter(F.col("ai_summary").isNotNull() & (F.col("ai_summary") != ""))
        .groupBy("title_hash")
        .agg(F.min("ai_summary").alias("ai_summary"))
    )
    return usable.join(cache.select("title_hash"), "title_hash", "left_anti")


def digest_cache_add(completions: DataFrame, cache: DataFrame) -> DataFrame:
    """The cache after the append; a row that is there stays as it is."""
    columns = CACHE_SCHEMA.names
    return cache.select(columns).unionByName(digest_cache_new(completions, cache).select(columns))
