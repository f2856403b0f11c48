"""The test tables in the shape of the engine's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import ENTRY_COLUMNS

FIRST_DAY = "2024-01-01"
DAYS = 30


def _days(number: Column) -> Column:
    return (number % DAYS).cast("int")


def scraped_on(number: Column) -> Column:
    """A day in January 2024 that follows from the row's number."""
    return F.date_add(F.lit(FIRST_DAY).cast("date"), _days(number))


def scraped_at(number: Column) -> Column:
    """A time of day on ``scraped_on`` that follows from the row's number."""
    seconds = number * 7919 % 86400
    start = F.lit(f"{FIRST_DAY} 00:00:00").cast("timestamp_ntz")
    return start + F.make_dt_interval(_days(number), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def documents_as_entries(documents: DataFrame) -> DataFrame:
    """A document as an entry: its first line is the title, the rest the content."""
    text = F.col("text")
    title = F.substring_index(text, "\n", 1)
    content = F.substring(text, F.length(title) + 2, F.length(text))
    number = F.col("doc_id")
    return documents.select(
        F.lpad(number.cast("string"), 24, "0").alias("id"),
        title.alias("title"),
        content.alias("content"),
        F.col("source"),
        F.concat(F.lit("https://example.org/doc/"), number.cast("string")).alias("link"),
        F.date_format(scraped_on(number), "yyyy-MM-dd").alias("date_scraped"),
        scraped_at(number).alias("created_at"),
    ).select(ENTRY_COLUMNS)
