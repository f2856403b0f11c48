"""When was each source last refreshed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def freshness(entries: DataFrame, run_date: str, by: str | None = "source") -> DataFrame:
    """The last date per source, or of the whole table, and whether a run is due.

    A run is due if none was made on ``run_date``. Dates are compared as dates,
    so the aggregate stays a hash aggregate on four bytes. What is no date is left
    out; ``undated`` lists such entries.
    """
    day = F.expr("try_cast(date_scraped AS date)")
    last = entries.groupBy(*([by] if by else [])).agg(F.max(day).alias("last"))
    due = F.col("last").isNull() | (F.col("last") < F.lit(run_date).cast("date"))
    return last.select(
        *([by] if by else []),
        F.date_format("last", "yyyy-MM-dd").alias("last_updated"),
        due.alias("due"),
    )


def undated(entries: DataFrame) -> DataFrame:
    """The entries whose ``date_scraped`` is missing or no date."""
    return entries.filter(F.expr("try_cast(date_scraped AS date) IS NULL"))
