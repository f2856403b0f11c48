"""Derived ids, hashes and record formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def entry_id(title: Column, source: Column, date_scraped: Column) -> Column:
    """A 24 digit id that is the same for the same key on every run."""
    return F.substring(F.sha2(F.concat_ws("\x1f", title, source, date_scraped), 256), 1, 24)


def iso_timestamp(ts: Column) -> Column:
    """``2024-01-31T05:00:00``, followed by six digits if there is a fraction."""
    text = F.replace(ts.cast("string"), F.lit(" "), F.lit("T"))
    return F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)


def as_date_string(value: Column | str) -> Column:
    """A run date as ``yyyy-MM-dd``, from a date column or a literal."""
    column = F.lit(value) if isinstance(value, str) else value
    return F.date_format(column.cast("date"), "yyyy-MM-dd")
