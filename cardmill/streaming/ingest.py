"""Repeated runs as one incremental job.

Every micro-batch is reduced to one row per key and joined against the stored
entries of its dates. The table itself is the state, so nothing grows, late
rows are still taken, and a batch that is applied twice adds nothing the second
time. One writer is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.keys import as_date_string
from ..operators.extract import RuleSet, card_fields, dated, page_cards, page_entries, rejected_cards
from ..operators.ingest import absent_after_filter, absent_entries, dedup_batch
from ..operators.newest import distinct_dates
from ..schema import ENTRY_COLUMNS, ENTRY_KEY, ENTRY_SCHEMA
from ..session import shared_folder
from ..sources.entries import append_entries, read_entries
from ..sources.key_filter import maybe_stored, read_filters


def not_stored(batch: DataFrame, target: str, filters: DataFrame) -> DataFrame:
    """The entries of a batch, one for each key, that the table at ``target`` does not hold."""
    spark = batch.sparkSession
    path = f"{shared_folder(spark)}/maybe-{uuid.uuid4()}"
    maybe_stored(batch, filters).write.parquet(path)
    maybe = spark.read.schema(batch.select(ENTRY_KEY).schema).parquet(path)
    if maybe.isEmpty():
        return batch
    return absent_after_filter(batch, maybe, read_entries(spark, target, distinct_dates(maybe)))


def append_absent(
    entries: DataFrame,
    target: str,
    order: Sequence[str] = ("created_at", "id"),
    dated_rows: DataFrame | None = None,
) -> None:
    """Append to the table at ``target`` the entries it does not hold.

    Their dates are read first, from ``dated_rows`` if these have them at less
    cost than ``entries``; more dates than those of the entries do no harm. A table with filters of its keys is asked for
    the keys that may be stored only, and not at all if there are none.
    """
    spark = entries.sparkSession
    filters = read_filters(spark, target)
    if filters is not None:
        # Written once, for filters, join and append all read the batch.
        path = f"{shared_folder(spark)}/batch-{uuid.uuid4()}"
        dedup_batch(entries, order).select(ENTRY_COLUMNS).write.parquet(path)
        batch = spark.read.schema(ENTRY_SCHEMA).parquet(path)
        append_entries(not_stored(batch, target, filters), target)
        return
    dates = distinct_dates(entries if dated_rows is None else dated_rows)
    stored = read_entries(spark, target, dates)
    append_entries(absent_entries(entries, stored, order), target)


def run_batches(rows: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Give ``apply`` what is new in the source of ``rows``, in micro-batches, and stop."""
    return (
        rows.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_entries(
    entries: DataFrame, target: str, checkpoint: str, order: Sequence[str] = ("created_at", "id")
) -> StreamingQuery:
    """Append what is new in a stream of entries."""
    return run_batches(entries, lambda batch, _: append_absent(batch, target, order), checkpoint)


def _query_id(batch: DataFrame) -> str:
    """The id that a stream keeps as long as its checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "unknown"


def ingest_pages(
    pages: DataFrame,
    rules: RuleSet,
    date_scraped: Column | str,
    created_at: Column | str,
    target: str,
    checkpoint: str,
    rejects: str | None = None,
) -> StreamingQuery:
    """Append the new entries of a stream of pages: extract, reduce, join, append.

    With ``rejects`` the rejected cards of each micro-batch are written to a
    folder of its own, named by stream and batch, which a replay overwrites.
    They are extracted a second time for that, rather than kept with their text.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        fields = dated(card_fields(page_cards(batch, rules), rules), date_scraped)
        if rejects:
            folder = f"{rejects}/stream={_query_id(batch)}/batch={batch_id}"
            rejected_cards(fields).write.mode("overwrite").parquet(folder)
        days = batch.select(as_date_string(date_scraped).alias("date_scraped"))
        days = days.filter(F.col("date_scraped").isNotNull())
        append_absent(page_entries(fields, date_scraped, created_at), target, ("page_id", "pos"), days)

    return run_batches(pages, apply, checkpoint)
