"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import html, links
from ..operators import digest, extract, feed, freshness, ingest, search
from ..schema import CACHE_SCHEMA, ENTRY_COLUMNS
from ..session import shared_folder
from ..sources.cache import append_completions, read_cache
from ..sources.corpus import documents_as_entries, scraped_at, scraped_on
from ..sources.entries import append_entries, index_entries, read_entries
from ..sources.pages import read_pages, stream_pages
from ..streaming.ingest import ingest_pages
from . import maintained, stored

# Query parameters; the SQL in ``oracle`` uses the same.
ENTRY_ID = "000000000000000000000042"
SECOND_RUN_HOUR = 16
CACHED_UNTIL = "2024-01-26"
RUN_DATE = "2024-01-30"
WORD = "ÉLE"
RARE_WORD = "erhawhly"
OPENING = "^the"
FEED_PAGE = 2
SEARCH_PAGE = 2
DEEP_PAGE = 34  # past row 1000 where there are as many
STORED_UNTIL = "2024-01-27"
INDEXED_DATES = ("2024-01-09", "2024-01-20")
FAULTS = 8
API_START = 50
EMPTY_COMPLETION = "src5"
MISSING_COMPLETION = "src7"

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.schema("doc_id bigint, text string, lang string, source string, n_chars bigint").parquet(
        f"{sf}/documents.parquet"
    )


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return documents_as_entries(documents(spark, sf))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_pages(spark, f"{sf}/pages.parquet")


def after_first_run(table: DataFrame) -> DataFrame:
    """What is stored when the second run of a day starts."""
    return table.filter(F.hour("created_at") < SECOND_RUN_HOUR)


def extracted(spark: SparkSession, sf: str) -> DataFrame:
    rules = extract.ARTICLE_PAGE
    fields = extract.card_fields(extract.page_cards(pages(spark, sf), rules), rules)
    number = F.col("page_id")
    return extract.page_entries(fields, scraped_on(number), scraped_at(number))


def entry_projection(spark: SparkSession, sf: str) -> DataFrame:
    stored = entries(spark, sf).withColumn("_id", F.col("id").cast("bigint")).drop("id")
    return feed.entry_projection(stored)


def entries_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    ids = labels.select(F.lpad(F.col("doc_id").cast("string"), 24, "0").alias("id"))
    return feed.entries_by_ids(entries(spark, sf), ids)


def card_link(spark: SparkSession, sf: str) -> DataFrame:
    """The redirect rule on every link of the pages."""
    found = extract.page_links(pages(spark, sf))
    return found.withColumn("link", links.redirect_target(F.col("href")))


def extract_stats(spark: SparkSession, sf: str) -> DataFrame:
    """What the redirect rule says of the links of each host's pages."""
    cards = extract.page_cards(pages(spark, sf), extract.PAGE_LINKS)
    status = extract.link_status(html.attribute(F.col("card"), "href"))
    return extract.extract_stats(cards.select(links.host(F.col("url")).alias("host"), status.alias("status")))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def result_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as a result page with one card, some of them with a fault that follows from the id."""
    table = entries(spark, sf).withColumn("page_id", F.col("id").cast("long"))
    fault = F.col("page_id") % FAULTS
    href = F.concat(F.lit("/url"), F.when(fault == 0, "#").otherwise("?"), F.lit("q="), F.col("link"), F.lit("&amp;sa=U"))
    source = F.when(fault == 2, "").otherwise(F.concat(F.lit("<div>"), _escaped(F.col("source")), F.lit("</div>")))
    head = F.concat(F.lit("<div><h3><div>"), _escaped(F.col("title")), F.lit("</div></h3>"), source, F.lit("</div>"))
    span = F.when(fault == 4, "").otherwise("<span>today</span>")
    body = F.concat(F.lit('<div class="card-body">'), _escaped(F.col("content")), span, F.lit(" more</div>"))
    inner = F.when(fault == 1, "nothing").otherwise(F.concat(head, F.when(fault == 3, "").otherwise(body)))
    page = F.concat(
        F.lit('<body><a href="/nav?q=before">n</a><div id="main"><div><div><a class="c" href="'), href, F.lit('">'), inner,
        F.lit('</a></div></div></div><footer><a href="/nav?q=after">n</a></footer></body>'),
    )
    return table.select("page_id", F.concat(F.lit("https://results.example/"), F.col("source")).alias("url"), page.alias("html"))


def result_fields(spark: SparkSession, sf: str) -> DataFrame:
    return extract.card_fields(extract.page_cards(result_pages(spark, sf), extract.RESULTS_CARDS), extract.RESULTS_CARDS)


def result_entries(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("page_id")
    return extract.page_entries(result_fields(spark, sf), scraped_on(number), scraped_at(number))


def result_stats(spark: SparkSession, sf: str) -> DataFrame:
    fields = result_fields(spark, sf)
    return extract.extract_stats(fields.select(links.host(F.col("url")).alias("host"), "status"))


def on_stored_table(plan: Callable[..., DataFrame], *args) -> Query:
    """A plan over the table that the documents give, written to the shared folder."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        path = f"{shared_folder(spark)}/stored-{uuid.uuid4()}"
        append_entries(entries(spark, sf), path)
        return plan(spark, path, STORED_UNTIL, *args)

    return query


def _in_batches(add: Callable[[DataFrame, str, str], object], spark: SparkSession, sf: str) -> str:
    """A folder to which the documents were added in three batches, later days first and the second batch twice."""
    path = f"{shared_folder(spark)}/maintained-{uuid.uuid4()}"
    table = entries(spark, sf)
    late = F.col("date_scraped") >= CACHED_UNTIL
    morning = F.hour("created_at") < SECOND_RUN_HOUR
    batches = {"1": table.filter(late), "2": table.filter(~late & morning), "3": table.filter(~late & ~morning)}
    for batch in ("1", "2", "2", "3"):
        add(batches[batch], path, batch)
    return path


def maintained_digests(spark: SparkSession, sf: str) -> DataFrame:
    return maintained.maintained_digests(spark, _in_batches(maintained.add_to_latest, spark, sf))


def maintained_page_meta(spark: SparkSession, sf: str) -> DataFrame:
    return maintained.maintained_page_meta(spark, _in_batches(maintained.add_to_counts, spark, sf), FEED_PAGE)


def maintained_page_index(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks and pages of the entries of two days, from the folders of these days."""
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4()}"
    append_entries(entries(spark, sf), path)
    counts = _in_batches(maintained.add_to_counts, spark, sf)
    return maintained.maintained_page_index(spark, path, counts, INDEXED_DATES)


def _indexed_table(spark: SparkSession, sf: str) -> str:
    """The stored table with a trigram index, half of it there when the index was made and half appended."""
    path = f"{shared_folder(spark)}/indexed-{uuid.uuid4()}"
    table = entries(spark, sf)
    append_entries(after_first_run(table), path)
    index_entries(spark, path)
    append_entries(table.filter(F.hour("created_at") >= SECOND_RUN_HOUR), path)
    return path


def indexed_search(spark: SparkSession, sf: str) -> DataFrame:
    return stored.stored_search(spark, _indexed_table(spark, sf), RARE_WORD)


def indexed_search_page(spark: SparkSession, sf: str) -> DataFrame:
    return stored.stored_search_page(spark, _indexed_table(spark, sf), STORED_UNTIL, WORD)


def ingest_new(spark: SparkSession, sf: str) -> DataFrame:
    table = entries(spark, sf)
    return ingest.ingest_new(table, after_first_run(table))


def ingest_merged(spark: SparkSession, sf: str) -> DataFrame:
    table = entries(spark, sf)
    return ingest.ingest_merged(table, after_first_run(table))


def ingest_stream(spark: SparkSession, sf: str) -> DataFrame:
    run = f"{shared_folder(spark)}/ingest-{uuid.uuid4()}"
    number = F.col("page_id")
    ingest_pages(
        stream_pages(spark, f"{sf}/{{pages}}.parquet"),  # as a pattern it may be a file or a folder
        extract.ARTICLE_PAGE,
        scraped_on(number),
        scraped_at(number),
        target=f"{run}/entries",
        checkpoint=f"{run}/progress",
    ).awaitTermination()
    return read_entries(spark, f"{run}/entries")


def _cache(table: DataFrame) -> DataFrame:
    """Digest texts made some days before the last run."""
    earlier = digest.digest_by_source(table.filter(F.col("date_scraped") < CACHED_UNTIL))
    return earlier.select("title_hash", F.concat(F.lit("cached "), F.col("source")).alias("ai_summary"))


def digest_lookup(spark: SparkSession, sf: str) -> DataFrame:
    table = entries(spark, sf)
    requests = digest.digest_by_source(table).select("source", "title_hash")
    return digest.digest_lookup(requests, _cache(table))


def digest_cache_add(spark: SparkSession, sf: str) -> DataFrame:
    table = entries(spark, sf)
    source = F.col("source")
    text = (
        F.when(source == EMPTY_COMPLETION, "")
        .when(source == MISSING_COMPLETION, F.lit(None))
        .otherwise(F.concat(F.lit("new "), source))
    )
    completions = digest.digest_by_source(table).select("title_hash", text.alias("ai_summary"))
    return digest.digest_cache_add(completions, _cache(table)).select(CACHE_SCHEMA.names)


def digest_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of the whole feed, of the part that is cached, and of none."""
    table = entries(spark, sf)
    earlier = table.filter(F.col("date_scraped") < CACHED_UNTIL)
    cache = digest.digest_key(earlier, by_date=False).withColumn("ai_summary", F.lit("cached"))
    parts = {"feed": table, "earlier": earlier, "none": table.filter("date_scraped > '9999'")}
    rows = [digest.digest_requests(part, cache, by_date=False).withColumn("part", F.lit(name)) for name, part in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def cache_written(spark: SparkSession, sf: str) -> DataFrame:
    """The cache read back after two appends of completions, the second of which brings known keys again."""
    path = f"{shared_folder(spark)}/cache-{uuid.uuid4()}"
    table = entries(spark, sf)
    append_completions(_cache(table), path)
    made = digest.digest_by_source(table).select("title_hash", F.concat(F.lit("new "), F.col("source")).alias("ai_summary"))
    append_completions(made.unionByName(_cache(table).withColumn("ai_summary", F.lit("again"))), path)
    return read_cache(spark, path)


QUERIES: dict[str, Query] = {
    "entries_scan": lambda s, d: entries(s, d).select(ENTRY_COLUMNS),
    "entry_projection": entry_projection,
    "entry_json": lambda s, d: feed.entry_json(entries(s, d), start=API_START, by_date=False),
    "entry_by_id": lambda s, d: feed.entry_by_id(entries(s, d), ENTRY_ID),
    "entries_by_ids": entries_by_ids,
    "feed_page": lambda s, d: feed.feed_page(entries(s, d), FEED_PAGE, by_date=False),
    "feed_all": lambda s, d: feed.feed_all(entries(s, d), by_date=False),
    "feed_latest": lambda s, d: feed.feed_latest(entries(s, d), by_date=False),
    "feed_page_index": lambda s, d: feed.feed_page_index(entries(s, d)),
    "page_meta": lambda s, d: feed.page_meta(entries(s, d), FEED_PAGE),
    "search": lambda s, d: search.search(entries(s, d), WORD),
    "search_page": lambda s, d: search.search_page(entries(s, d), OPENING, SEARCH_PAGE),
    "search_meta": lambda s, d: search.search_meta(entries(s, d), OPENING, SEARCH_PAGE),
    "dedup_batch": lambda s, d: ingest.dedup_batch(entries(s, d)),
    "ingest_new": ingest_new,
    "ingest_merged": ingest_merged,
    "ingest_stream": ingest_stream,
    "page_cards": lambda s, d: extract.page_links(pages(s, d)),
    "card_link": card_link,
    "page_entries": extracted,
    "extract_stats": extract_stats,
    "digest_key": lambda s, d: digest.digest_key(entries(s, d), by_date=False),
    "digest_prompt": lambda s, d: digest.digest_prompt(entries(s, d), by_date=False),
    "digest_by_source": lambda s, d: digest.digest_by_source(entries(s, d)),
    "digest_lookup": digest_lookup,
    "digest_cache_add": digest_cache_add,
    "feed_page_deep": lambda s, d: feed.feed_page(entries(s, d), DEEP_PAGE),
    "feed_all_uncapped": lambda s, d: feed.feed_all(entries(s, d), cap=None),
    "search_page_blank": lambda s, d: search.search_page(entries(s, d), "", SEARCH_PAGE),
    "search_meta_blank": lambda s, d: search.search_meta(entries(s, d), "", SEARCH_PAGE),
    "result_entries": result_entries,
    "result_rejects": lambda s, d: extract.rejected_cards(result_fields(s, d)),
    "result_stats": result_stats,
    "stored_feed_page": on_stored_table(stored.stored_feed_page, FEED_PAGE),
    "stored_page_meta": on_stored_table(stored.stored_page_meta, FEED_PAGE),
    "stored_search_page": on_stored_table(stored.stored_search_page, OPENING, SEARCH_PAGE),
    "stored_search_meta": on_stored_table(stored.stored_search_meta, OPENING, SEARCH_PAGE),
    "maintained_digests": maintained_digests,
    "maintained_page_meta": maintained_page_meta,
    "maintained_page_index": maintained_page_index,
    "indexed_search": indexed_search,
    "indexed_search_page": indexed_search_page,
    "digest_requests": digest_requests,
    "cache_written": cache_written,
    "entry_payload": lambda s, d: feed.entry_payload(entries(s, d)),
    "freshness": lambda s, d: freshness.freshness(entries(s, d), RUN_DATE),
}
