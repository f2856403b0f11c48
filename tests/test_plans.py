"""The physical plans are the ones meant."""

import pytest

from cardmill.operators import digest, extract, feed, ingest, newest, search
from cardmill.plans import registry
from cardmill.sources.entries import read_entries
from conftest import SF


@pytest.fixture(scope="module")
def table(spark, stored_table):
    return read_entries(spark, stored_table)


def test_feed_ranks_order_values_in_the_map_tasks(table, plan_of):
    plan = plan_of(feed.feed_page(table, 2))
    assert "row_number(), 60, Partial" in plan
    # Text is read by the last scan alone; the ranking reads the order columns.
    assert plan.count("FileScan parquet [id") + plan.count("FileScan parquet [created_at") + plan.count("FileScan parquet [title") >= 2


def test_search_is_a_top_k_reduced_in_the_map_tasks(table, plan_of):
    plan = plan_of(search.search_page(table, "the", 2))
    assert "TakeOrderedAndProject(limit=60, offset=30" in plan
    assert "row_number(), 60, Partial" in plan


def test_newest_dates_prune_partitions(table, plan_of):
    plan = plan_of(newest.newest_dates(table, 60))
    filters = plan.split("PartitionFilters: [", 1)[1].split("PushedFilters", 1)[0]
    assert "date_scraped" in filters and "Subquery" in filters
    assert "ReadSchema: struct<>" in plan  # the counts come from footers


def test_counts_read_no_columns(table, plan_of):
    assert "ReadSchema: struct<>" in plan_of(feed.page_meta(table))


def test_lookup_is_pushed_to_the_scan(table, plan_of):
    assert "EqualTo(id,0000)" in plan_of(feed.entry_by_id(table, "0000"))


def test_ingest_is_an_anti_join_on_pruned_dates(spark, stored_table, snippets, plan_of):
    stored = read_entries(spark, stored_table, ["2024-01-03"])
    plan = plan_of(ingest.ingest_new(snippets, stored, by_date=False))
    filters = plan.rsplit("PartitionFilters:", 1)[1].split("PushedFilters", 1)[0]
    assert "LeftAnti" in plan and "= 2024-01-03" in filters
    assert "row_number(), 1, Partial" in plan
    assert all("/date_scraped=2024-01-03/" in name for name in stored.inputFiles())


def test_ingest_prunes_by_the_dates_of_the_batch(table, snippets, plan_of):
    plan = plan_of(ingest.ingest_new(snippets.filter("date_scraped < '2024-01-03'"), table))
    scan = [line for line in plan.splitlines() if "FileScan parquet [title" in line]
    assert len(scan) == 1 and "date_scraped" in scan[0].split("PartitionFilters:", 1)[1] and "Subquery" in scan[0]


def test_digest_ranks_order_values_in_the_map_tasks(table, plan_of):
    plan = plan_of(digest.digest_by_source(table))
    assert "row_number(), 10, Partial" in plan
    assert plan.count("FileScan") == 2 and plan.count("content") < 12


def test_a_large_anti_join_keeps_one_shuffle_per_side(spark, table, plan_of):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(ingest.ingest_new(table, table, by_date=False))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 2


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"ingest_stream"}))
def test_no_python_and_no_cross_join(spark, plan_of, name):
    plan = plan_of(registry.QUERIES[name](spark, SF))
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_extraction_shuffles_nothing(spark, plan_of):
    pages = registry.pages(spark, SF)
    assert "Exchange" not in plan_of(extract.page_links(pages))
    assert "Exchange" not in plan_of(registry.extracted(spark, SF))


def test_search_stays_one_scan(table, plan_of):
    plan = plan_of(search.search_page(table, "the", 2))
    assert plan.count("FileScan") == 1 and "RLIKE" in plan
