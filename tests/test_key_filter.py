"""Filters of stored keys: no stored key is missed, few others are found, and ingest reads only what it must."""

import pytest
from pyspark.sql import functions as F

from cardmill.operators import ingest
from cardmill.schema import ENTRY_KEY
from cardmill.sources.entries import append_entries, filter_keys, read_entries
from cardmill.sources.key_filter import maybe_stored, read_filters
from cardmill.streaming.ingest import append_absent, not_stored


@pytest.fixture
def path(spark, tmp_path):
    path = str(tmp_path / "entries")
    filter_keys(spark, path)
    return path


def keys_of(df):
    return sorted(map(tuple, df.select(ENTRY_KEY).collect()), key=str)


def test_bits_tell_stored_keys(spark, make_entries, path):
    stored = make_entries([{"title": f"t{i}", "date_scraped": f"2024-01-{1 + i % 3:02d}"} for i in range(9000)])
    stored = stored.withColumn("date_scraped", F.when(F.pmod(F.xxhash64("title"), F.lit(50)) > 0, F.col("date_scraped")))
    for third in range(3):
        append_entries(stored.filter(F.pmod(F.xxhash64("title"), F.lit(3)) == third), path)
    filters = read_filters(spark, path)
    assert keys_of(maybe_stored(stored, filters)) == keys_of(stored)
    others = stored.withColumn("source", F.lit("other"))
    assert maybe_stored(others, filters).count() < 0.05 * 9000
    elsewhere = stored.withColumn("date_scraped", F.lit("2025-01-01"))
    assert maybe_stored(elsewhere, filters).count() == 0
    assert filters.filter("day = '2024-01-01'").agg(F.max("n_blocks")).first()[0] >= 1


def test_large_dates_have_many_blocks(spark, make_entries, path):
    stored = spark.range(50_000).select(
        F.lit("i").alias("id"), F.concat(F.lit("t"), "id").alias("title"), F.lit("c").alias("content"), F.lit("s").alias("source"),
        F.lit("l").alias("link"), F.lit("2024-01-01").alias("date_scraped"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    append_entries(stored, path)
    filters = read_filters(spark, path)
    assert filters.count() == 19 == filters.first().n_blocks
    assert maybe_stored(stored, filters).count() == 50_000
    assert maybe_stored(stored.withColumn("title", F.concat("title", F.lit("x"))), filters).count() < 2000


def test_ingest_twice_equals_once(spark, snippets, path):
    half = snippets.filter("cast(id as bigint) % 2 = 0")
    append_absent(half, path)
    append_absent(snippets, path)
    once = keys_of(read_entries(spark, path))
    append_absent(snippets, path)
    assert keys_of(read_entries(spark, path)) == once == keys_of(ingest.dedup_batch(snippets))


def test_the_stored_scan_is_skipped_where_no_key_may_be_present(spark, snippets, make_entries, path, plan_of):
    append_absent(snippets, path)
    batch = make_entries([{"title": f"new {i}", "date_scraped": "2024-01-05"} for i in range(20)])
    fresh = not_stored(batch, path, read_filters(spark, path))
    assert "date_scraped=" not in " ".join(fresh.inputFiles()) and "Join" not in plan_of(fresh) and fresh.count() == 20
    some = batch.unionByName(snippets.filter("date_scraped = '2024-01-09'"))
    found = not_stored(some, path, read_filters(spark, path))
    scanned = {f.split("date_scraped=")[1][:10] for f in found.inputFiles() if "date_scraped=" in f}
    assert "2024-01-09" in scanned and scanned <= {"2024-01-05", "2024-01-09"}
    assert keys_of(found) == keys_of(batch)


def test_missing_parts_and_no_rows(spark, make_entries, path):
    rows = make_entries([{"title": "", "source": "a"}, {"title": "", "source": "a", "date_scraped": "none"}])
    rows = rows.withColumn("date_scraped", F.when(F.col("date_scraped") != "none", F.col("date_scraped")))
    append_absent(rows, path)
    append_absent(rows, path)
    assert read_entries(spark, path).count() == 2
    append_absent(rows.limit(0), path)
    assert read_entries(spark, path).count() == 2


def test_what_was_stored_before_is_known(spark, snippets, tmp_path):
    path = str(tmp_path / "entries")
    append_entries(snippets, path)
    assert read_filters(spark, path) is None
    filter_keys(spark, path)
    append_absent(snippets, path)
    assert read_entries(spark, path).count() == snippets.count()
