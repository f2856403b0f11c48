import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F
from hypothesis import HealthCheck, given, settings, strategies as st

from cardmill.operators import feed, ingest
from cardmill.schema import ENTRY_KEY, ENTRY_SCHEMA
from cardmill.sources.entries import append_entries, read_entries, write_json
from cardmill.streaming.ingest import append_absent


def key_set(df):
    return {tuple(r) for r in df.select(ENTRY_KEY).collect()}


def test_the_first_of_equal_keys_survives(make_entries):
    noon = dt.datetime(2024, 1, 1, 12)
    table = make_entries(
        [
            {"id": "b", "created_at": noon},
            {"id": "c", "created_at": noon - dt.timedelta(hours=1)},
            {"id": "a", "created_at": noon},
            {"id": "d", "date_scraped": "2024-01-02"},
        ]
    )
    assert sorted(r.id for r in ingest.dedup_batch(table).collect()) == ["c", "d"]


def test_half_stored(snippets):
    stored = snippets.filter("cast(id as bigint) % 2 = 0")
    assert ingest.dedup_batch(snippets).count() == 969
    assert ingest.ingest_new(snippets, stored).count() == 491
    merged = ingest.ingest_merged(snippets, stored)
    assert merged.count() == 500 + 491
    assert ingest.ingest_new(snippets, merged).count() == 0


def test_empty_sides(make_entries, snippets):
    empty = make_entries([])
    assert ingest.ingest_new(empty, snippets).count() == 0
    assert ingest.ingest_new(snippets, empty).count() == 969


def test_a_key_that_holds_most_rows(spark, snippets, make_entries):
    hot = make_entries([{"title": "Unknown Title", "source": "hot"}]).crossJoin(spark.range(20_000).select("id").toDF("n"))
    copies = hot.selectExpr("lpad(cast(n as string), 24, '0') as id", *[c for c in hot.columns if c not in ("id", "n")])
    table = copies.unionByName(snippets)
    assert ingest.ingest_new(table, snippets).count() == 1
    assert ingest.ingest_new(snippets, copies.unionByName(copies)).count() == 969


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cuts=st.lists(st.integers(0, 60), max_size=3))
def test_any_split_into_batches_gives_the_same_keys(make_entries, tmp_path_factory, cuts):
    rows = [
        {"title": f"t{i % 13}", "source": f"s{i % 3}", "date_scraped": f"2024-01-0{1 + i % 2}", "id": f"{i:024x}"}
        for i in range(60)
    ]
    target = str(tmp_path_factory.mktemp("split") / "entries")
    bounds = [0, *sorted(cuts), 60]
    whole = make_entries(rows)
    for low, high in zip(bounds, bounds[1:]):
        append_absent(make_entries(rows[low:high]), target)
    table = read_entries(whole.sparkSession, target)
    assert key_set(table) == key_set(whole)
    assert table.count() == len(key_set(whole))


def test_table_round_trip(spark, stored_table, snippets):
    table = read_entries(spark, stored_table)
    assert table.dtypes == snippets.dtypes
    assert sorted(table.collect(), key=repr) == sorted(snippets.collect(), key=repr)
    some = read_entries(spark, stored_table, ["2024-01-03", "2024-01-05", "1999-01-01"])
    assert sorted(r[0] for r in some.select("date_scraped").distinct().collect()) == ["2024-01-03", "2024-01-05"]


def test_ids_have_bloom_filters(stored_table):
    found = duckdb.sql(
        f"select path_in_schema, count(bloom_filter_offset) from parquet_metadata('{stored_table}/*/*.parquet') group by 1"
    ).fetchall()
    assert {name for name, n in found if n} == {"id"}


def test_dates_of_the_batch_prune_exactly(snippets):
    batch = snippets.filter("date_scraped between '2024-01-05' and '2024-01-07'")
    stored = snippets.filter("hour(created_at) < 12")
    with_dates = ingest.ingest_new(batch, stored)
    without = ingest.ingest_new(batch, stored, by_date=False)
    assert sorted(with_dates.collect()) == sorted(without.collect())
    assert ingest.ingest_new(batch.limit(0), stored).count() == 0


def test_json_lines(spark, snippets, tmp_path):
    write_json(feed.entry_json(snippets, 0, 7), str(tmp_path / "json"))
    back = spark.read.schema(ENTRY_SCHEMA).json(str(tmp_path / "json"))
    assert sorted(back.collect()) == sorted(feed.feed_slice(snippets, 0, 7).collect())


def test_reading_what_is_not_there(spark, tmp_path, stored_table):
    assert read_entries(spark, str(tmp_path / "none")).count() == 0
    assert read_entries(spark, stored_table, ["1999-01-01"]).count() == 0
    assert read_entries(spark, stored_table, []).count() == 0
    assert read_entries(spark, stored_table, ["*"]).count() == 0
    assert read_entries(spark, stored_table, ["2024-01-03", "no date", None]).count() == read_entries(spark, stored_table, ["2024-01-03"]).count()


def test_a_hot_date_is_written_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "entries")
    df = spark.range(200_000).selectExpr(
        "lpad(cast(id as string), 24, '0') as id",
        "sha2(cast(id as string), 512) as title",
        "repeat(sha2(cast(id as string), 256), 2) as content",
        "'s' as source",
        "'l' as link",
        "'2024-01-01' as date_scraped",
        "timestamp_ntz'2024-01-01 00:00:00' as created_at",
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4MB")
    try:
        append_entries(df, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    table = read_entries(spark, path)
    assert table.count() == 200_000
    assert len(table.inputFiles()) > 1


def test_missing_parts_of_keys_are_stored_once(make_entries):
    table = make_entries([{"title": "x"}, {"title": "y"}]).withColumn("source", F.lit(None).cast("string"))
    assert ingest.ingest_new(table, table).count() == 0
    assert ingest.ingest_new(table, table.filter("title = 'x'"), by_date=False).count() == 1
