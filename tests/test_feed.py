"""Slices, counts, numbering and lookups of the feed."""

import datetime as dt
import json

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from cardmill.operators import feed, newest
from cardmill.sources.entries import read_entries


def brute_force(df):
    """Ids in feed order, sorted in Python."""
    first = dt.datetime.min
    rows = df.select("id", "date_scraped", "created_at").collect()
    return [r.id for r in sorted(rows, key=lambda r: (r.date_scraped, r.created_at or first, r.id), reverse=True)]


@pytest.fixture(scope="module")
def hot(make_entries):
    """Most rows share one date, and most of these one instant; some have no instant."""
    rows = []
    for i in range(1500):
        row = {"id": f"{(i * 7919) % 100_003:024d}", "title": f"t{i}"}
        if i % 5 == 0:
            row["date_scraped"] = f"2024-01-{1 + i % 28:02d}"
        if i % 7 == 0:
            row["created_at"] = dt.datetime(2024, 1, 1, i % 24)
        if i % 11 == 0:
            row["created_at"] = None
        rows.append(row)
    return make_entries(rows).repartition(16).cache()


@pytest.mark.parametrize("start,limit", [(0, 30), (30, 30), (0, 1000), (990, 10), (995, 30), (1490, 30), (1500, 5), (9, 0)])
def test_slices_follow_the_order(hot, start, limit):
    ids = [r.id for r in feed.feed_slice(hot, start, limit).collect()]
    assert ids == brute_force(hot)[start : start + limit]


@pytest.mark.parametrize("by_date", [True, False])
def test_missing_and_repeated_ids_lose_no_rows(make_entries, by_date):
    rows = [{"id": None if i % 2 else f"{i % 7:024x}", "title": f"t{i}", "date_scraped": f"2024-01-{1 + i % 3:02d}"} for i in range(1100)]
    table = make_entries(rows).repartition(5)
    for start in (0, 470, 960, 990, 1020, 1090):
        found = feed.feed_slice(table, start, 30, by_date).collect()
        assert len(found) == min(30, 1100 - start)
        assert [r.date_scraped for r in found] == sorted((r.date_scraped for r in found), reverse=True)


def test_both_ways_agree(snippets):
    for start in (0, 300, 985):
        assert feed.feed_slice(snippets, start, 60).collect() == feed.feed_slice(snippets, start, 60, by_date=False).collect()


def test_the_whole_feed(snippets):
    assert [r.id for r in feed.feed_all(snippets, cap=None).collect()] == brute_force(snippets)


def test_pages_partition_the_feed(snippets):
    some = snippets.filter("cast(id as bigint) < 200")
    ids = [r.id for page in range(1, 9) for r in feed.feed_page(some, page).collect()]
    assert ids == brute_force(some)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.lists(st.tuples(st.integers(1, 4), st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 10**6)), max_size=80, unique_by=lambda r: r[2]),
    start=st.integers(0, 90),
    limit=st.integers(0, 40),
    parts=st.integers(1, 9),
)
def test_any_slice_of_any_table(make_entries, rows, start, limit, parts):
    table = make_entries(
        [
            {
                "id": f"{number:024d}",
                "date_scraped": f"2024-01-0{day}",
                "created_at": None if hour is None else dt.datetime(2024, 1, day, hour),
            }
            for day, hour, number in rows
        ]
    ).repartition(parts)
    expected = brute_force(table)[start : start + limit]
    assert [r.id for r in feed.feed_slice(table, start, limit).collect()] == expected
    assert [r.id for r in feed.feed_slice(table, start, limit, by_date=False).collect()] == expected


def test_ranks_of_a_hot_date(hot):
    ranks = {r.id: r.feed_rank for r in feed.feed_page_index(hot).collect()}
    assert ranks == {id_: n for n, id_ in enumerate(brute_force(hot), start=1)}


def test_page_index_agrees_with_the_pages(snippets):
    index = feed.feed_page_index(snippets)
    assert {r.id for r in index.filter("page = 3").collect()} == {r.id for r in feed.feed_page(snippets, 3).collect()}


def test_latest_of_groups_with_missing_ids(make_entries):
    rows = [{"id": None if i % 2 else f"{i:024x}", "source": "a" if i % 5 else "b"} for i in range(60)]
    found = newest.latest_per_group(make_entries(rows), "source", 10).collect()
    assert sorted(r.source for r in found) == ["a"] * 10 + ["b"] * 10
    assert all(r.id for r in found if r.source == "a")


@pytest.mark.parametrize("rows", [1, 33, 34, 500, 1000, 5000])
def test_newest_dates_hold_the_newest_rows(spark, stored_table, rows):
    table = read_entries(spark, stored_table)
    kept = {r.id for r in newest.newest_dates(table, rows).collect()}
    assert set(brute_force(table)[:rows]) <= kept
    if rows <= 33:
        assert len(kept) < 100


def test_stored_page_equals_page(spark, stored_table, snippets):
    for page in (1, 4, 34, 40):
        expected = feed.feed_page(snippets, page, by_date=False).collect()
        assert feed.feed_page(read_entries(spark, stored_table), page).collect() == expected


def test_counts(make_entries, snippets):
    assert feed.page_meta(snippets, 1).first().asDict() == {
        "page": 1,
        "total": 1000,
        "pages": 34,
        "has_next": True,
        "has_prev": False,
    }
    assert feed.page_meta(snippets.union(snippets), 34).first().total == 1000
    assert feed.page_meta(snippets.union(snippets), 34, cap=None).first().total == 2000
    last = feed.page_meta(snippets, 34).first()
    assert (last.has_next, last.has_prev) == (False, True)
    empty = feed.page_meta(make_entries([]), 1).first()
    assert (empty.total, empty.pages, empty.has_next) == (0, 0, False)


def test_past_the_end(snippets):
    assert feed.feed_page(snippets, 99).count() == 0
    assert feed.page_meta(snippets, 99).first().has_prev


@pytest.mark.parametrize("call", [dict(start=-1), dict(limit=-1)])
def test_bad_slices(snippets, call):
    with pytest.raises(ValueError):
        feed.feed_slice(snippets, **call)


@pytest.mark.parametrize("page", [0, -1])
def test_bad_pages(snippets, page):
    for operator in (feed.feed_page, feed.page_meta):
        with pytest.raises(ValueError):
            operator(snippets, page)


def test_lookups(spark, snippets):
    one = snippets.orderBy("id").first()
    assert feed.entry_by_id(snippets, one.id).collect() == [one]
    assert feed.entry_by_id(snippets, "none").count() == 0
    ids = spark.createDataFrame([(one.id,)] * 500 + [("none",), (None,)], "id string")
    assert feed.entries_by_ids(snippets, ids).collect() == [one]


def test_records(snippets):
    row = feed.entry_json(snippets, 0, 1).first()
    record = json.loads(row.json)
    assert list(record) == ["id", "title", "content", "source", "link", "date_scraped", "created_at"]
    assert record["id"] == row.id
    assert dt.datetime.fromisoformat(record["created_at"]) == feed.feed_page(snippets).first().created_at


def test_projection_and_payload(snippets):
    stored = snippets.withColumn("_id", F.lit(17)).drop("id")
    assert feed.entry_projection(stored).first().id == "17"
    assert "id" not in feed.entry_payload(snippets).columns
