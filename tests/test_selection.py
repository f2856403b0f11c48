"""Values found by counting, and deep slices of feeds with hot, missing and repeated order values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cardmill.operators import feed, newest, selection


def placed(spark, values):
    return spark.createDataFrame([(v,) for v in values], "a string").repartition(6).select(F.struct("a").alias("o"))


@pytest.mark.parametrize("few", [40, 4096])
def test_any_place_of_any_values(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "SAMPLE", 60)
    rng = random.Random(3)
    values = [None] * 40 + ["hot"] * 300 + [f"{rng.randrange(400):03}" for _ in range(400)] + ["z" * 9]
    order = sorted(values, key=lambda v: (v is not None, v or ""), reverse=True)
    table = placed(spark, values).cache()
    for k in (1, 250, 302, 303, 701, 741):
        found = selection.kth_greatest(table, k)
        assert found.value[0] == order[k - 1]
        assert found.before == order.index(order[k - 1]) and found.equal == order.count(order[k - 1])
    assert selection.kth_greatest(table, 742) is None
    assert selection.kth_greatest(table.limit(0), 1) is None


@pytest.fixture(scope="module")
def large(spark):
    """100,000 entries: a third of one order value without id, many repeated ids, missing dates and instants."""
    n = F.col("n")
    hot = n % 3 == 0
    table = spark.range(100_000).withColumnRenamed("id", "n").select(
        F.when(~hot & (n % 5 != 0), F.lpad((n * 7919 % 30_011).cast("string"), 24, "0")).alias("id"),
        F.concat(F.lit("t"), n).alias("title"),
        F.lit("c").alias("content"),
        F.when(n % 2 == 0, "a").otherwise("b").alias("source"),
        F.lit("l").alias("link"),
        F.when(hot, "2024-01-20").when(n % 1009 == 0, None).otherwise(F.format_string("2024-01-%02d", (n % 28 + 1).cast("int"))).alias("date_scraped"),
        F.when(hot, F.lit("2024-01-20 05:00:00")).when(n % 13 != 0, F.format_string("2024-01-01 %02d:00:00", (n % 24).cast("int"))).cast("timestamp_ntz").alias("created_at"),
    )
    return table.repartition(8).cache()


@pytest.fixture(scope="module")
def in_order(large):
    """Every title by feed order and hash, sorted in Python."""
    rows = large.select("title", newest.order_value().alias("o"), F.xxhash64(*large.columns).alias("h")).collect()
    key = lambda r: tuple((x is not None, x) if x is not None else (False,) for x in (*r.o, r.h))
    return [r.title for r in sorted(rows, key=key, reverse=True)]


@pytest.mark.parametrize("start", range(0, 100_000, 12_500))
def test_slices_cover_the_feed(large, in_order, start):
    found = newest.newest(large, start, 12_500)
    assert sorted(r.title for r in found.collect()) == sorted(in_order[start : start + 12_500])


@pytest.mark.parametrize("page", [1, 33, 34, 400, 1111, 1500, 3300, 3333, 3334, 3335])
def test_pages_at_any_depth(large, in_order, page):
    found = [r.title for r in feed.feed_page(large, page).collect()]
    assert sorted(found) == sorted(in_order[30 * page - 30 : 30 * page])


def test_copies_of_one_row(make_entries):
    table = make_entries([{"id": "1", "title": "same"}] * 2500 + [{"id": "0", "title": "last"}] * 3).repartition(4)
    for start, limit, expected in ((1200, 30, ["same"] * 30), (1200, 1290, ["same"] * 1290), (2495, 30, ["last"] * 3 + ["same"] * 5)):
        assert sorted(r.title for r in feed.feed_slice(table, start, limit).collect()) == expected


def test_deep_pages_rank_nothing_large(spark, large, plan_of):
    plan = plan_of(feed.feed_page(large, 300))
    ranked = [int(n) for n in re.findall(r"row_number\(\), (\d+), Partial", plan)]
    assert ranked and max(ranked) <= 30
