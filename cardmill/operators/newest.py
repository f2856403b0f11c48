"""The newest rows, of all or of each group, without gathering more than these.

Rows are told by their order value, never by an id, so missing and repeated ids
do no harm. Rows of equal order go by a hash of their columns, so that slices fit together. Nothing runs while a plan is built,
but for slices that end below row ``SHALLOW``: there the edges are found first, by counting.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import feed_order
from ..session import shared_folder
from . import selection

# Map tasks are dealt into lanes, each reduced by a task of its own: as many as this,
# or fewer for more rows, as the values of all lanes are ranked together.
LANES = 256
RANKED = 1 << 14

# Slices that end above this row are ranked in lanes.
SHALLOW = 1000

# More dates than this are not listed in a filter.
MAX_DATES = 1000


def order_value() -> Column:
    """A struct whose descending order is the feed order, missing values last."""
    return F.struct("date_scraped", "created_at", "id")


def _lane(limit: int) -> Column:
    return F.pmod(F.spark_partition_id(), F.lit(max(8, min(LANES, RANKED // max(limit, 1)))))


def _full_order(rows: DataFrame) -> Column:
    """The order value and, for rows that share it, a hash of all columns."""
    return F.struct(order_value().alias("o"), F.xxhash64(*rows.columns).alias("h"))


def _first(rows: DataFrame, groups: list[str], order: Column, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group. Spark cuts them in the map tasks up to the threshold of the session."""
    window = Window.partitionBy(*groups).orderBy(order.desc())
    return rows.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= limit).drop("_n")


def _reduced(rows: DataFrame, groups: list[str], order: Column, limit: int) -> DataFrame:
    """A few rows that hold the first ``limit`` of each group: those of its lanes."""
    return _first(rows.withColumn("_lane", _lane(limit)), [*groups, "_lane"], order, limit).drop("_lane")


def newest(rows: DataFrame, start: int, limit: int) -> DataFrame:
    """``limit`` rows from row ``start`` of the feed."""
    if start + limit > SHALLOW and limit:
        return _deep(rows, start, limit)
    return _shallow(rows, start, limit)


def _shallow(rows: DataFrame, start: int, limit: int) -> DataFrame:
    """The order values alone are ranked, in lanes and then together, which gives
    the values of the first and the last row of the slice. Only rows between
    these are taken with all their columns: the slice, and rows that are equal
    in order at its edges.
    """
    end = start + limit
    values = _reduced(rows.select(order_value().alias("o")), [], F.col("o"), end)
    all_in_order = Window.orderBy(F.col("o").desc())
    ranked = values.withColumn("n", F.row_number().over(all_in_order)).withColumn("r", F.rank().over(all_in_order))
    first = F.col("n") == start + 1
    edges = ranked.filter(F.col("n") <= end).agg(
        F.min("o").alias("last"), F.max(F.when(first, F.col("o"))).alias("first"),
        F.max(F.when(first, F.col("r"))).alias("r"),
    )
    cut = edges.select(F.struct("first", "last", (F.col("r") - 1).alias("before")).alias("cut")).scalar()
    between = rows.filter((order_value() <= cut["first"]) & (order_value() >= cut["last"]))
    order = _full_order(rows)
    numbered = _reduced(between, [], order, end).withColumn(
        "_n", F.row_number().over(Window.orderBy(order.desc())) + cut["before"]
    )
    return numbered.filter((F.col("_n") > start) & (F.col("_n") <= end)).drop("_n").orderBy(*feed_order())


def _deep(rows: DataFrame, start: int, limit: int) -> DataFrame:
    """The values at the edges of the slice are found by counting, and the rows between them taken.

    No task ranks more than a page of rows, whatever the depth.
    """
    values = rows.select(order_value().alias("o"))
    kind = values.schema["o"].dataType
    first = selection.kth_greatest(values, start + 1)
    if first is None:
        return rows.limit(0)
    skipped = start - first.before
    here = min(limit, first.equal - skipped)
    out = _equal_rows(rows, selection.literal(first.value, kind), skipped, here)
    below = rows.filter(order_value() < selection.literal(first.value, kind))
    if first.value[0] is not None:
        # For storage to prune by.
        below = below.filter((F.col("date_scraped") <= first.value[0]) | F.col("date_scraped").isNull())
    rest = limit - here
    if rest and rest <= SHALLOW:
        out = out.unionByName(_shallow(below, 0, rest))
    elif rest:
        last = selection.kth_greatest(values, start + limit)
        if last is not None:
            edge = selection.literal(last.value, kind)
            below = below.filter(order_value() > edge)
            out = out.unionByName(_equal_rows(rows, edge, 0, start + limit - last.before))
        out = out.unionByName(below)
    return out.orderBy(*feed_order())


def _equal_rows(rows: DataFrame, value: Column, start: int, limit: int) -> DataFrame:
    """``limit`` of the rows with an order value, from row ``start`` by their hashes."""
    equal = rows.filter(order_value() == value)
    mark = F.xxhash64(*rows.columns)
    if start + limit <= SHALLOW:
        return equal.orderBy(mark.desc()).offset(start).limit(limit)
    marks = equal.select(F.struct(mark.alias("h")).alias("o"))
    first, last = selection.kth_greatest(marks, start + 1), selection.kth_greatest(marks, start + limit)
    if first.value == last.value:  # copies of one row
        return equal.filter(mark == first.value[0]).limit(limit)
    ends = equal.filter(mark == first.value[0]).limit(first.before + first.equal - start)
    ends = ends.unionByName(equal.filter(mark == last.value[0]).limit(start + limit - last.before))
    return ends.unionByName(equal.filter((mark < first.value[0]) & (mark > last.value[0])))


def newest_in_one_pass(rows: DataFrame, start: int, limit: int) -> DataFrame:
    """As ``newest``, but all columns go through the ranking; for rows that are costly to find, and near the top."""
    end = start + limit
    order = _full_order(rows)
    return _reduced(rows, [], order, end).orderBy(order.desc()).offset(start).limit(limit)


def distinct_dates(rows: DataFrame) -> list[str] | None:
    """The dates of some rows; None if there are too many to list."""
    found = rows.select("date_scraped").distinct().limit(MAX_DATES + 1).collect()
    return None if len(found) > MAX_DATES else [row[0] for row in found]


def latest_per_group(entries: DataFrame, by: str, limit: int) -> DataFrame:
    """The newest ``limit`` entries of each group.

    Order values are ranked in each map task, in each lane of a group and in
    the group; the last one is the group's cut. Entries that reach the cut of their group
    are then taken: the wanted ones and those equal to the last.
    """
    narrow = entries.select(F.col(by).alias("_group"), order_value().alias("o"))
    best = _first(_reduced(narrow, ["_group"], F.col("o"), limit), ["_group"], F.col("o"), limit)
    cuts = best.groupBy("_group").agg(F.min("o").alias("_cut"))
    reached = entries.join(cuts, F.col(by).eqNullSafe(F.col("_group"))).filter(order_value() >= F.col("_cut"))
    reached = reached.drop("_group", "_cut")
    return _first(_reduced(reached, [by], order_value(), limit), [by], order_value(), limit)


def newest_dates(entries: DataFrame, rows: int) -> DataFrame:
    """The entries of the newest dates that together hold at least ``rows`` rows.

    Meant for a table partitioned by date. The counts per date come from file
    footers and the cut is a scalar subquery, so Spark prunes the partitions
    when the query runs, before it opens a data file.
    """
    newest_first = Window.orderBy(F.col("date_scraped").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    cut = (
        entries.groupBy("date_scraped")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("date_scraped", F.sum("n").over(newest_first).alias("n_so_far"))
        .filter(F.col("n_so_far") >= rows)
        .agg(F.coalesce(F.max("date_scraped"), F.lit("")).alias("cut"))
    )
    some = F.col("date_scraped") >= cut.scalar()
    # Entries without a date are the last of the feed, so they count where all others do not suffice.
    return entries.filter(some | (F.col("date_scraped").isNull() & (cut.scalar() == "")))


def feed_rank(entries: DataFrame) -> DataFrame:
    """``(id, date_scraped, feed_rank)`` of every entry, ranks from 1.

    A range sort spreads the feed evenly whatever date or instant holds most of
    it, because ``id`` is part of the order. Each row then needs only its place
    in its partition plus the sizes of the partitions before it, one number per
    partition. The places are written to the shared folder and read back, so
    that sizes and places stem from the same sort, also after a lost executor.
    """
    spark = entries.sparkSession
    path = f"{shared_folder(spark)}/feed-rank-{uuid.uuid4()}"
    place = F.monotonically_increasing_id()  # partition number in the upper bits, row number in the lower 33
    (
        entries.select("date_scraped", "created_at", "id")
        .orderBy(*feed_order())
        .select(
            "id",
            "date_scraped",
            F.shiftright(place, 33).alias("part"),
            place.bitwiseAND(F.lit((1 << 33) - 1)).alias("row"),
        )
        .write.parquet(path)
    )
    placed = spark.read.schema("id string, date_scraped string, part bigint, row bigint").parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    # One row per sort partition, at most spark.sql.shuffle.partitions of them.
    ranked = placed.join(F.broadcast(starts), "part")
    return ranked.select("id", "date_scraped", (F.col("start") + F.col("row") + 1).alias("feed_rank"))
