"""The k-th of many values in order, found by counting, without ranking them in one place."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.types import StructType

SPLITTERS = 63  # values that a round counts between
SAMPLE = 1024  # values that they are taken from, about
FEW = 4096  # values that are ranked in the driver


@dataclass(frozen=True)
class Kth:
    """A value, how many are greater, and how many are equal to it."""

    value: Row
    before: int
    equal: int


def literal(value: Row, kind: StructType) -> Column:
    return F.struct(*(F.lit(value[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields))


def _key(value: Row) -> tuple[tuple[bool, Any], ...]:
    """Sorts as Spark sorts structs: missing parts are the least."""
    return tuple((part is not None, part) if part is not None else (False,) for part in value)


def _class(value: Column, splitters: list[Row], kind: StructType, first: int = 0) -> Column:
    """Twice the number of splitters below the value, plus one if it is equal to one: a search tree of comparisons."""
    if not splitters:
        return F.lit(2 * first)
    middle = len(splitters) // 2
    at = literal(splitters[middle], kind)
    above = _class(value, splitters[middle + 1 :], kind, first + middle + 1)
    below = _class(value, splitters[:middle], kind, first)
    return F.when(value > at, above).when(value == at, 2 * (first + middle) + 1).otherwise(below)


def kth_greatest(values: DataFrame, k: int) -> Kth | None:
    """The ``k``-th greatest of a table with one struct column, counting from 1; None if there are not as many.

    Each round counts the values that are left between some of them, drawn at random, and
    goes on with the interval that holds the wanted one. An interval holds about a sixty-third of the one before, and a value that
    many rows have is drawn and counted by itself, so ten billion rows take four rounds over the columns of the order. At
    most ``FEW`` values, or the sample, come to the driver.
    """
    column = values.columns[0]
    kind = values.schema[column].dataType
    value = F.col(column)
    left, before = values, 0
    total = left.count()
    if k > total:
        return None
    turn = 0
    while total > FEW:
        share = min(1.0, SAMPLE / total * 4**turn)
        drawn = left.filter(F.rand(turn) < share).limit(FEW).collect()
        ordered = sorted({row[0] for row in drawn}, key=_key)
        if not ordered:
            turn += 1
            continue
        step = max(1, len(ordered) // SPLITTERS)
        # Of a value with many rows the sample has many, but here it stands once.
        splitters = ordered[step // 2 :: step]
        counts = dict(left.groupBy(_class(value, splitters, kind).alias("class")).count().collect())
        for place in range(2 * len(splitters), -1, -1):
            n = counts.get(place, 0)
            if before + n >= k:
                break
            before += n
        if place % 2:
            return Kth(splitters[place // 2], before, n)
        low = splitters[place // 2 - 1] if place else None
        high = splitters[place // 2] if place // 2 < len(splitters) else None
        # The first part alone, too, for this is what storage can be pruned by.
        lead = kind.names[0]
        if low is not None:
            left = left.filter(value > literal(low, kind))
            if low[0] is not None:
                left = left.filter(value[lead] >= F.lit(low[0]))
        if high is not None:
            left = left.filter(value < literal(high, kind))
            if high[0] is not None:
                left = left.filter((value[lead] <= F.lit(high[0])) | value[lead].isNull())
        turn, total = (turn + 1, n) if n == total else (0, n)
    ranked = sorted((row[0] for row in left.collect()), key=_key, reverse=True)
    wanted = ranked[k - before - 1]
    return Kth(wanted, before + ranked.index(wanted), ranked.count(wanted))
