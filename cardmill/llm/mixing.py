"""Mixing sources to target weights: whole copies of documents by pivotal dependent rounding.

Each source gets a target, in words. Its documents have the expected number of
copies target / size of the source. The whole part is taken as it is. The
fractions are rounded in pairs: words move from one document of a source to
another until one fraction is 0 or 1, in the direction that a draw chooses such that all
expectations stay, so the words of a source stay as they were in sum. Buckets
of documents do this side by side and leave one fraction for each source; these residuals
are combined in a tree, ``FAN_IN`` buckets to one at each level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .tables import WORD, free_name, stored

WEIGHTS = (5, 2, 1)  # by the order of sources, repeating
SHARE = 1.5  # words of the mix for each word of the input
MOST_COPIES = 2.0  # of a source and of a document
BUCKET_ROWS = 20_000
FAN_IN = 64
SEED = 7


def source_targets(sized: DataFrame) -> DataFrame:
    """``(source, source_size, target)``, one row a source, from rows ``(source, size)``.

    Sources are ordered by code point, null last. The share of a source is its
    weight times a level; where that is above ``MOST_COPIES`` times its size it stops
    there, and the level rises for the others, until none is above.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (at % len(WEIGHTS) + 1).cast("int")).cast("double")
    capped = (
        sources.withColumn("weight", weight)
        .withColumn("cap", MOST_COPIES * F.col("source_size"))
        .withColumn("wanted", SHARE * F.sum("source_size").over(everything))
        .withColumn("stop", F.col("cap") / F.col("weight"))
    )
    lowest_stop = Window.orderBy("stop", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(lowest_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    on = F.sum("weight").over(lowest_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = capped.withColumn("level", (F.col("wanted") - before) / on)
    reached = F.max(F.when(F.col("level") <= F.col("stop"), F.col("level"))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * reached, F.col("cap")))
    return level.select("source", "source_size", target.alias("target"))


def settle(size: np.ndarray, chance: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int | None]:
    """Rounds the chances of the documents of one source, in order; one may stay open, whose index comes second."""
    chance = chance.copy()
    held = None
    for i in range(len(size)):
        if chance[i] <= 0.0 or chance[i] >= 1.0:
            continue
        if held is None:
            held = i
            continue
        a, b = size[held], size[i]
        up = min(a * (1.0 - chance[held]), b * chance[i])  # words from i to held
        down = min(a * chance[held], b * (1.0 - chance[i]))
        words = up if draws[i] * (up + down) < down else -down
        for j, change in ((held, words), (i, -words)):
            moved = chance[j] + change / size[j]
            chance[j] = 0.0 if moved < 1e-9 else 1.0 if moved > 1.0 - 1e-9 else moved
        open_ = [j for j in (held, i) if 0.0 < chance[j] < 1.0]
        held = open_[0] if open_ else None
    return chance, held


def _settle_bucket(bucket: pd.DataFrame) -> pd.DataFrame:
    """One node of the tree: every document that gets settled has an integral chance afterwards."""
    bucket = bucket.sort_values(["source", "doc_id", "size", "mark"], na_position="last", kind="stable")
    node, level = int(bucket["bucket"].iloc[0]), int(bucket["level"].iloc[0])
    draws = np.random.default_rng([SEED, level, node]).random(len(bucket))
    size = bucket["size"].to_numpy(np.float64)
    chance = bucket["chance"].to_numpy(np.float64).copy()
    codes = pd.factorize(bucket["source"], use_na_sentinel=False)[0]
    edges = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True])
    for start, end in zip(edges[:-1], edges[1:]):
        chance[start:end], _ = settle(size[start:end], chance[start:end], draws[start:end])
    return bucket.assign(chance=chance)


def mix_sources(sized: DataFrame) -> DataFrame:
    """Copies of documents from rows ``(doc_id, source, size, mark)``, ``mark`` telling texts apart.

    Gives each row back with ``source_size``, ``target`` (both of its source),
    ``copies`` and ``taken`` (words: size times copies). Copies are the expected number rounded down or
    up, so at most 2. All documents of a source but the last one settle such that its words stay as
    the target says, so what is taken differs from it by less than one
    document. Documents without words have no copies, and sources without words the
    target 0. Null sources are one source, the last; null ids are documents like
    others. Rows are dealt out by a hash of all four columns and taken in their order,
    so reruns agree, also on another cluster; rows that repeat all four are dealt
    out together, and which of them is taken does not matter.
    """
    sized = stored(sized.select("doc_id", "source", "size", "mark"), "sized")
    targets = stored(source_targets(sized), "targets")
    n_buckets = max(1, -(-sized.count() // BUCKET_ROWS))
    named = targets.withColumnRenamed("source", "source_")
    joined = sized.join(named, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    wanted = F.when((F.col("size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        joined.withColumn("wanted", wanted)
        .withColumn("whole", F.floor(F.col("wanted") + 1e-9))
        .withColumn("chance", F.greatest(F.lit(0.0), F.col("wanted") - F.col("whole")))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "source", "size", "mark"), F.lit(n_buckets)))
        .withColumn("level", F.lit(0))
        .withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make nullable longs doubles
        .drop("wanted")
    )
    settled = []
    level = 0
    while True:
        rows = rows.withColumn("level", F.lit(level))
        done = stored(rows.groupBy("bucket").applyInPandas(_settle_bucket, rows.schema), "settled")
        if n_buckets == 1:
            # One fraction a source is left, which a draw of its own rounds.
            draw = F.pmod(F.xxhash64("doc_id", "source", "mark", F.lit(SEED)), F.lit(1 << 32)) / float(1 << 32)
            chance = F.when(F.col("chance").isin(0.0, 1.0), F.col("chance")).otherwise((draw < F.col("chance")).cast("double"))
            settled.append(done.withColumn("chance", chance))
            break
        settled.append(done.filter(F.col("chance").isin(0.0, 1.0)))
        rows = done.filter(~F.col("chance").isin(0.0, 1.0)).withColumn("bucket", F.expr(f"bucket div {FAN_IN}"))
        n_buckets = -(-n_buckets // FAN_IN)
        level += 1
    result = settled[0]
    for more in settled[1:]:
        result = result.unionByName(more)
    copies = (F.col("whole") + F.col("chance")).cast("long")
    return result.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "mark", "size", "source_size", "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def sized_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``(doc_id, source, size, mark)`` of documents: words between white space, a null text has none."""
    words = F.col(text).cast("string")
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(words, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(words).alias("mark"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it, and no other columns.

    A row is known by ``doc_id``, source and text; of rows that agree in these, the
    copies are dealt out in any order.
    """
    place, mark, copies, repeat = (free_name(docs, c) for c in ("place", "mark", "copies", "repeat"))
    keys = ["doc_id", "source", "mark"]
    order = Window.partitionBy(*keys).orderBy("copies")
    counted = mix_sources(sized_documents(docs)).withColumn("place", F.row_number().over(order)).filter("copies > 0")
    counted = counted.select(F.struct(*keys, "place").alias("key"), F.col("copies").alias(copies))
    marked = docs.withColumn(mark, F.xxhash64(F.col("text").cast("string")))
    own = Window.partitionBy("doc_id", "source", mark).orderBy(F.lit(1))
    numbered = marked.withColumn(place, F.row_number().over(own))
    # One struct as the key: a missing part equals a missing one.
    of = F.struct(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col(mark).alias("mark"), F.col(place).alias("place"),
    )
    key = free_name(docs, "key")
    joined = numbered.withColumn(key, of).join(counted.withColumnRenamed("key", key), key)
    repeated = joined.withColumn(repeat, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return repeated.select(*docs.columns)
