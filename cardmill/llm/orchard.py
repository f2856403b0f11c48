"""Centroid clustering: rounds of exact integer k-means whose nearest centroids are found by Orchard's search.

Each centroid has a list of all centroids, sorted by their distance from it. The search for
a vector's centroid walks the list of a candidate, skips what it has visited, and goes over to the list of a closer centroid as soon as
one is found. It stops where the list's distance is strictly beyond twice the candidate's own: by the
triangle inequality nothing further on is as near. A centroid at exactly the same distance is therefore
always seen, and the smaller number wins.

The vectors are written once, as integers. A round reads them, and each task sends the sums of its clusters, so
what reaches the driver is one sum for each centroid and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import free_name, stored

BATCH = 4096  # vectors searched together
# Beyond this squared distances of 64 components would not fit in 64 bits.
LARGEST = 1 << 27


@dataclass(frozen=True)
class Centroids:
    """Centroids with, for each, the others by ascending squared distance (ties: smaller number) and these distances."""

    points: np.ndarray
    order: np.ndarray
    distance: np.ndarray

    @staticmethod
    def of(points: np.ndarray) -> "Centroids":
        d = ((points[:, None, :] - points[None, :, :]) ** 2).sum(2)
        order = np.argsort(d, axis=1, kind="stable")
        return Centroids(points, order, np.take_along_axis(d, order, 1))


def nearest_centroids(vectors: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector the nearest centroid, the squared distance, and how many distances were computed.

    All vectors take a step of their own search at a time; those that have stopped are left out.
    """
    n, k = len(vectors), len(centroids.points)
    rows = np.arange(n)
    best = np.zeros(n, np.int64)
    distance = ((vectors - centroids.points[0]) ** 2).sum(1)
    visited = np.zeros((n, k), bool)
    visited[:, 0] = True
    at = np.zeros(n, np.int64)
    while len(rows):
        own = best[rows]
        here = at[rows]
        ended = here >= k
        ended[~ended] = centroids.distance[own[~ended], here[~ended]] > 4 * distance[rows[~ended]]
        rows, own, here = rows[~ended], own[~ended], here[~ended]
        other = centroids.order[own, here]
        at[rows] += 1
        fresh = ~visited[rows, other]
        looking, other = rows[fresh], other[fresh]
        visited[looking, other] = True
        found = ((vectors[looking] - centroids.points[other]) ** 2).sum(1)
        closer = (found < distance[looking]) | ((found == distance[looking]) & (other < best[looking]))
        moved = looking[closer]
        best[moved], distance[moved], at[moved] = other[closer], found[closer], 0
    return best, distance, visited.sum(1)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def kept_vectors(rows: DataFrame, size: int, scale: int, vec_id: str, vector: str) -> DataFrame:
    """``(vec_id, point)``: vectors of ``size`` finite components, each turned into ``floor(scale * x)``."""
    vec = F.col(vector).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vec, lambda x: F.floor(x * scale).cast("long"))
    large = F.exists(vec, lambda x: F.abs(x) * scale > LARGEST)
    refused = F.raise_error(F.lit(f"a component is beyond {LARGEST} / {scale}: squared distances would not fit in 64 bits"))
    good = rows.filter(vec.isNotNull() & (F.size(vec) == size) & finite)
    point = F.when(large, refused.cast("array<long>")).otherwise(scaled)
    return good.select(F.col(vec_id).cast("long").alias("vec_id"), point.alias("point"))


def first_centroids(points: DataFrame, k: int, size: int) -> np.ndarray:
    """The points of the ``k`` smallest SHA-256 of ``1:<vec_id>``, by hash; equal ids go by their points."""
    named = points.filter("vec_id IS NOT NULL").withColumn("hash", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    rows = named.orderBy("hash", "point").limit(k).collect()
    return np.array([row["point"] for row in rows], np.int64).reshape(len(rows), size)


def _sums(points: DataFrame, centroids: Centroids) -> list[tuple[int, list[int], int]]:
    """``(cluster, sums, n)`` of each cluster that has vectors."""
    shared = points.sparkSession.sparkContext.broadcast(centroids)
    k, size = centroids.points.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                own = _matrix(batch.column(0).slice(start, BATCH), size)
                best = nearest_centroids(own, shared.value)[0]
                np.add.at(sums, best, own)
                counts += np.bincount(best, minlength=k)
        some = np.flatnonzero(counts)
        columns = [pa.array(some.astype(np.int32)), pa.array(list(sums[some]), pa.list_(pa.int64())), pa.array(counts[some])]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "sums", "n"])

    parts = points.select("point").mapInArrow(add, "cluster int, sums array<long>, n long")
    flat = parts.select("cluster", "n", F.posexplode("sums").alias("at", "value"))
    # As decimals, for sums over all tasks may pass 64 bits.
    exact = F.sum(F.col("value").cast("decimal(20,0)")).alias("total")
    out: dict[int, tuple[list[int], int]] = {}
    for row in flat.groupBy("cluster", "at").agg(exact, F.sum("n").alias("n")).collect():
        sums, _ = out.setdefault(row["cluster"], ([0] * size, row["n"]))
        sums[row["at"]] = int(row["total"])
    return [(cluster, sums, n) for cluster, (sums, n) in out.items()]


def _assigned(points: DataFrame, centroids: Centroids) -> DataFrame:
    """``(vec_id, cluster, distance, n_compared)``"""
    shared = points.sparkSession.sparkContext.broadcast(centroids)
    size = centroids.points.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                own = batch.slice(start, BATCH)
                best, distance, compared = nearest_centroids(_matrix(own.column(1), size), shared.value)
                columns = [own.column(0), pa.array(best.astype(np.int32)), pa.array(distance), pa.array(compared.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "n_compared"])

    schema = "vec_id long, cluster int, distance long, n_compared int"
    return points.select("vec_id", "point").mapInArrow(assign, schema)


def cluster_vectors(
    rows: DataFrame,
    k: int = 16,
    rounds: int = 3,
    size: int = 64,
    scale: int = 64,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> tuple[DataFrame, list[list[int]]]:
    """``(vec_id, cluster, distance, n_compared)`` for each vector kept, and the final centroids.

    Kept are vectors of exactly ``size`` components, none null or non-finite, as integers ``floor(scale * x)``; a
    component beyond ``LARGEST`` after that is an error, for distances are 64 bits. Distances are squared and exact,
    ties go to the smaller centroid. The first ``k`` vectors by the SHA-256 of their ids are the first centroids; fewer vectors with
    an id give fewer centroids. Each round replaces a centroid by the floor of its vectors' mean; one without
    vectors stays. Repeated rows are vectors each; rows without an id are clustered, but are no first
    centroids. Extra columns are ignored; without vectors that have an id the result is empty.
    ``k`` bounds what is broadcast and what the driver holds: ``k * (k + size)`` numbers.
    """
    points = stored(kept_vectors(rows, size, scale, vec_id, vector), "points")
    current = first_centroids(points, k, size)
    if not len(current):
        return points.limit(0).selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0 AS n_compared"), []
    for _ in range(rounds):
        current = current.copy()
        for cluster, sums, n in _sums(points, Centroids.of(current)):
            current[cluster] = [total // n for total in sums]
    return _assigned(points, Centroids.of(current)), current.tolist()


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The assignment with ``cluster_inertia``, ``inertia`` and ``centroid_sha256``, the digest of the centroid's components.

    One row for each centroid passes the driver.
    """
    name = free_name(assigned, "total")
    assigned = stored(assigned, "assigned")
    totals = {r["cluster"]: int(r[name]) for r in assigned.groupBy("cluster").agg(F.sum("distance").alias(name)).collect()}
    whole = sum(totals.values())
    sha = lambda point: hashlib.sha256(",".join(map(str, point)).encode()).hexdigest()
    known = [(i, totals.get(i, 0), whole, sha(point)) for i, point in enumerate(centroids)]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    return assigned.join(F.broadcast(assigned.sparkSession.createDataFrame(known, schema)), "cluster")
