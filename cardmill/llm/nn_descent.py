"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node of the graph. The graph starts from blocks: nodes are
sorted by the nearest of some pivots and compared within runs. Each round of the descent
joins every node's neighbours, and some nodes that it is a neighbour of, with their vectors, compares these
with each other where one of them is new, and keeps the nearest of each node. All distances are
between the vectors themselves, in double precision.

A search keeps, for each query, a list of the nearest nodes so far, starting from the query's own node, if it is one, and the
nearest pivots. Each round
follows the edges of the nearest ones not yet followed, in both directions, until a round finds nothing
to follow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .tables import stored

NEIGHBOURS = 30  # of a node in the graph
REVERSE = 30  # nodes that have it as a neighbour, per node, in joins and searches
PIVOTS = 512  # at least, a sample: where blocks start depends on it, and where searches do besides the query's own node
PIVOTS_ROOT = 4  # or as many times the root of the number of nodes
BLOCKINGS = 6
BLOCK_ROWS = 512
ROUNDS = 10
ENOUGH = 0.01  # the descent ends when a round changes fewer edges a node and neighbour
BEAM = 96  # nodes that a search keeps for a query
STEP = 32  # of these that a round follows
SEARCH_ROUNDS = 20
BROADCAST_ROWS = 100_000
CLOSE = 1e-6  # squared distances below this part of the squared norms are taken from differences
DIFFERENCES = 1 << 20  # components of these that are held at once

_EDGE = "node long, near long, distance double, is_new boolean"


def clean_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``(vec_id, vec)`` that take part: ids not null, components finite and not all zero, of the most frequent length."""
    vec = F.col(vector).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vec, lambda x: x != 0.0)
    good = rows.select(F.col(vec_id).cast("long").alias("vec_id"), vec.alias("vec")).filter(
        F.col("vec_id").isNotNull() & finite & some
    )
    length = good.groupBy(F.size("vec").alias("n")).count().agg(F.max_by("n", F.struct("count", "n"))).scalar()
    return good.filter(F.size("vec") == length)


def _members(vectors: DataFrame, kept: int) -> DataFrame:
    """``(node, vec_id, vec, at)``: the first ``kept`` rows of each class of equal vectors; a node is a hash of its vector.

    Classes are cut in the map tasks, so a vector that many rows have is not gathered.
    """
    order = Window.partitionBy("node").orderBy("vec_id")
    named = vectors.select(F.xxhash64("vec").alias("node"), "vec_id", "vec")
    return stored(named.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= kept), "members")


def _pivots(nodes: DataFrame, turn: int) -> tuple[np.ndarray, np.ndarray]:
    wanted = max(PIVOTS, PIVOTS_ROOT * math.isqrt(nodes.count()))
    found = nodes.orderBy(F.xxhash64("node", F.lit(turn)), "node").limit(wanted).collect()
    ids = np.array([row["node"] for row in found], np.int64)
    return ids, np.array([row["vec"] for row in found], np.float64).reshape(len(found), -1 if found else 1)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(out, 0.0)


def _apart(v: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of ``v``; those that products would round away are taken from differences."""
    v = v.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        centred = v - v[len(v) // 2]
        norms = (centred * centred).sum(1)
        both = norms[:, None] + norms[None, :]
        d = both - 2.0 * (centred @ centred.T)
        a, b = np.nonzero(np.triu(~(d > CLOSE * both), 1))
        step = max(1, DIFFERENCES // v.shape[1])
        for start in range(0, len(a), step):
            x, y = a[start : start + step], b[start : start + step]
            d[x, y] = d[y, x] = ((v[x] - v[y]) ** 2).sum(1)
    return d


def _blocked(nodes: DataFrame, turn: int) -> DataFrame:
    """Edges to the nearest within blocks of nodes that share the nearest pivot, or nearly so."""
    _, pivots = _pivots(nodes, turn)
    pivots = nodes.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _squares(_matrix(batch.column(1)), pivots.value)
            nearest = d.argmin(1)
            at = nearest + 1.0 - 1.0 / (1.0 + d[np.arange(len(d)), nearest])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], ["node", "vec", "at"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            while held.num_rows >= 2 * BLOCK_ROWS:
                yield _nearest_in(held.slice(0, BLOCK_ROWS))
                held = held.slice(BLOCK_ROWS)
        if held is not None and held.num_rows:
            yield _nearest_in(held)

    placed = nodes.mapInArrow(place, "node long, vec array<double>, at double")
    return placed.repartitionByRange("at", "node").sortWithinPartitions("at", "node").mapInArrow(compare, _EDGE)


def _nearest_in(block: pa.Table) -> pa.RecordBatch:
    ids = block.column("node").to_numpy()
    d = _apart(_matrix(block.column("vec").combine_chunks()))
    np.fill_diagonal(d, np.inf)
    k = min(NEIGHBOURS, len(ids) - 1)
    at = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.empty((len(ids), 0), np.int64)
    near = np.take_along_axis(d, at, 1)
    return _edges(np.repeat(ids, k), ids[at.ravel()], near.ravel())


def _edges(node: np.ndarray, near: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(node), pa.array(near), pa.array(distance.astype(np.float64)), pa.array(np.ones(len(node), bool))]
    return pa.RecordBatch.from_arrays(columns, ["node", "near", "distance", "is_new"])


def _nearest(edges: DataFrame) -> DataFrame:
    """The nearest ``NEIGHBOURS`` of each node, an edge that was there before being old."""
    one = edges.groupBy("node", "near").agg(F.min("distance").alias("distance"), F.min("is_new").alias("is_new"))
    order = Window.partitionBy("node").orderBy("distance", "near")
    return one.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= NEIGHBOURS).drop("at")


def _reversed(graph: DataFrame) -> DataFrame:
    """Some of the edges the other way round, at most ``REVERSE`` a node, the nearest ones."""
    back = graph.select(F.col("near").alias("node"), F.col("node").alias("near"), "distance", "is_new")
    order = Window.partitionBy("node").orderBy("distance", "near")
    return back.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= REVERSE).drop("at")


def _round(graph: DataFrame, packed: DataFrame, kind: str) -> DataFrame:
    """One round: edges between the neighbours of each node that are nearer than what these have."""
    worst = graph.groupBy("node").agg(F.max("distance").alias("worst"), F.count(F.lit(1)).alias("n"))
    limit = F.when(F.col("n") < NEIGHBOURS, F.lit(float("inf"))).otherwise(F.col("worst"))
    known = packed.join(worst, "node", "left").select(
        F.col("node").alias("near"), "packed", F.coalesce(limit, F.lit(float("inf"))).alias("limit")
    )
    both = graph.unionByName(_reversed(graph)).groupBy("node", "near").agg(F.max("is_new").alias("is_new"))
    around = both.join(known, "near").repartition("node").sortWithinPartitions("node")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            node = held.column("node").to_numpy()
            ready = int(np.searchsorted(node, node[-1]))
            if ready >= 2000:
                yield _joined(held.slice(0, ready), kind)
                held = held.slice(ready)
        if held is not None and held.num_rows:
            yield _joined(held, kind)

    rows = around.select("node", "near", "is_new", "packed", "limit").mapInArrow(join, _EDGE)
    marked = graph.withColumn("is_new", F.lit(False))
    return _nearest(marked.unionByName(rows))


def _joined(rows: pa.RecordBatch, kind: str) -> pa.RecordBatch:
    node, near = rows.column("node").to_numpy(), rows.column("near").to_numpy()
    new = rows.column("is_new").to_numpy(zero_copy_only=False)
    limit = rows.column("limit").to_numpy()
    vectors = _unpacked(rows.column("packed"), kind)
    edges = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])
    found = []
    for start, end in zip(edges[:-1], edges[1:]):
        own = slice(start, end)
        if not new[own].any():
            continue
        d = _apart(vectors[own])
        useful = (d < limit[own][:, None]) & (new[own][:, None] | new[own][None, :])
        np.fill_diagonal(useful, False)
        a, b = np.nonzero(useful)
        if len(a):
            found.append((near[start + a], near[start + b], d[a, b]))
    if not found:
        return _edges(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    a, b, d = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    a, b, d = a[fresh], b[fresh], d[fresh]
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    place = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
    keep = place < NEIGHBOURS
    return _edges(a[keep], b[keep], d[keep])


def _packed(nodes: DataFrame) -> tuple[DataFrame, str]:
    """``(node, packed)`` and the type of the numbers in it: four bytes a component where that holds all of them exactly, else eight."""
    fits = ~F.exists("vec", lambda x: x != x.cast("float").cast("double"))
    kind = "<f4" if nodes.filter(~fits).isEmpty() else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column(1)).astype(kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([row.tobytes() for row in values], pa.binary())], ["node", "packed"]
            )

    return nodes.select("node", "vec").mapInArrow(pack, "node long, packed binary"), kind


def _unpacked(column: pa.Array, kind: str) -> np.ndarray:
    values = np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def neighbour_graph(nodes: DataFrame) -> DataFrame:
    """``(node, near, distance, is_new)``: about the nearest ``NEIGHBOURS`` nodes of each of ``nodes (node, vec)``.

    Distances are squares.
    """
    packed, kind = _packed(nodes)
    packed = stored(packed, "packed")
    blocks = _blocked(nodes, 0)
    for turn in range(1, BLOCKINGS):
        blocks = blocks.unionByName(_blocked(nodes, turn))
    start = stored(blocks.select("node", "near").distinct(), "blocks")
    graph = stored(_nearest(_measured(start, packed, kind)), "graph")
    n_edges = graph.count()
    for _ in range(ROUNDS):
        graph = stored(_round(graph, packed, kind), "graph")
        if graph.filter("is_new").count() <= ENOUGH * n_edges:
            break
    return graph


def _measured(pairs: DataFrame, packed: DataFrame, kind: str) -> DataFrame:
    """Edges with their distances."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_unpacked(batch.column(c), kind) for c in ("packed", "packed_near"))
            with np.errstate(over="ignore"):
                yield _edges(batch.column("node").to_numpy(), batch.column("near").to_numpy(), ((a - b) ** 2).sum(1))

    near = packed.select(F.col("node").alias("near"), F.col("packed").alias("packed_near"))
    joined = pairs.join(packed, "node").join(near, "near")
    return joined.select("node", "near", "packed", "packed_near").mapInArrow(measure, _EDGE)


def _few(rows: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query, node, distance)``: for each of ``queries (query, vec)``, up to ``BEAM`` near nodes, Euclidean.

    A query whose id is that of a node has the node's vector, and starts from it too. With at most ``PIVOTS`` nodes all are compared.
    """
    ids, pivots = _pivots(nodes, 0)
    shared = nodes.sparkSession.sparkContext.broadcast((ids, pivots))
    state_schema = "query long, node long, distance double, followed boolean"

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own = shared.value
        for batch in batches:
            for query, vector in zip(batch.column(0).to_pylist(), _matrix(batch.column(1))):
                d = np.sqrt(((own - vector) ** 2).sum(1))
                at = np.lexsort((own_ids, d))[:BEAM]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([query] * len(at), pa.int64()), pa.array(own_ids[at]), pa.array(d[at]), pa.array([False] * len(at))],
                    ["query", "node", "distance", "followed"],
                )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.sqrt(((_matrix(batch.column(2)) - _matrix(batch.column(3))) ** 2).sum(1)) if batch.num_rows else np.empty(0)
            columns = [batch.column(0), batch.column(1), pa.array(d), pa.array([False] * len(d), pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["query", "node", "distance", "followed"])

    best = Window.partitionBy("query").orderBy("distance", "node")
    queries = stored(queries, "queries")
    itself = queries.join(nodes.select(F.col("node").alias("query")), "query", "left_semi").select(
        "query", F.col("query").alias("node"), F.lit(0.0).alias("distance"), F.lit(False).alias("followed")
    )
    entered = queries.mapInArrow(enter, state_schema).filter("node <> query").unionByName(itself)
    state = stored(entered, "beam")
    links = graph.select("node", "near").unionByName(_reversed(graph).select("node", "near")).distinct()
    links = stored(links, "links")
    for _ in range(SEARCH_ROUNDS):
        open_ = Window.partitionBy("query", "followed").orderBy("distance", "node")
        turned = state.withColumn("turn", F.row_number().over(open_))
        now = ~F.col("followed") & (F.col("turn") <= STEP)
        frontier = stored(turned.filter(now).select("query", "node"), "frontier")
        if frontier.isEmpty():
            break
        reached = links.join(_few(frontier), "node").select("query", F.col("near").alias("node")).distinct()
        fresh = stored(reached.join(state.select("query", "node"), ["query", "node"], "left_anti"), "reached")
        vectors = nodes.join(_few(fresh), "node").join(
            queries.select("query", F.col("vec").alias("query_vec")), "query"
        )
        found = vectors.select("query", "node", "vec", "query_vec").mapInArrow(measure, state_schema)
        after = turned.select("query", "node", "distance", (F.col("followed") | now).alias("followed"))
        ranked = after.unionByName(found).withColumn("at", F.row_number().over(best))
        state = stored(ranked.filter(F.col("at") <= BEAM).drop("at"), "beam")
    return state.drop("followed")


def nearest_neighbours(
    rows: DataFrame, every: int = 100, n_nearest: int = 10, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the nearest found for each row whose id is divisible by ``every``.

    All rows but the query's own are candidates. Scores are Euclidean distances in double
    precision; ties go to the smaller id. Vectors that are null, zero or of another length than most, that hold null or
    non-finite components, or have no id take no part. Equal vectors are all candidates, one class being
    compared once. Repeated rows of an id and vector count once; ids that repeat with other vectors are candidates each. Extra columns are ignored; an
    empty table gives an empty result.
    """
    vectors = stored(clean_vectors(rows, vec_id, vector).distinct(), "vectors")
    members = _members(vectors, n_nearest + 1)
    nodes = stored(members.filter("at = 1").select("node", "vec"), "nodes")
    graph = neighbour_graph(nodes)
    asked = vectors.filter(F.col("vec_id") % every == 0)
    asked = stored(asked.select("vec_id", F.xxhash64("vec").alias("node"), "vec"), "asked")
    queries = asked.select(F.col("node").alias("query"), "vec").distinct()
    found = stored(search(graph, nodes, queries), "found")
    near = found.join(members.select("node", F.col("vec_id").alias("near_id")), "node")
    answers = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).join(near, "query")
    order = Window.partitionBy("query_id").orderBy("distance", "near_id")
    ranked = answers.filter("near_id <> query_id").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= n_nearest).select(
        "query_id", "rank", F.col("near_id").alias("vec_id"), F.col("distance").alias("score")
    )
