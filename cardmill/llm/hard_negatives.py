"""Hard negatives by threshold joins on integer inner products, in the manner of L2AP.

A threshold join finds the rows whose score with an anchor reaches the anchor's threshold. Within
a block of rows, an inverted index holds, for each group of dimensions, the rows and their components; the leading dimensions of a row are
left out as long as their norm keeps below the least threshold over the anchors' norms, since they cannot
reach a threshold by themselves, and rows that are left out altogether are never looked at. Scores are accumulated from the last
dimensions to the first. A pair is given up as soon as what it has and the product of the remaining norms stay
below the threshold; pairs that are left get the rest of their exact score.

Thresholds begin high and are lowered until every window is full: first those of the
nearest rows of an anchor's own label (its positives), then those of the windows between a share of a
positive's score and the score itself. Only anchors with open windows are joined again.

Rows are dealt into blocks by their norms and anchors into packs. A pair of block and pack whose norms cannot
reach any threshold is not joined; every other pair is one small group of a grid, and gives at most
the first rows of each window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import stored

BLOCK_CELLS = 1 << 19  # components of a block of rows
PACK_CELLS = 1 << 17  # components of a pack of anchors
GROUP = 8  # dimensions that the index holds together
SLICE = 256  # anchors that are scored together
FEW = 0.125  # share of the pairs from which on these are finished one by one
SLACK = 1e-9  # of the product of the norms, against rounded bounds
# Thresholds of positives as shares of the anchor's product with itself, then all rows.
POSITIVE_SHARES = (0.75, 0.5, 0.25, 0.0)
# Parts of a positive's score that windows reach down by, before their whole width.
NEGATIVE_PARTS = (0.05, 0.1)
LOWEST, HIGHEST = -(1 << 62), 1 << 62

_BLOCK = "block long, n int, width int, most double, rows binary, ids array<long>, labels array<long>, points binary"
_PACK = "pack long, n int, width int, least double, rows binary, labels array<long>, points binary, windows array<array<struct<at: int, low: bigint, high: bigint>>>"
_FOUND = "anchor long, at int, other long, other_id long, score long"


def labelled_points(rows: DataFrame, scale: int, vec_id: str, vector: str, label: Column) -> DataFrame:
    """``(row, vec_id, label, point, norm, width)``, written: rows that take part, ``row`` being their own number.

    A null label or vector, and a null or non-finite component, leave a row out. Equal rows are one.
    """
    vec = F.col(vector).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    point = F.transform(vec, lambda x: F.floor(x * scale).cast("long"))
    large = F.exists(vec, lambda x: F.abs(x) * scale >= float(1 << 62))
    refused = F.raise_error(F.lit("a component does not fit in 64 bits")).cast("array<long>")
    good = rows.filter(vec.isNotNull() & label.isNotNull() & finite).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.when(large, refused).otherwise(point).alias("point"),
    )
    squares = F.aggregate("point", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    named = good.distinct().withColumn("norm", F.sqrt(squares)).withColumn("width", F.size("point"))
    return stored(named.withColumn("row", F.monotonically_increasing_id()), "labelled")


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _list(column: pa.ChunkedArray) -> pa.Array:
    """One list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), _whole(column))


def _components(column: pa.ChunkedArray) -> bytes:
    return _whole(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes()


def _dealt(vectors: DataFrame, norm: str, cells: int) -> DataFrame:
    """Groups of about ``cells`` components, of one width and of norms within a factor of the root of two."""
    positive = F.when((F.col(norm) > 0) & (F.col(norm) < float("inf")), F.col(norm))
    vectors = vectors.withColumn("class", F.coalesce(F.floor(F.log2(positive) * 2), F.lit(-(1 << 20))).cast("int"))
    sizes = vectors.groupBy("width", "class").agg(F.count(F.lit(1)).alias("size"))
    parts = F.greatest(F.ceil(F.col("size") * F.greatest("width", F.lit(1)) / cells), F.lit(1))
    dealt = vectors.join(sizes, ["width", "class"]).withColumn("part", F.pmod(F.xxhash64("row"), parts.cast("long")))
    return dealt.groupBy("width", "class", "part")


def _blocks(points: DataFrame) -> DataFrame:
    """The rows in blocks of about equal norms; within a block by id, missing ones last."""

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        numbers = rows.column("row").to_numpy()
        columns = {
            "block": [int(numbers.min())],  # numbers are unique, so the least of a block names it
            "n": pa.array([len(numbers)], pa.int32()),
            "width": pa.array([rows.column("width")[0].as_py()], pa.int32()),
            "most": [float(rows.column("norm").to_numpy().max())],
            "rows": [numbers.astype(np.int64).tobytes()],
            "ids": _list(rows.column("vec_id").cast(pa.int64())),
            "labels": _list(rows.column("label").cast(pa.int64())),
            "points": [_components(rows.column("point"))],
        }
        return pa.Table.from_pydict(columns)

    dealt = _dealt(points.select("row", "vec_id", "label", "point", "norm", "width"), "norm", BLOCK_CELLS)
    return stored(dealt.applyInArrow(pack, _BLOCK), "blocks")


def _packs(anchors: DataFrame) -> DataFrame:
    """Anchors ``(row, label, point, norm, width, windows)`` in packs that need rows of about equal norms."""
    window = pa.struct([("at", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])
    windows = pa.list_(pa.list_(window))

    def pack(rows: pa.Table) -> pa.Table:
        numbers = rows.column("row").to_numpy()
        columns = {
            "pack": [int(numbers.min())],
            "n": pa.array([len(numbers)], pa.int32()),
            "width": pa.array([rows.column("width")[0].as_py()], pa.int32()),
            "least": [float(rows.column("reach").to_numpy().min())],
            "rows": [numbers.astype(np.int64).tobytes()],
            "labels": _list(rows.column("label").cast(pa.int64())),
            "points": [_components(rows.column("point"))],
            "windows": pa.array([rows.column("windows").to_pylist()], windows),
        }
        return pa.Table.from_pydict(columns)

    low = F.array_min(F.transform("windows", lambda w: w["low"])).cast("double")
    # The norm that a row must have at least to reach the anchor's lowest threshold.
    never, always = F.lit(float("inf")), F.lit(float("-inf"))
    reach = F.when(low <= 0, always).when(F.col("norm") == 0, never).otherwise(low / F.col("norm") * (1 - SLACK))
    dealt = _dealt(anchors.select("row", "label", "point", "width", "windows", reach.alias("reach")), "reach", PACK_CELLS)
    return stored(dealt.applyInArrow(pack, _PACK), "packs")


def _prefix_norms(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Norms of the dimensions before each edge, by row."""
    squares = np.zeros((len(points), len(edges)))
    squares[:, 1:] = np.cumsum(np.add.reduceat(points * points, edges[:-1], axis=1), axis=1)[:, : len(edges) - 1] if points.shape[1] else 0
    return np.sqrt(squares)


def _index(points: np.ndarray, prefix: np.ndarray, edges: np.ndarray, least: float) -> tuple[list, np.ndarray]:
    """For each group of dimensions the rows that are indexed there and their components, and where each row's index begins.

    Row ``y`` is indexed from the first group whose end has a prefix norm of ``least`` or more.
    """
    begins = (prefix[:, 1:] < least).sum(1) if least > 0 else np.zeros(len(points), np.int64)
    postings = []
    for g in range(len(edges) - 1):
        rows = np.flatnonzero(begins <= g)
        postings.append((rows, points[rows, edges[g] : edges[g + 1]]))
    return postings, begins


def threshold_pairs(
    anchors: np.ndarray, points: np.ndarray, low: np.ndarray, allowed
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, row, score)``: the allowed pairs whose inner product is at least the anchor's ``low``, exactly.

    ``allowed(start, stop)`` is a mask of anchors by rows. Vectors of unequal lengths are compared as if the shorter one ended in zeros.
    """
    width = min(anchors.shape[1], points.shape[1])
    a, y = anchors[:, :width], points[:, :width]
    most = np.sqrt((a.astype(np.float64) ** 2).sum(1)).max(initial=0) * np.sqrt((y.astype(np.float64) ** 2).sum(1)).max(initial=0)
    if most >= float(1 << 62):
        raise ValueError("inner products do not fit in 64 bits")
    kind = np.float64 if most < float(1 << 52) else np.int64  # whole numbers below 2**53 are exact in floating point
    edges = np.r_[np.arange(0, width, GROUP), width] if width else np.array([0])
    af, yf = a.astype(np.float64), y.astype(np.float64)
    a_prefix, y_prefix = _prefix_norms(af, edges), _prefix_norms(yf, edges)
    a_norm, y_norm = np.sqrt((af * af).sum(1)), np.sqrt((yf * yf).sum(1))
    a, y = a.astype(kind), y.astype(kind)
    slack = SLACK * a_norm * y_norm.max(initial=0)
    bound = low.astype(np.float64) - slack
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.where(low <= 0, -np.inf, np.where(a_norm > 0, bound / a_norm, np.inf))
    postings, begins = _index(y, y_prefix, edges, float(reach.min(initial=np.inf)))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(a), SLICE):
        own = slice(start, start + SLICE)
        x, x_prefix, x_bound = a[own], a_prefix[own], bound[own]
        alive = allowed(start, start + len(x)) & (np.outer(a_norm[own], y_norm) >= x_bound[:, None])
        if not width:
            pairs = np.nonzero(alive & (low[own] <= 0)[:, None])
            out.append((pairs[0] + start, pairs[1], np.zeros(len(pairs[0]), np.int64)))
            continue
        # Rows that the index leaves out cannot reach any threshold here.
        alive[:, begins >= len(edges) - 1] = False
        score = np.zeros(alive.shape, kind)
        g = len(edges) - 1
        while g > 0 and alive.mean() > FEW:
            g -= 1
            rows, values = postings[g]
            score[:, rows if len(rows) < len(y) else slice(None)] += x[:, edges[g] : edges[g + 1]] @ values.T
            # A row's dimensions that are not in the index remain, so the bound is that before its index or this group.
            left = np.minimum(np.maximum(begins, g), len(edges) - 1)
            remaining = x_prefix[:, g][:, None] * y_prefix[:, g][None, :]
            later = begins > g
            if later.any():
                remaining[:, later] = x_prefix[:, left[later]] * y_prefix[later, left[later]][None, :]
            alive &= score + remaining >= x_bound[:, None]
        i, j = np.nonzero(alive)
        done = np.minimum(np.maximum(begins[j], g), len(edges) - 1)  # groups from here on are in the score
        total = score[i, j]
        for group in range(len(edges) - 2, -1, -1):
            keep = total + x_prefix[i, np.minimum(group + 1, done)] * y_prefix[j, np.minimum(group + 1, done)] >= x_bound[i]
            i, j, done, total = i[keep], j[keep], done[keep], total[keep]
            need = done > group
            part = slice(edges[group], edges[group + 1])
            total[need] += (x[i[need], part] * y[j[need], part]).sum(1)
        exact = total.astype(np.int64)
        keep = exact >= low[own][i]
        out.append((i[keep] + start, j[keep], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def _grid_group(same: bool, most: int):
    """Joins one block with one pack: for each window the first ``most`` rows of the block."""

    def join(blocks: pa.Table, packs: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], [], [], []]
        for block in blocks.to_batches():
            for b in range(block.num_rows):
                for pack in packs.to_batches():
                    for p in range(pack.num_rows):
                        for column, values in zip(found, _first_of_windows(block.slice(b, 1), pack.slice(p, 1), same, most)):
                            column.append(values)
        columns = [pa.concat_arrays(c) if c else pa.array([], pa.int64()) for c in found]
        return pa.Table.from_arrays([columns[0], columns[1].cast(pa.int32()), *columns[2:]], ["anchor", "at", "other", "other_id", "score"])

    return join


def _cell(record: pa.RecordBatch, name: str):
    return record.column(record.schema.get_field_index(name))[0]


def _vectors(record: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width = _cell(record, "n").as_py(), _cell(record, "width").as_py()
    rows = np.frombuffer(_cell(record, "rows").as_py(), np.int64)
    labels = _cell(record, "labels").values.to_numpy()
    return rows, labels, np.frombuffer(_cell(record, "points").as_py(), np.int64).reshape(n, width)


def _first_of_windows(block: pa.RecordBatch, pack: pa.RecordBatch, same: bool, most: int) -> list[pa.Array]:
    rows, labels, points = _vectors(block)
    own, own_labels, anchors = _vectors(pack)
    windows = _cell(pack, "windows").as_py()
    widest = max((len(w) for w in windows), default=0)
    at = np.zeros((len(own), widest), np.int64)
    low, high = np.full((len(own), widest), HIGHEST), np.full((len(own), widest), LOWEST)
    for i, list_ in enumerate(windows):
        for w, window in enumerate(list_):
            at[i, w], low[i, w], high[i, w] = window["at"], window["low"], window["high"]

    def allowed(start: int, stop: int) -> np.ndarray:
        alike = own_labels[start:stop, None] == labels[None, :]
        return (alike & (own[start:stop, None] != rows[None, :])) if same else ~alike

    a, y, score = threshold_pairs(anchors, points, low.min(1, initial=HIGHEST), allowed)
    order = np.lexsort((y, -score, a))  # rows of a block are in the order of their ids
    a, y, score = a[order], y[order], score[order]
    taken = []
    for w in range(widest):
        inside = np.flatnonzero((score >= low[a, w]) & (score <= high[a, w]))
        first = np.flatnonzero(np.r_[True, a[inside][1:] != a[inside][:-1]]) if len(inside) else np.empty(0, np.int64)
        place = np.arange(len(inside)) - np.repeat(first, np.diff(np.r_[first, len(inside)]))
        inside = inside[place < most]
        taken.append((a[inside], np.full(len(inside), w), y[inside], score[inside]))
    a, w, y, score = (np.concatenate(x) for x in zip(*taken)) if taken else (np.empty(0, np.int64),) * 4
    ids = _cell(block, "ids").values.take(pa.array(y))
    return [pa.array(own[a]), pa.array(at[a, w]), pa.array(rows[y]), ids, pa.array(score)]


def threshold_join(blocks: DataFrame, anchors: DataFrame, same: bool, most: int) -> DataFrame:
    """``(anchor, at, other, other_id, score)``: the first ``most`` rows of each window of ``anchors``.

    ``same`` takes rows of the anchor's label but the anchor, otherwise rows of other labels. Higher scores come
    first, then smaller ids, missing ones last.
    """
    packs = _packs(anchors)
    # Which block meets which pack, from two narrow lists that have a row for thousands of vectors.
    grid = blocks.select("block", "most").join(packs.select("pack", "least"), F.col("most") >= F.col("least")).select("block", "pack")
    left = grid.join(blocks, "block").groupBy("block", "pack")
    right = grid.select(F.col("block").alias("to"), F.col("pack").alias("of")).join(packs, F.col("of") == F.col("pack")).groupBy("to", "of")
    found = left.cogroup(right).applyInArrow(_grid_group(same, most), _FOUND)
    order = Window.partitionBy("anchor", "at").orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def _rounds(blocks: DataFrame, anchors: DataFrame, windows: DataFrame, lows: list[Column], same: bool, most: int) -> DataFrame:
    """The first rows of ``windows (anchor, at, high, ...)``, whose thresholds are lowered in turn while they hold fewer than ``most``."""
    results, open_ = [], windows
    for turn, low in enumerate(lows):
        asked = open_.groupBy("anchor").agg(F.collect_list(F.struct("at", low.alias("low"), "high")).alias("windows"))
        joined = anchors.join(asked.withColumnRenamed("anchor", "row"), "row")
        found = stored(threshold_join(blocks, joined, same, most), "found")
        if turn == len(lows) - 1:
            results.append(found)
            break
        full = found.groupBy("anchor", "at").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most).select("anchor", "at")
        results.append(found.join(full, ["anchor", "at"], "left_semi"))
        open_ = stored(open_.join(full, ["anchor", "at"], "left_anti"), "open")
        if open_.isEmpty():
            break
    out = results[0]
    for rows in results[1:]:
        out = out.unionByName(rows)
    return out


def hard_negatives(
    rows: DataFrame,
    every: int = 100,
    n_positives: int = 5,
    n_negatives: int = 5,
    scale: int = 256,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for rows whose id is divisible by ``every``.

    Scores are inner products of the components as integers ``floor(scale * x)``; higher ones come first, ties go to the smaller
    id, missing ids last. An anchor's positives are its first other rows of its label, its negatives for each
    of these the first rows of other labels that score from 80 to 100 percent of the positive's score. All rows are
    searched, and results are exact. A row takes no part if its label, its vector or a component is null, or a component is not finite. Vectors of unequal
    lengths are compared as if the shorter one ended in zeros. Rows that are equal in id, label and vector
    count once; rows that share only the id are rows of their own, as are those without one, which are no anchors. An empty vector
    scores 0 with all. Scores beyond 62 bits are an error. Extra columns are ignored; an empty table gives an empty result.
    """
    label = F.col(label) if isinstance(label, str) else label
    points = labelled_points(rows, scale, vec_id, vector, label)
    blocks = _blocks(points)
    anchors = stored(points.filter(F.col("vec_id") % every == 0), "anchors")

    own = F.col("norm") * F.col("norm")
    lows = [F.floor(own * share).cast("long") for share in POSITIVE_SHARES] + [F.lit(LOWEST)]
    whole = anchors.select(F.col("row").alias("anchor"), F.lit(0).alias("at"), F.lit(HIGHEST).alias("high"), "norm")
    positives = stored(
        _rounds(blocks, anchors, whole, lows, True, n_positives).select(
            "anchor", F.col("place").alias("at"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")
        ),
        "positives",
    )
    high = F.col("high")
    # 80 * high <= 100 * score for whole numbers; a negative score has no window.
    parts = [high - F.floor(high * part).cast("long") for part in NEGATIVE_PARTS] + [high - F.expr("high div 5")]
    windows = positives.filter("positive_score >= 0").select("anchor", "at", F.col("positive_score").alias("high"))
    negatives = _rounds(blocks, anchors, windows, parts, False, n_negatives)
    found = negatives.select("anchor", "at", F.col("place").alias("rank"), F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(positives, ["anchor", "at"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
