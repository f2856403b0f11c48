"""Near-duplicate documents by word shingles: an exact Jaccard join on PartEnum signatures.

Two documents link when the Jaccard similarity of their sets of five-word
shingles is at least 3/4. Sets of sizes a and b that link differ in at most
(a + b) / 7 shingles. Sizes are cut into bands, each 4/3 of the one before; a
set takes part in the instance of its own band and in that of the next, where
it meets larger partners. An instance deals the domain of shingles into
partitions by hash; a set has a signature for each partition that is not
empty: the partition and all it holds. Partners differ in at most k of the
partitions, k being the most that the set's own size allows, so a set with k + 1 partitions in use agrees with each partner in
one of them at least. Where too few are in use, the set also takes part in a
further level with more partitions, until enough are.

Signatures of up to ``PAIRED`` sets give pairs, at most (PAIRED - 1) / 2 a row. A signature
with more sets, such as that of a common line, is not used by a set that still has k + 1 others. Sets that lack these
take part once more with several times the partitions, of which more can be spared. Those
that still lack them are mostly members of large groups of copies. They are compared with some centres of
each such signature. Where its sets are then of several components, all sets that such signatures
connect are compared in pairs of blocks of ``BLOCK`` sets, but for pairs within the largest component.

Pairs are compared on counts of shingles in hash buckets, whose distance is never
above that of the sets, and those that may link on the sets themselves.
Shingles are held as hashes of 64 bits, sets in the last comparison as hashes
of 48 bits, and documents with equal sets are one node, known by a hash of 64 bits.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .components import components
from .tables import free_name, stored

SHINGLE_WORDS = 5
PAIRED = 16  # sets of a signature that are all paired
BLOCK = 256
CENTRES = 6  # sets of a larger signature that all others are compared with
MORE_PARTITIONS = 1.1  # partitions for each one that is needed
LEVEL_GROWTH = 1.25
FINE_PARTITIONS = 3  # times as many at the fine level
FINE_LEVEL = 32  # number of the first fine level
EMIT_ROWS = 100_000
NO_ID = -(2**63)  # stands for a missing id in joins
BLOCK_BITS = 1 << 15  # of the filter of wanted documents: what Spark's bitmaps hold
MOST_BLOCKS = 1 << 12  # 16 MB
KEY_BITS = 16  # for each key, for about one false answer in four hundred
PROBES = 4

_STEP = np.uint64(0x9E3779B97F4A7C15)
_EMITTED = "sig long, node long, tag int, payload binary"
_EMITTED_NAMES = ["sig", "node", "tag", "payload"]
_GROUPED = "a long, b long, tag int, payload binary, kind string"


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    width = min(SHINGLE_WORDS, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = out * _STEP + hashes[j : n + j]
    return np.unique(_mix(out))


def _band_ends() -> np.ndarray:
    ends = [1]
    while ends[-1] < 2**40:
        ends.append((ends[-1] + 1) * 4 // 3)
    return np.array(ends, dtype=np.int64)


_ENDS = _band_ends()


def _level_signatures(shingles: np.ndarray, instance: int, n_parts: int, level: int) -> np.ndarray:
    mixed = _mix(shingles + np.uint64((level + 1) * 0x51ED2701))
    part = ((mixed >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)
    content = np.zeros(n_parts, np.uint64)
    np.add.at(content, part, mixed)
    used = np.flatnonzero(np.bincount(part, minlength=n_parts))
    return _mix(content[used] + used.astype(np.uint64) * _STEP + np.uint64(instance * 64 + level))


def signatures(shingles: np.ndarray, fine: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set that is not empty, and for each its tag: spare * 64 + level * 2 + upper.

    ``spare``: how many of the signatures of this instance and level the set can do without.
    ``fine``: at a level of its own with several times the partitions, so that much can be spared.
    """
    n = len(shingles)
    band = int(np.searchsorted(_ENDS, n))
    end = int(_ENDS[band])
    instances = [(band, (n + min(end, 4 * n // 3)) // 7)]
    if 4 * n >= 3 * (end + 1):
        instances.append((band + 1, n // 3))
    sigs, tags = [], []
    for instance, k in instances:
        most = 2 * int(_ENDS[instance]) // 7  # as many partitions for all sets of the instance
        for level in range(FINE_LEVEL if fine else 0, FINE_LEVEL * (1 + fine)):
            growth = MORE_PARTITIONS * LEVEL_GROWTH ** (level % FINE_LEVEL) * (FINE_PARTITIONS if fine else 1)
            own = _level_signatures(shingles, instance, 1 if most == 0 else int((most + 1) * growth) + 1, level)
            sigs.append(own)
            spare = len(own) - (k + 1)
            tags.append(np.full(len(own), max(0, spare) * 64 + (level % FINE_LEVEL) * 2 + (instance != band), np.int32))
            if spare >= 0:
                break
    return np.concatenate(sigs), np.concatenate(tags)


def sketch(shingles: np.ndarray) -> bytes:
    """Counts of the shingles in about an eighth as many hash buckets, a power of two, at most 255 each."""
    buckets = 1 << max(3, (len(shingles) // 8).bit_length())
    counts = np.bincount((shingles & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _may_link(n_a: int, n_b: int, sketch_a: bytes, sketch_b: bytes) -> bool:
    """False only if the sets cannot link. Capped counts only come closer, folded ones too."""
    if 4 * min(n_a, n_b) < 3 * max(n_a, n_b):
        return False
    a, b = (np.frombuffer(s, np.uint8).astype(np.int64) for s in (sketch_a, sketch_b))
    while len(a) > len(b):
        a = np.minimum(a.reshape(2, -1).sum(axis=0), 255)
    while len(b) > len(a):
        b = np.minimum(b.reshape(2, -1).sum(axis=0), 255)
    return 7 * int(np.abs(a - b).sum()) <= n_a + n_b


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _node(shingles: np.ndarray) -> int:
    salted = _mix(shingles + np.uint64(0x2545F491))
    value = _mix(np.array([np.add.reduce(salted)], np.uint64) + np.uint64(len(shingles)))
    return int(value.view(np.int64)[0])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with a payload for each document, and a row for each signature of a set new to this task."""
    seen: set[int] = set()
    sigs, nodes, tags, payloads = [], [], [], []
    rows = 0

    def take() -> pa.RecordBatch:
        arrays = [np.concatenate(x) for x in (sigs, nodes, tags)]
        values = pa.array([p for run in payloads for p in run], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(arrays[0].view(np.int64)), pa.array(arrays[1]), pa.array(arrays[2]), values],
            _EMITTED_NAMES,
        )

    for batch in batches:
        for doc_id, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            shingles = shingle_set(text)
            node = _node(shingles) if len(shingles) else 0
            own = struct.pack("<?qqi", doc_id is not None, doc_id or 0, mark, len(shingles)) + sketch(shingles)
            found, own_tags = np.empty(0, np.uint64), np.empty(0, np.int32)
            if len(shingles) and node not in seen:
                found, own_tags = signatures(shingles)
                if len(seen) < 1_000_000:
                    seen.add(node)
            sigs.append(np.r_[np.array([mark], np.int64).view(np.uint64), found])
            nodes.append(np.full(len(found) + 1, node, np.int64))
            tags.append(np.r_[np.array([-1], np.int32), own_tags])
            payloads.append([own, *[None] * len(found)])
            rows += len(found) + 1
            if rows >= EMIT_ROWS:
                yield take()
                sigs, nodes, tags, payloads, rows = [], [], [], [], 0
    if rows:
        yield take()


def _pairs(sig: np.ndarray, node: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within groups, both as columns of (a, b): those with the first of the group, and the rest."""
    first = np.r_[True, sig[1:] != sig[:-1]]
    star, rest = [], []
    for step in range(1, int(size.max(initial=1))):
        at = np.flatnonzero(sig[step:] == sig[:-step])
        if not len(at):
            break
        pair = np.stack([node[at], node[at + step]], axis=1)
        star.append(pair[first[at]])
        rest.append(pair[~first[at]])
    none = np.empty((0, 2), np.int64)
    star, rest = (np.concatenate([none, *x]) for x in (star, rest))
    return tuple(np.unique(x, axis=0) if len(x) else x for x in (star, rest))


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by signature to documents, pairs, and the members of signatures with many sets."""

    def out(a, b, tag, kind: str, payload=None) -> pa.RecordBatch:
        n = len(a)
        payload = pa.nulls(n, pa.binary()) if payload is None else payload
        tag = np.zeros(n, np.int32) if tag is None else tag
        columns = [pa.array(a), pa.array(b), pa.array(tag), payload, pa.array([kind] * n, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "tag", "payload", "kind"])

    def grouped(sig, node, tag) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        sizes = np.diff(np.r_[starts, len(sig)])
        size = np.repeat(sizes, sizes)
        large = size > PAIRED
        if last_large is not None:
            large |= sig == last_large
        if large.any():
            yield out(sig[large], node[large], tag[large], "large")
        some = ~large & (size > 1)
        if some.any():
            for pairs, kind in zip(_pairs(sig[some], node[some], size[some]), ("star", "rest")):
                if len(pairs):
                    yield out(pairs[:, 0], pairs[:, 1], None, kind)

    held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))
    last_large = None
    for batch in batches:
        sig, node, tag = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        documents = tag < 0
        if documents.any():
            payload = batch.column(3).filter(pa.array(documents))
            yield out(sig[documents], node[documents], None, "document", payload)
        sig, node, tag = (np.r_[h, x[~documents]] for h, x in zip(held, (sig, node, tag)))
        if not len(sig):
            continue
        last = batch.column(0)[-1].as_py()
        same = sig[1:] == sig[:-1]  # a signature of one row is done, but for the last
        several = np.r_[False, same] | np.r_[same, False] | (sig == last)
        if last_large is not None:
            several |= sig == last_large
        sig, node, tag = sig[several], node[several], tag[several]
        if not len(sig):
            held = (sig, node, tag)
            continue
        order = np.lexsort((tag, node, sig))
        sig, node, tag = sig[order], node[order], tag[order]
        fresh = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
        sig, node, tag = sig[fresh], node[fresh], tag[fresh]
        end = sig == last  # may go on in the next batch
        yield from grouped(sig[~end], node[~end], tag[~end])
        if end.sum() > PAIRED or last == last_large:
            last_large = last
            yield from grouped(sig[end], node[end], tag[end])
            held = (sig[:0], node[:0], tag[:0])
        else:
            held = (sig[end], node[end], tag[end])
    if len(held[0]):
        yield from grouped(*held)


def _nodes(documents: DataFrame) -> DataFrame:
    """A row for each distinct set: its size, its sketch, and the id and mark of a document that has it."""
    one = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("one")
    sets = documents.filter("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"), one)
    return sets.select("node", "n", "sketch", "one.doc_id", "one.mark")


def _documents(grouped: DataFrame) -> DataFrame:
    """The rows of ``kind`` document with their payloads taken apart: every row of the input."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = struct.Struct("<?qqi")
        for batch in batches:
            heads = [head.unpack_from(p) for p in batch["payload"]]
            yield pd.DataFrame(
                {
                    "doc_id": pd.array([h[1] if h[0] else None for h in heads], dtype="Int64"),
                    "mark": np.array([h[2] for h in heads], np.int64),
                    "node": batch["b"].to_numpy(),
                    "n": np.array([h[3] for h in heads], np.int64),
                    "sketch": [bytes(p[head.size :]) for p in batch["payload"]],
                }
            )

    rows = grouped.filter("kind = 'document'").select("b", "payload")
    return rows.mapInPandas(parts, "doc_id long, mark long, node long, n long, sketch binary")


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sizes and sketches let them link."""
    fields = ("n", "sketch")
    side = lambda x: nodes.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in fields))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = (batch[c] for c in ("n_a", "n_b", "sketch_a", "sketch_b"))
            yield batch.loc[[_may_link(*x) for x in zip(*columns)], ["a", "b"]]

    known = pairs.join(side("a"), "a").join(side("b"), "b")
    close = known.filter("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
    return close.mapInPandas(keep, "a long, b long")


def _maybe_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents whose ``(of, mark)`` is in ``keys``, a stored table, and few others.

    Goes by a Bloom filter in blocks, of which a key has one. Beyond the most blocks more other documents pass.
    """
    of = ["of", "mark"]
    n_blocks = min(max(1, math.ceil(keys.count() * KEY_BITS / BLOCK_BITS)), MOST_BLOCKS)
    block = F.pmod(F.xxhash64(*of), F.lit(n_blocks))
    places = [F.pmod(F.xxhash64(*of, F.lit(i)), F.lit(BLOCK_BITS)) for i in range(PROBES)]
    bits = keys.select(block.alias("block"), F.explode(F.array(*places)).alias("at"))
    blocks = bits.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))
    held = block == F.col("block")
    for at in places:
        byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        held = held & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return docs.join(F.broadcast(blocks), held, "left_semi")


def _made_of(docs: DataFrame, wanted: DataFrame, nodes: DataFrame, made: Callable[[np.ndarray], bytes]) -> DataFrame:
    """``(node, packed)``: what ``made`` gives for the set of each wanted node. Only documents that may have it are read as sets."""
    of = F.coalesce("doc_id", F.lit(NO_ID)).alias("of")
    named = stored(wanted.join(nodes, "node").select(of, "mark"), "named")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, packed = [], []
            for text in batch.column(0):
                shingles = shingle_set(text.as_py())
                if len(shingles):
                    found.append(_node(shingles))
                    packed.append(made(shingles))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(packed, pa.binary())], ["node", "packed"])

    texts = _maybe_of(docs.select(of, "mark", "text"), named).select("text")
    rows = texts.mapInArrow(sets, "node long, packed binary").dropDuplicates(["node"])
    return rows.join(wanted, "node", "left_semi")


def _sets_of(docs: DataFrame, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, packed)``: the set of each wanted node."""

    def short(shingles: np.ndarray) -> bytes:
        return np.unique(shingles & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()

    return stored(_made_of(docs, wanted, nodes, short), "sets")


def _unpacked(packed: bytes) -> np.ndarray:
    rows = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, :6] = rows
    return wide.view(np.uint64).ravel()


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that link, by their sets, which only the documents of these pairs are read again for."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    found = _sets_of(docs, wanted, nodes)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sets_a, sets_b = batch.column(2), batch.column(3)
            keep = [
                i for i in range(len(a)) if _linked(_unpacked(sets_a[i].as_py()), _unpacked(sets_b[i].as_py()))
            ]
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array([a[i] for i in keep], pa.int64()), "b": pa.array([b[i] for i in keep], pa.int64())}
            )

    both = pairs.join(found.select(F.col("node").alias("b"), F.col("packed").alias("set_b")), "b").join(
        found.select(F.col("node").alias("a"), F.col("packed").alias("set_a")), "a"
    )
    return both.select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long")


def _needed(large: DataFrame) -> DataFrame:
    """Rows ``(sig, node)`` of signatures with many sets, for the sets that cannot do without them."""
    own = Window.partitionBy("node", "tag")
    rows = large.select(F.col("a").alias("sig"), F.col("b").alias("node"), "tag").distinct()
    lost = rows.withColumn("n_lost", F.count(F.lit(1)).over(own))
    return lost.filter(F.col("n_lost") > F.shiftright("tag", 6)).select("sig", "node")


def _centred(needed: DataFrame) -> DataFrame:
    """The sets of each signature with some centres of it.

    The same sets tend to be centres everywhere, so there are few distinct pairs.
    """
    by = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("by"), "node"))["node"] for k in range(CENTRES)]
    centres = needed.groupBy("sig").agg(F.array_distinct(F.array(*by)).alias("centres"))
    pairs = needed.join(centres.select("sig", F.explode("centres").alias("a")), "sig")
    return _ordered(pairs.select("a", F.col("node").alias("b")))


def _mixed(needed: DataFrame, roots: DataFrame) -> DataFrame:
    """``(sig, node, root)`` of the signatures whose sets are of several components."""
    placed = needed.join(roots, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y")
    return placed.join(mixed.select("sig"), "sig")


def _fine(docs: DataFrame, needed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs and members of large signatures, as from ``_group``, of the needed sets at the fine level."""
    wanted = stored(needed.select("node").distinct(), "wanted")

    def made(shingles: np.ndarray) -> bytes:
        sigs, tags = signatures(shingles, fine=True)
        return sigs.tobytes() + tags.tobytes()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(packed) // 12
                sigs, tags = np.frombuffer(packed, np.int64, n), np.frombuffer(packed, np.int32, n, 8 * n)
                columns = [pa.array(sigs), pa.array(np.full(n, node)), pa.array(tags)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.binary())], _EMITTED_NAMES)

    again = _made_of(docs, wanted, nodes, made)
    emitted = again.mapInArrow(emit, _EMITTED).repartition("sig").sortWithinPartitions("sig")
    return stored(emitted.mapInArrow(_group, _GROUPED), "grouped", by="kind")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs with the smaller node as ``a``."""
    a, b = F.least("a", "b"), F.greatest("a", "b")
    return pairs.select(a.alias("a"), b.alias("b")).filter("a <> b").distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that no path of links joins yet."""
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return joined.filter("NOT (root_a <=> root_b) OR root_a IS NULL").select("a", "b")


def _cross(docs: DataFrame, needed: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between sets that signatures they need connect and that are of different components."""
    placed = stored(_mixed(needed, roots), "mixed")
    least = placed.groupBy("sig").agg(F.min("node").alias("a"))
    chains = placed.join(least, "sig").select("a", F.col("node").alias("b")).distinct()
    clusters = components(chains).withColumnRenamed("root", "cluster")
    of_root = placed.select("node", "root").distinct()
    members = stored(clusters.join(of_root, "node"), "members")
    # The sets of the largest component of a cluster have blocks of their own, after those of the others.
    sizes = members.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("cluster").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all")
    )
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    dealt = members.join(largest, "cluster").select(
        "cluster", "node", "root", (F.col("root") == F.col("main")).alias("is_main"),
        blocks(F.col("n_main")).alias("n_main"), blocks(F.col("n_all") - F.col("n_main")).alias("n_other"),
    )
    own = F.when(F.col("is_main"), F.col("n_other") + F.pmod(F.xxhash64("node"), "n_main")).otherwise(
        F.pmod(F.xxhash64("node"), F.greatest("n_other", F.lit(1)))
    )
    last = F.when(F.col("is_main"), F.col("n_other")).otherwise(F.col("n_other") + F.col("n_main")) - 1
    other = F.explode(F.sequence(F.lit(0), last.cast("long"))).alias("other")
    pairs = dealt.withColumn("own", own.cast("long")).select("cluster", "node", "root", "own", other)
    sets = _sets_of(docs, stored(members.select("node").distinct(), "wanted"), nodes)
    rows = pairs.select("cluster", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "root")
    together = rows.join(sets, "node").repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")
    columns = together.select("cluster", "x", "y", "node", "root", "packed")
    return columns.mapInArrow(_compare_blocks, "a long, b long")


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of pairs of blocks to links that connect the components in each pair."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if row[:3] != key:
                if held:
                    yield _block_links(held)
                key, held = row[:3], []
            held.append(row[3:])
    if held:
        yield _block_links(held)


def _block_links(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    sets = [_unpacked(packed) for _, _, packed in rows]
    sizes = np.array([len(s) for s in sets])
    _, feature, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[feature] > 1
    column = (np.cumsum(counts > 1) - 1)[feature[shared]]
    row = np.repeat(np.arange(len(sets)), sizes)[shared]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        at = slice(*np.searchsorted(column, (start, start + width)))
        part = np.zeros((len(sets), width), np.float32)
        part[row[at], column[at] - start] = 1.0
        both += part @ part.T
    both = np.rint(both).astype(np.int64)
    linked = np.triu(100 * both >= 75 * (sizes[:, None] + sizes[None, :] - both), 1)
    parent = {root: root for _, root, _ in rows}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []
    for i, j in zip(*np.nonzero(linked)):
        x, y = top(rows[i][1]), top(rows[j][1])
        if x != y:
            parent[x] = y
            found.append((rows[i][0], rows[j][0]))
    return pa.RecordBatch.from_pydict(
        {"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())}
    )


def shingle_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, mark, n_shingles, component_id)`` for each row of ``docs``.

    ``mark`` is ``xxhash64`` of the text, 42 for null. ``component_id`` is the smallest
    ``doc_id`` reachable by links, itself included. Words are runs without ASCII
    white space, A-Z lower-cased; a text of fewer than five words is one shingle.
    A null or empty text, or one of white space only, has no shingles and links with nothing: its
    component is its own ``doc_id``. Equal texts link. Rows that repeat a ``doc_id`` are
    each compared by their own text. A row without ``doc_id`` links like others,
    and has a null component if nothing that it reaches has a ``doc_id``. Extra
    columns are ignored. An empty table gives an empty result.
    """
    return _rooted(docs, doc_id, text).drop("root")


def _rooted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``shingle_components`` with the ``root`` of each component, which no other has even if ids repeat."""
    words = F.col(text).cast("string")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(words).alias("mark"), words.alias("text"))
    emitted = docs.mapInArrow(_emit, _EMITTED).repartition("sig").sortWithinPartitions("sig")
    grouped = stored(emitted.mapInArrow(_group, _GROUPED), "grouped", by="kind")
    documents = stored(_documents(grouped), "documents")
    nodes = stored(_nodes(documents), "nodes")
    needed = stored(_needed(grouped.filter("kind = 'large'")), "needed")
    fine = _fine(docs, needed, nodes)
    needed = stored(_needed(fine.filter("kind = 'large'")), "needed")
    pairs_of = lambda kind: _ordered(
        grouped.unionByName(fine).filter(F.col("kind") == kind).select("a", "b")
    )
    verify = lambda pairs: _verified(docs, stored(_likely(pairs, nodes), "likely"), nodes)
    links = stored(verify(_ordered(pairs_of("star").unionByName(_centred(needed)))), "links")
    roots = stored(components(links), "roots")
    more = verify(_apart(pairs_of("rest"), roots)).unionByName(_cross(docs, needed, roots, nodes))
    roots = stored(components(links.unionByName(more)), "roots")

    named = nodes.select("node", "doc_id").join(roots, "node", "left")
    least = named.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("doc_id").alias("component_id"))
    labels = named.select("node", F.coalesce("root", "node").alias("root")).join(least, "root")
    labelled = documents.join(labels, "node", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return labelled.select("doc_id", "mark", F.col("n").alias("n_shingles"), component.alias("component_id"), "root")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that with its smallest ``doc_id``, whatever other components hold that id too.

    Documents without shingles stay, and so do those of components in which no document has an id. Of rows that
    repeat the document that stays, one stays.
    """
    mark = free_name(docs, "mark")
    labelled = _rooted(docs).withColumn("of", F.coalesce("doc_id", F.lit(NO_ID)))
    labelled = stored(labelled.filter("n_shingles > 0 AND component_id IS NOT NULL"), "labelled")
    winners = labelled.filter("doc_id = component_id").groupBy("root").agg(F.min("mark").alias("best"))
    rows = labelled.groupBy("root", "component_id", "of", "mark").agg(F.count(F.lit(1)).alias("n")).join(winners, "root")
    stays = (F.col("of") == F.col("component_id")) & (F.col("mark") == F.col("best"))
    decided = stored(rows.select("of", "mark", "n", stays.alias("stays")), "decided")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col("of__"), F.col(mark) == F.col("mark__")]
    named = lambda rows: rows.select(F.col("of").alias("of__"), F.col("mark").alias("mark__"))
    marked = docs.withColumn(mark, F.xxhash64(F.col("text").cast("string")))
    kept = marked.join(named(decided.filter("NOT stays")), key, "left_anti")
    repeated = stored(decided.filter("stays AND n > 1").select("of", "mark"), "repeated")
    if not repeated.isEmpty():
        again = kept.join(named(repeated), key, "left_semi").dropDuplicates(["doc_id", mark])
        kept = kept.join(named(repeated), key, "left_anti").unionByName(again)
    return kept.drop(mark)
