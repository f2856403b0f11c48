"""Byte-level BPE: encoding by ranked merges of byte strings, and decoding.

Texts are cut into words by the tokenizer's pattern where they lie, in chunks of bounded size. A chunk has each of its words
once and keeps the place of every word of its texts as a number. The merges are folded over the bytes of all words of a chunk at
once: words of about one length are the columns of a matrix, and each step merges in every column the pair of the lowest
rank. The places then give the ids of each text. Nothing is shuffled, written or gathered; a task holds one chunk.

Decoding is done by Spark. Its bytes are strings in which each character is one byte (ISO 8859-1).
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

NO_RANK = 1 << 20  # above all ranks
PLACES = 1 << 10  # above the length of a word that is folded
NONE = NO_RANK * PLACES  # where no pair with a rank starts
CODE_BITS = 21  # of a part: its rank, or NO_RANK and the byte if the vocabulary lacks it
DEAD = (1 << CODE_BITS) - 1  # where no part starts
CHUNK_CHARS = 32 << 20
LONG_WORD = 512  # bytes; a fold is quadratic, so longer words are merged with a heap
FOLD_CELLS = 1 << 18  # bytes of words that are folded at once
EMIT_IDS = 1 << 19

_IDS = "doc_id long, ids array<int>"


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    if max(ranks.values(), default=0) >= NO_RANK:
        raise ValueError(f"{path} has more than {NO_RANK} ranks")
    return ranks


def _byte_string(data: bytes) -> str:
    return data.decode("latin-1")


class Merges(NamedTuple):
    """The merges of a vocabulary as arrays."""

    pairs: np.ndarray  # the codes of two parts as one number, ascending
    made: np.ndarray  # the rank of what they make
    codes: np.ndarray  # of the 256 bytes
    first: np.ndarray  # the rank of any two bytes

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of parts, ``NO_RANK`` for those without."""
        pair = left.astype(np.int64) << CODE_BITS | right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.made[at], NO_RANK).astype(np.int32)


def merges_of(ranks: dict[bytes, int]) -> Merges:
    """Each way to make a token of two parts, which are tokens or bytes."""
    code = {bytes((b,)): NO_RANK + b for b in range(256)} | ranks
    made = {np.iinfo(np.int64).max: NO_RANK}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = code.get(token[:cut]), code.get(token[cut:])
            if left is not None and right is not None:
                made[left << CODE_BITS | right] = rank
    pairs = sorted(made)
    codes = np.array([code[bytes((b,))] for b in range(256)], np.int32)
    merges = Merges(np.array(pairs, np.int64), np.array([made[pair] for pair in pairs], np.int32), codes, codes)
    return merges._replace(first=merges.rank(np.repeat(codes, 256), np.tile(codes, 256)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _fold_columns(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Folds the words of ``data`` at ``starts``: their ids one after the other, and how many each has.

    A word is a column, a part lies where its first byte lay. The row after the longest word stands for what is before and after a word.
    """
    width, n = int(lengths.max()), len(starts)
    place = np.arange(width + 1, dtype=np.int32)[:, None]
    inside = place < lengths
    value = data[np.minimum(starts + place, len(data) - 1)].astype(np.int32)
    parts = np.where(inside, merges.codes[value], DEAD).astype(np.int32)
    # Rank and place in one number: of equal ranks the first place is the least.
    ranks = np.full((width + 1, n), NONE, np.int32)
    ranks[:-1] = np.where(inside[1:], merges.first[value[:-1] << 8 | value[1:]] * PLACES + place[:-1], NONE)
    after, before = np.empty((2, width + 1, n), np.int32)
    after[:], before[:] = np.minimum(place + 1, width), np.where(place > 0, place - 1, width)
    while True:
        low = ranks.min(axis=0)
        word = np.flatnonzero(low < NONE)
        if not len(word):
            break
        at, new = low[word] % PLACES, low[word] // PLACES
        gone, ahead = after[at, word], before[at, word]
        behind = after[gone, word]
        parts[at, word], parts[gone, word], ranks[gone, word] = new, DEAD, NONE
        after[at, word], before[behind, word] = behind, at
        ranks[at, word] = merges.rank(new, parts[behind, word]) * PLACES + at
        ranks[ahead, word] = merges.rank(parts[ahead, word], new) * PLACES + ahead
    parts = parts.T
    left = parts != DEAD
    return parts[left], left.sum(axis=1)


def fold_merges(words: list[bytes], ranks: dict[bytes, int], merges: Merges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of words, in any order, where those of each word start, and how many there are.

    A word with a rank is its own id. In the others the pair of the lowest rank, the first of these, is merged until none has a
    rank. A byte without a rank gives a number from ``NO_RANK`` on.
    """
    whole = np.array([ranks.get(w, -1) for w in words], np.int32)
    lengths = np.array([len(w) for w in words], np.int64)
    starts, sizes = np.zeros(len(words), np.int64), (whole >= 0).astype(np.int64)
    parts, end = [whole[whole >= 0]], int(sizes.sum())
    starts[whole >= 0] = np.arange(end)

    def put(at: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        nonlocal end
        starts[at], sizes[at] = end + np.cumsum(n) - n, n
        parts.append(ids)
        end += len(ids)

    for at in np.flatnonzero((whole < 0) & (lengths > LONG_WORD)):
        ids = np.array(merge_long(words[at], ranks), np.int32)
        put(np.array([at]), ids, np.array([len(ids)]))
    folded = np.flatnonzero((whole < 0) & (lengths > 0) & (lengths <= LONG_WORD))
    folded = folded[np.argsort(lengths[folded], kind="stable")]
    data = np.frombuffer(b"".join([words[i] for i in folded]), np.uint8)
    ends = np.cumsum(lengths[folded])
    first = 0
    while first < len(folded):
        # Up to a quarter longer than the first, and so many that they fill the cells.
        width = int(lengths[folded[first]]) * 5 // 4
        last = int(np.searchsorted(lengths[folded], width, side="right"))
        last = min(last, first + max(1, FOLD_CELLS // width))
        own = folded[first:last]
        put(own, *_fold_columns(data, ends[first:last] - lengths[own], lengths[own], merges))
        first = last
    return np.concatenate(parts), starts, sizes


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word, with a heap of pairs and a linked list of parts."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    ends = list(range(1, n + 1))  # of the part that starts at an index, 0 where none starts
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        if at >= 0 and after[at] < n:
            end = ends[after[at]]
            rank = ranks.get(word[at:end])
            if rank is not None:
                heapq.heappush(heap, (rank, at, end))

    for at in range(n - 1):
        offer(at)
    while heap:
        _, at, end = heapq.heappop(heap)
        if not ends[at] or after[at] >= n or ends[after[at]] != end:
            continue  # one of the parts has changed
        gone = after[at]
        ends[at], ends[gone] = end, 0
        after[at] = after[gone]
        if after[at] < n:
            before[after[at]] = at
        offer(at)
        offer(before[at])
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : ends[at]]])
        at = after[at]
    return out


def _encoded(pattern: str, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents, ``(doc_id, text)``, to documents with their ids."""

    def take(doc_ids: list, counts: list[int], places: list[np.ndarray], numbers: dict[str, int]) -> Iterator[pa.RecordBatch]:
        ranks, merges = shared.value
        flat, starts, sizes = fold_merges([w.encode("utf-8", "surrogatepass") for w in numbers], ranks, Merges(*merges))
        ends, places = np.r_[0, np.cumsum(counts)].astype(np.int64), np.concatenate(places)
        first = 0
        while first < len(counts):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + EMIT_IDS // 4, side="right")) - 1)
            own = places[ends[first] : ends[last]]
            lengths = sizes[own]
            stops = np.r_[0, np.cumsum(lengths)]
            ids = flat[np.repeat(starts[own] - stops[:-1], lengths) + np.arange(stops[-1])]
            offsets = pa.array(stops[ends[first : last + 1] - ends[first]], pa.int32())
            values = pa.array(ids, pa.int32(), mask=ids >= NO_RANK)
            whole = pa.ListArray.from_arrays(offsets, values)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids[first:last], pa.int64()), whole], ["doc_id", "ids"])
            first = last

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = regex.compile(pattern).findall
        doc_ids, counts, places, numbers, size = [], [], [], {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                found = words_of(text)
                give = numbers.setdefault
                places.append(np.array([give(w, len(numbers)) for w in found], np.int32))
                doc_ids.append(doc_id.as_py())
                counts.append(len(found))
                size += len(text)
                if size >= CHUNK_CHARS:
                    yield from take(doc_ids, counts, places, numbers)
                    doc_ids, counts, places, numbers, size = [], [], [], {}, 0
        if doc_ids:
            yield from take(doc_ids, counts, places, numbers)

    return encoded


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)`` for each row of ``docs``: each match of ``pattern`` by itself, no special tokens.

    A null or empty text has no ids. Rows that repeat a ``doc_id``, or have none, are
    rows like others; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, tuple(merges_of(ranks))))  # as large as the vocabulary, whatever the input
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return texts.mapInArrow(_encoded(pattern, shared), _IDS)


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids: the pieces of a literal array, concatenated."""
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = _byte_string(token)
    literal = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.encode(_let(literal, lambda table: F.array_join(F.transform(ids, lambda i: table[i]), "")), "ISO-8859-1")
