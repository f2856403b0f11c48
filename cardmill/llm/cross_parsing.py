"""Language identification by cross-parsing entropy.

A language is learned as the suffix automaton of a bounded sample of its texts. A text is
parsed against it into phrases, each the longest match with the sample from where the one before ended. A
language that shares more with the text gives longer matches, so the one that needs the fewest
phrases wins, each phrase counting the logarithm of the sample's length, which is what it takes to say where it stands.

Texts are lower-cased and their bytes other than letters become single spaces, so digits, marks and
white space favour no language. They are parsed whole, in segments of ``SEGMENT`` bytes that start
anew; the segments of many texts go through the automaton in step, a table look-up a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from .tables import free_name, stored

SEGMENT = 512
CHUNK_BYTES = 1 << 23  # of folded text parsed together
LETTER = r"\p{L}"
UNDETERMINED = "und"

_LETTERS = np.zeros(256, np.uint8)
_LETTERS[ord("a") : ord("z") + 1] = 1
_LETTERS[0x80:] = 1  # parts of characters beyond ASCII


def folded(text: str) -> np.ndarray:
    """The text in lower case as bytes, each run of ASCII other than letters as one space, none at the ends."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    letter = _LETTERS[data]
    spaced = np.where(letter, data, np.uint8(32))
    keep = letter.astype(bool)
    keep[1:] |= letter[:-1].astype(bool)
    spaced = spaced[keep]
    return spaced[:-1] if len(spaced) and spaced[-1] == 32 else spaced


@dataclass(frozen=True)
class Automaton:
    """A suffix automaton of ``size`` bytes as a list of edges between ``n_states`` states; state 0 is the root."""

    lang: str
    size: int
    n_states: int
    source: np.ndarray
    byte: np.ndarray
    target: np.ndarray


def build_automaton(lang: str, sample: bytes) -> Automaton:
    """The automaton that accepts every substring of ``sample``, made online, a byte at a time."""
    length, link, edges = [0], [-1], [{}]
    last = 0
    for byte in sample:
        state = len(length)
        length.append(length[last] + 1)
        link.append(0)
        edges.append({})
        at = last
        while at >= 0 and byte not in edges[at]:
            edges[at][byte] = state
            at = link[at]
        if at >= 0:
            target = edges[at][byte]
            if length[at] + 1 == length[target]:
                link[state] = target
            else:
                copy = len(length)
                length.append(length[at] + 1)
                link.append(link[target])
                edges.append(dict(edges[target]))
                while at >= 0 and edges[at].get(byte) == target:
                    edges[at][byte] = copy
                    at = link[at]
                link[target] = link[state] = copy
        last = state
    sizes = [len(e) for e in edges]
    return Automaton(
        lang,
        len(sample),
        len(edges),
        np.repeat(np.arange(len(edges), dtype=np.int32), sizes),
        np.fromiter((b for e in edges for b in e), np.uint8),
        np.fromiter((t for e in edges for t in e.values()), np.int32),
    )


def phrase_table(automaton: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """``(table, classes)`` to parse with: a byte's class and a state give the next state and the phrases that end.

    An entry is four times the next state's first place in the table, plus the number of phrases. A byte that cannot go on a
    phrase ends it and starts the next one from the root. Bytes that the sample lacks share class 0 and are phrases of their own.
    """
    known = np.unique(automaton.byte)
    width = len(known) + 1
    classes = np.zeros(256, np.uint8 if width <= 256 else np.uint16)
    classes[known] = np.arange(1, width)
    root = np.zeros(width, np.int32)
    from_root = automaton.source == 0
    root[classes[automaton.byte[from_root]]] = automaton.target[from_root]
    after = root * (4 * width) + 1
    after[0] = 2
    table = np.tile(after, automaton.n_states)
    table[0] = 1
    table[automaton.source.astype(np.int64) * width + classes[automaton.byte]] = automaton.target * (4 * width)
    return table.astype(np.int32), classes


def count_phrases(automaton: Automaton, columns: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases of each segment. ``columns`` holds a segment a column, the longest first, of ``lengths`` bytes."""
    table, classes = phrase_table(automaton)
    phrases = np.zeros(len(lengths), np.int32)
    state = np.zeros(len(lengths), np.int32)
    active = len(lengths)
    for step in range(int(lengths[0]) if len(lengths) else 0):
        while active and lengths[active - 1] <= step:
            active -= 1
        at = state[:active] >> 2
        at += classes[columns[step, :active]]
        state[:active] = table.take(at)
        phrases[:active] += state[:active] & 3
    return phrases + (state >> 2 != 0)  # the last phrase is open unless the parse is at the root


def _segments(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, length, columns)`` of all segments, the longest first."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // SEGMENT)
    text = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    lengths = np.minimum(SEGMENT, sizes[text] - place * SEGMENT)
    starts = np.repeat(np.cumsum(sizes) - sizes, counts) + place * SEGMENT
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([*texts, np.zeros(SEGMENT, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(flat, SEGMENT)[starts[order]]
    return text[order], lengths[order], np.ascontiguousarray(rows.T)


def entropies(texts: list[np.ndarray], automata: list[Automaton]) -> np.ndarray:
    """Bits a byte that each language needs for each folded text: phrases times the logarithm of its sample's length.

    A phrase costs the 8 bits of a byte at least, or else a tiny sample would say cheaply what it does not hold.
    """
    text, lengths, columns = _segments(texts)
    sizes = np.array([max(1, len(t)) for t in texts], np.float64)
    bits = np.zeros((len(texts), len(automata)))
    for i, automaton in enumerate(automata):
        phrases = np.bincount(text, count_phrases(automaton, columns, lengths), len(texts))
        bits[:, i] = phrases * max(8.0, np.log2(automaton.size + 1)) / sizes
    return bits


def _in_chunks(texts: pd.Series) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for text in texts:
        held.append(folded(text or ""))
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def learn_languages(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    n_pieces: int = 128,
    piece_chars: int = 512,
    most_languages: int = 256,
) -> list[Automaton]:
    """An automaton for each language of ``docs``, from a bounded sample of its texts.

    Texts of a language are dealt by hash into ``n_pieces`` buckets; the least hash of each is taken, and of its
    text a piece of ``piece_chars`` characters at a place that the hash gives. So copies count once, however many
    there are, and the sample is the same on every run. At most ``n_pieces * piece_chars`` characters a
    language are learned from, and the ``most_languages`` with the most texts. Rows with a null
    language, and texts that are null or without a letter, are not learned from. Automata are built by Spark tasks, one a language.
    """
    body, name = F.col(text).cast("string"), F.col(lang).cast("string")
    hashed = docs.select(name.alias("lang"), body.alias("text"), F.xxhash64(body).alias("hash")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(LETTER)
    )
    bucket = F.pmod("hash", F.lit(n_pieces)).alias("bucket")
    least = hashed.groupBy("lang", bucket).agg(F.min("hash").alias("hash"), F.count(F.lit(1)).alias("n"))
    least = stored(least, "sample")
    common = least.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    taken = least.join(F.broadcast(common.select("lang")), "lang", "left_semi").select("lang", "hash")
    start = F.pmod(F.shiftrightunsigned("hash", 7), F.greatest(F.char_length("text") - piece_chars + 1, F.lit(1)))
    piece = F.substring("text", start.cast("int") + 1, F.lit(piece_chars)).alias("piece")
    # At most ``most_languages * n_pieces`` hashes.
    pieces = hashed.join(F.broadcast(taken), ["lang", "hash"], "left_semi").select("lang", "hash", piece).distinct()

    def build(rows: pa.Table) -> pa.Table:
        key = rows.column("lang")[0].as_py()
        chosen = sorted(set(zip(rows.column("hash").to_pylist(), rows.column("piece").to_pylist())))
        made = build_automaton(key, b" ".join(folded(piece).tobytes() for _, piece in chosen))
        arrays = {c: [getattr(made, c).tobytes()] for c in ("source", "byte", "target")}
        return pa.Table.from_pydict({"lang": [key], "size": [made.size], "n_states": [made.n_states], **arrays})

    schema = "lang string, size long, n_states long, source binary, byte binary, target binary"
    rows = pieces.groupBy("lang").applyInArrow(build, schema).orderBy("lang").collect()
    number = lambda data, kind: np.frombuffer(data, kind)
    return [
        Automaton(r["lang"], r["size"], r["n_states"], number(r["source"], np.int32), number(r["byte"], np.uint8), number(r["target"], np.int32))
        for r in rows
    ]


def _predictor(shared: Broadcast):
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automata = shared.value
        langs = np.array([a.lang for a in automata], object)
        for series in texts:
            parts = []
            for chunk in _in_chunks(series):
                bits = entropies(chunk, automata)
                order = np.argsort(bits, axis=1, kind="stable")  # languages are sorted, so ties go to the first
                rows = np.arange(len(bits))
                best = bits[rows, order[:, 0]]
                second = bits[rows, order[:, 1]] if len(langs) > 1 else np.full(len(bits), np.inf)
                with np.errstate(invalid="ignore"):
                    score = np.where(np.isinf(second), 1.0, second / np.maximum(best + second, 1e-300))
                parts.append(pd.DataFrame({"lang": langs[order[:, 0]], "score": score, "bits": best}))
            yield pd.concat(parts) if parts else pd.DataFrame({"lang": [], "score": [], "bits": []})

    return predict


def identify_languages(docs: DataFrame, automata: list[Automaton], text: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct ``name`` of the predicted ``lang``, a ``score`` from 0 to 1 and the ``bits`` a byte.

    Only the text is looked at, all of it. The score is the runner-up's bits over the sum of both: 0.5 for a tie, 1 if only one
    language was learned. Ties go to the first language by name. A null text and one without a letter
    give ``und`` with score 0, as does every text if nothing was learned. Repeated rows give
    repeated results; all columns are kept, and ``name`` must be free.
    """
    if free_name(docs, name) != name:
        raise ValueError(f"there is a column {name} already")
    schema = "lang string, score double, bits double"
    body = F.col(text).cast("string")
    unknown = F.struct(F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"))
    if not automata:
        return docs.withColumn(name, unknown)
    # As large as the languages learned, whatever the number of texts.
    shared = docs.sparkSession.sparkContext.broadcast(automata)
    found = F.pandas_udf(_predictor(shared), schema)(F.when(body.rlike(LETTER), body))
    return docs.withColumn(name, found).withColumn(name, F.when(body.rlike(LETTER), F.col(name)).otherwise(unknown))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning: CRC-32 of its id as text gives 1 modulo 3. Unknown, as false, without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
