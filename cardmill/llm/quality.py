"""Quality rules: compression bands of whole documents and of fixed chunks, and repetition counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .tables import free_name

SYMBOLS = b"#*$%&|<>"
WHITE_SPACE = b" \t\n\x0b\x0c\r"
WINDOW_WORDS = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of the words
ZSTD_LEVEL = 3
CHUNK_BYTES = 4096

# Limits of bytes / compressed bytes by the length of a document in bytes: (from, least, most).
# A short text hardly compresses, and a long one finds more of itself to refer to.
DOCUMENT_BANDS = ((0, 0.0, 2.5), (128, 1.0, 3.0), (512, 1.2, 3.5), (2048, 1.3, 4.5), (8192, 1.4, 6.0), (32768, 1.4, 8.0))
# Limits for full chunks, and the share of a document's bytes in chunks outside their limits that rejects it. The last chunk, if it
# is shorter, has the limits of a document of its length. All limits are parameters of judgement, set by what clean prose gives.
CHUNK_BAND = (1.3, 5.0)
MOST_BAD = 0.5

_MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, n_chunks long, n_bad_chunks long, bad_bytes long"
)


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a window of eight that is found twice or more."""
    n = len(words) - WINDOW_WORDS + 1
    if n < 2:
        return 0
    hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    windows = np.zeros(n, np.uint64)
    for j in range(WINDOW_WORDS):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n + j]
        windows ^= windows >> np.uint64(31)
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    found = np.flatnonzero(counts[which] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, found, 1)
    np.add.at(edges, found + WINDOW_WORDS, -1)
    return int((np.cumsum(edges) > 0).sum())


def duplicate_lines(data: bytes) -> int:
    lines = [line for line in data.split(b"\n") if line.strip(WHITE_SPACE)]
    return len(lines) - len(set(lines))


def ratio(data: bytes, compressor: zstandard.ZstdCompressor) -> float:
    return len(data) / len(compressor.compress(data)) if data else 0.0


def band(n_bytes: int) -> tuple[float, float]:
    """The limits of a document of a length."""
    return next((low, high) for start, low, high in reversed(DOCUMENT_BANDS) if n_bytes >= start)


def measures(text: str | None, compressor: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    chunks = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
    bad = []
    for chunk in chunks:
        low, high = CHUNK_BAND if len(chunk) == CHUNK_BYTES else band(len(chunk))
        if not low <= ratio(chunk, compressor) <= high:
            bad.append(len(chunk))
    return (
        len(words),
        len(text) - (len(data) - len(data.translate(None, WHITE_SPACE))),
        len(data) - len(data.translate(None, SYMBOLS)),
        duplicate_lines(data),
        repeated_words(words),
        ratio(data, compressor),
        len(chunks),
        len(bad),
        sum(bad),
    )


def _measured(texts: pd.Series) -> pd.DataFrame:
    compressor = zstandard.ZstdCompressor(level=ZSTD_LEVEL)
    names = [field.split()[0] for field in _MEASURES.split(", ")]
    return pd.DataFrame([measures(text, compressor) for text in texts], columns=names)


def _in_band(n_bytes: Column, value: Column) -> Column:
    inside = F.lit(True)
    for start, low, high in DOCUMENT_BANDS:
        inside = F.when(n_bytes >= start, value.between(low, high)).otherwise(inside)
    return inside


def quality_rules(docs: DataFrame, text: str = "text", name: str = "quality") -> DataFrame:
    """``docs`` with a struct ``name`` of the counts, the compression ratios and the verdicts.

    ``base_failed``: fewer than 20 words, or more than 30 % of the words in
    repeated windows. ``kept``: not so, the ratio of the whole text is in the
    band of its length, and at most half of its bytes lie in chunks outside theirs, the last and shorter chunk counting, too.
    A null or empty text has zeros and fails. Every row is measured by itself,
    so repeated rows give repeated results; all columns are kept, and ``name``
    must be free.
    """
    if free_name(docs, name) != name:
        raise ValueError(f"there is a column {name} already")
    words = F.col(text).cast("string")
    found = docs.withColumn(name, F.pandas_udf(_measured, _MEASURES)(words))
    of = lambda field: F.col(name)[field]
    failed = (of("n_words") < LEAST_WORDS) | (100 * of("n_repeat_words") > MOST_REPEATED * of("n_words"))
    n_bytes = F.coalesce(F.octet_length(words), F.lit(0))
    banded = _in_band(n_bytes, of("ratio")) & (of("bad_bytes") <= MOST_BAD * n_bytes)
    verdicts = F.struct(F.col(f"{name}.*"), failed.alias("base_failed"), (~failed & banded).alias("kept"))
    return found.withColumn(name, verdicts)
