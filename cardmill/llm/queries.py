"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    bpe,
    chat,
    cross_parsing,
    hard_negatives,
    jaccard,
    licenses,
    mixing,
    nn_descent,
    orchard,
    pii,
    quality,
    token_rollup,
    warc,
)
from ..session import shared_folder
from .tables import WORD, read_documents, stored

LETTERS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SYMBOL_WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D#*$%&|<>]*+[#*$%&|<>][^\x20\x09-\x0D]*+"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

Query = Callable[[SparkSession, str], DataFrame]


def token_digests(docs: DataFrame) -> DataFrame:
    """Encodes and decodes documents: counts and digests of the ids and of the decoded bytes."""
    ranks = bpe.load_ranks(public_tokenizers.path(VOCABULARY))
    ids = F.col("ids")
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(ids, ranks), 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read_documents(spark, sf_dir))


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: words of all documents, words of letters and digits too, repeated texts taken
    out again, and the first counts revised to leave out words with symbols. The last two are committed twice."""
    path = f"{shared_folder(spark)}/rollup-{uuid.uuid4()}"
    text = F.col("text")
    docs = read_documents(spark, sf_dir).select(
        "doc_id",
        "source",
        "lang",
        F.md5(text).alias("mark"),
        token_rollup.token_count(text, WORD).alias("words"),
        token_rollup.token_count(text, LETTERS).alias("letters"),
        token_rollup.token_count(text, SYMBOL_WORD).alias("symbols"),
    )
    docs = stored(docs, "counted")
    words, letters, plain = F.col("words"), F.col("letters"), F.col("words") - F.col("symbols")
    firsts = docs.groupBy("mark").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    again = docs.join(stored(firsts.filter("first < last"), "firsts"), "mark").filter("doc_id > first")
    of = lambda version, rows, old, new: token_rollup.changes(rows, version, old, new)
    batches = {
        "0": of("words", docs, None, words),
        "1": of("letters", docs, None, letters),
        "2": of("words", again, words, None).unionByName(of("letters", again, letters, None)),
        "3": of("words", docs.filter("symbols > 0"), words, plain),
        "4": of("words", again.filter("symbols > 0"), plain, words),  # these were gone before
    }
    for batch in ("0", "1", "2", "2", "3", "4", "3"):
        token_rollup.commit(path, batch, batches[batch])
    return token_rollup.totals(spark, path)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read_documents(spark, sf_dir))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score"
    )


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.shingle_components(read_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op5_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4()}"
    warc.write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return warc.read_pages(spark, folder)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(mixing.sized_documents(read_documents(spark, sf_dir)))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return quality.quality_rules(docs).select("doc_id", "quality.*")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.find_pii(read_documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.KINDS[:4]))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    return docs.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_string("%.1f", s["score"])), ",").alias("scores"),
        F.size("pii").cast("long").alias("n_spans"),
    )


def op11_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text", "lang")
    seen = docs.filter(F.col("doc_id").isNotNull() & ~cross_parsing.held_out())
    found = cross_parsing.identify_languages(docs.select("doc_id", "text"), cross_parsing.learn_languages(seen))
    return found.select(
        "doc_id",
        cross_parsing.held_out().alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        "language.score",
        "language.bits",
    )


def op12_orchard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return orchard.with_inertia(*orchard.cluster_vectors(vectors)).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors, label=label)


QUERIES: dict[str, Query] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_token_rollup": op2_token_rollup,
    "op3_license_scan": op3_license_scan,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_perspective_rotation": op5_perspective_rotation,
    "op6_warc": op6_warc,
    "op7_mix_sources": op7_mix_sources,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_quality_rules": op9_quality_rules,
    "op10_pii": op10_pii,
    "op11_cross_parsing": op11_cross_parsing,
    "op12_orchard_search": op12_orchard_search,
    "op13_hard_negatives": op13_hard_negatives,
}
