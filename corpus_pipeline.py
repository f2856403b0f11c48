"""Raw documents to token ids: quality rules, near duplicates, personal data, source mix, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cardmill.llm import jaccard, mixing, pii, quality, queries
from cardmill.llm.tables import free_name, read_documents, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    name = free_name(docs, "quality")
    return quality.quality_rules(docs, name=name).filter(F.col(name)["kept"]).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return jaccard.distinct_documents(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with each span of personal data replaced by its kind; ``n_chars`` follows the text."""
    name = free_name(docs, "pii")
    found = pii.find_pii(docs, name=name).withColumn("text", pii.redacted(F.col("text"), F.col(name)))
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, up to twice."""
    return mixing.mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the token ids, a row for each row of the mix."""
    return queries.token_digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

# Compression ratios, the draws of the mix and the tokenizer's pattern are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet in the shared folder and read again."""
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
