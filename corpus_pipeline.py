"""A training-data pipeline over documents: five stages, each written as Parquet and read again.

Language ID drops documents of no known language, line dedup drops lines that ten documents or more hold, the n-gram
Jaccard join leaves one document of each group of near copies, decontamination drops documents that hold a benchmark
item, and the rest are encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm import byte_bpe, decontamination, language_id, line_dedup, ngram_jaccard
from gridloom.llm.common import keeping_columns, materialize, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs of a known language; the filters are learned from docs itself."""
    return language_id.known_language(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the lines that ten documents or more hold; n_chars follows the text."""
    out = keeping_columns(docs, ("n_lines", "n_dropped", "kept_sha256"), lambda d: line_dedup.line_dedup(d, min_docs=10))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, similarity 0.75."""
    return ngram_jaccard.near_duplicates_dropped(docs).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that hold no benchmark item."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their number and digests, in place of its text."""
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, streams=("ids",), ahead=False, remembered=250_000)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard", without_near_copies),
    ("decontamination", without_benchmark),
    ("byte_bpe", encoded),
]

#: The learned filters and the merges are not SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
