"""From raw documents to packed sequences: quality filter, near-duplicates, personal data, packing.

run() writes what each stage returns as Parquet and reads it again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import neardup, packing, pii, quality
from gridloom.llm.common import materialise, read_table
from gridloom.llm.queries import quality_labels


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on labels.quality, doesn't reject."""
    return quality.kept(docs, quality.train(docs, quality_labels(read_table(spark, sf_dir, "labels"))))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return neardup.deduplicated(docs, shingle=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data and secrets; n_chars follows the text."""
    return pii.replaced(docs, count=None).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1,024 tokens."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_each),
    ("personal data", without_personal_data),
    ("packing", packed),
]

#: SQL can express neither the fitted model nor the tokenizer. Tests hold near-duplicates and packing against brute force, the classifier against held-out labels, and surrogates against what must not stay in a text.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
