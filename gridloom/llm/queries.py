"""The registered queries of this subpackage: thin calls of the operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import audit, bestfit, bpe, fingerprint, html, lm, manifest, media, neardup, packing, pii, quality, urls
from gridloom.llm.common import crc_remainder, read_table


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(read_table(spark, sf_dir, "documents"), shingle=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(read_table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(read_table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(read_table(spark, sf_dir, "pages"))


def quality_labels(labels: DataFrame) -> DataFrame:
    """The rows that may be learned from: doc_id, label."""
    return labels.where(crc_remainder(F.col("doc_id"), 4) != 2).select("doc_id", F.col("quality").alias("label"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.train(docs, quality_labels(read_table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return quality.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", quality.predicted(F.col("score")).alias("predicted"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    return lm.scores(docs, ~held_out, tokenizer_path("byte_bpe_50k.tiktoken")).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(read_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_best_fit(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.proved(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_neardup, op2_html, op3_bpe, op4_pii, op5_fingerprint, op6_urls, op7_quality, op8_lm, op9_media, op10_packing, op11_bestfit, op12_audit, op13_manifest, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op6_urls": urls.oracle(), "op12_audit": audit.oracle(), "op13_manifest": manifest.oracle()}
