"""The operators as named queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spotweave.llm import (
    byte_bpe, conversation_repair, decontaminate, exact_dedup, hard_negatives, html_wrapper, jaccard_join, kneser_ney, line_dedup, mixing,
    quality_rules, secrets, url_reputation,
)
from spotweave.llm.common import table


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = url_reputation.bad_labels(table(spark, sf_dir, "labels"))
    return url_reputation.filter_urls(table(spark, sf_dir, "pages"), labels).select("page_id", "host", "path", "rule", "verdict")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carried=["doc_id"])
    return judged.select("_row.doc_id", *quality_rules.NAMES, "base_failed", "kept", "rejected_by")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("line_dedup.text", 256).alias("kept_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN).select("doc_id", *byte_bpe.digest())


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(table(spark, sf_dir, "pages")).select("*", F.length("text").cast("long").alias("n_chars"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(v.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.digest(conversations, *conversation_repair.repair(conversation_repair.damage(conversations)))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_reputation, op2_quality_classifier, op3_secret_scan, op4_quality_rules, op5_line_dedup, op6_byte_bpe, op7_exact_dedup,
        op8_html_extraction, op9_jaccard_join, op10_source_mixing, op11_hard_negatives, op12_conversation_repair, op13_decontamination, pipeline,
    )
}
ORACLES: dict[str, str] = {
    "op1_url_reputation": url_reputation.ORACLE, "op5_line_dedup": line_dedup.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE, "op13_decontamination": decontaminate.ORACLE,
}
