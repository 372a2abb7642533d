"""The ``opN_*`` queries: each applies its operator, with production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from precis.llm import (chat, decontaminate, divergence, filter_audit, line_dedup, mixing, near_dup, oracle, quality, repair,
                        secrets, suffix_dedup, token_count, warc)
from precis.llm.common import read

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), with_shared=True)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), mixing.WEIGHTS)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(read(spark, sf_dir, "conversations"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(read(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.jaccard_join(read(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, QueryFn] = {f.__name__: f for f in (
    op1_suffix_array_dedup, op2_secret_scan, op3_token_counts, op4_source_mixing, op5_quality_classifier,
    op6_chat_formatting, op7_quality_rules, op8_warc, op9_benchmark_decontamination, op10_ngram_jaccard_join,
    op11_line_dedup, op12_filter_audit, op13_conversation_repair)}

#: op1 (400-byte windows), op3 (a tokenizer) and op5 (a trained model) are
#: tested against brute force and held-out labels instead.
ORACLE: dict[str, str] = {
    "op2_secret_scan": oracle.SECRET_SCAN, "op4_source_mixing": oracle.MIXING, "op6_chat_formatting": oracle.CHAT,
    "op7_quality_rules": oracle.DIVERGENCE, "op8_warc": oracle.WARC,
    "op9_benchmark_decontamination": oracle.DECONTAMINATION, "op10_ngram_jaccard_join": oracle.JACCARD,
    "op11_line_dedup": oracle.LINE_DEDUP, "op12_filter_audit": oracle.FILTER_AUDIT,
    "op13_conversation_repair": oracle.REPAIR}
