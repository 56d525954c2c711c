"""The registered queries of the training-data operators: one for each, over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerframe.llm import bpe, chat, decision_list, decontamination, hard_negatives, merkle, pii, rule_ensemble, set_join, sharding, suffix_dedup, token_counts, url_filters
from ledgerframe.llm.common import read_table

#: Where the public tokenizer files lie; the package of that name is on every worker.
TOKENIZERS = os.environ.get("LEDGERFRAME_TOKENIZERS", "/opt/tokenizers")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.op1_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op3_suffix_dedup(read_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op4_pii(read_table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.op5_urls(read_table(spark, sf_dir, "pages"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op7_chat(read_table(spark, sf_dir, "conversations"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.op9_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op10_bpe_round_trip(read_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.op11_hard_negatives(read_table(spark, sf_dir, "embeddings"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op12_sharding(read_table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op13_merkle(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_pii": op4_pii,
    "op5_url_filters": op5_url_filters,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_bpe": op10_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_sharding": op12_sharding,
    "op13_merkle": op13_merkle,
}

ORACLE: dict[str, str] = {
    "op2_decontamination": decontamination.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op13_merkle": merkle.SQL,
}
