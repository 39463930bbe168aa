"""The queries of this subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, decontaminate, ef_lm, ngram_join, page_diff, rule_ensemble, suffix_rules, surrogates, token_shards, toxicity
from quillspark.llm.common import table, work_path


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file lies; it is read on the driver only."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_shards.materialise(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, work_path(spark, "shards"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, sf_dir, "documents"))


def op4_ef_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ef_lm.fit_and_score(table(spark, sf_dir, "documents"), work_path(spark, "lm"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_rules.judge(table(spark, sf_dir, "documents"))


def op6_page_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.extract(table(spark, sf_dir, "pages"))


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rule_ensemble.score(docs, rule_ensemble.fit(docs, table(spark, sf_dir, "labels")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.pseudonymise(docs, counts=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_shards": op1_token_shards,
    "op2_ngram_join": op2_ngram_join,
    "op3_suffix_repeats": op3_suffix_repeats,
    "op4_ef_lm": op4_ef_lm,
    "op5_bpe": op5_bpe,
    "op6_page_difference": op6_page_difference,
    "op7_rule_ensemble": op7_rule_ensemble,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_surrogates": op10_surrogates,
}

ORACLE_SQL: dict[str, str] = {}
