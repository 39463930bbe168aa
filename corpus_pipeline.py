"""Corpus pipeline: toxicity, near duplicates, decontamination, personal data, tokens.

Each stage gets the documents that the one before kept. All but the last return the columns of documents, others
that the table may have included. Cases, for all stages: an empty table stays empty; null and empty texts are clean,
copies of nothing, hold no passage and no personal data, and have no tokens; rows without an id are treated like
others, and copies among them go; very long texts are read whole. Extra columns pass through, whatever their names
but those that start with _ngram_ or _pii_.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontaminate, ngram_join, surrogates, toxicity
from quillspark.llm.common import dropped, stored, table
from quillspark.llm.queries import tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go: those whose score is 0.5 or more. Without labels none go.
    Repeated rows are judged alike."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least id; of several rows of that id with one text the
    first by their other columns, of rows without an id one if no row of the group has one."""
    return ngram_join.without_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. Without a benchmark none go; repeated rows are judged alike."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by surrogates, equal ones by equal ones; n_chars follows the new text (null for none)."""
    return surrogates.pseudonymise(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding of every text that is left, a row each; repeated rows give repeated results."""
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("near copies", without_copies),
    ("decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("tokens", tokens),
]

#: The stages train models and search for near copies, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
