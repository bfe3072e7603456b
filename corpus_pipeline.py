"""A corpus pipeline in five stages, each an operator of causeway.llm over all that the stage before it kept.

toxicity            documents that the model predicts toxic go
simhash_dedup       one document of each group of near-duplicates stays
decontamination     documents that leak a benchmark item go
secret_scan         found secrets are replaced in the text
bpe                 ids, their number and the digest of the decoded text, a row per document

A stage is written as Parquet into the shared folder and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causeway.llm import bpe, decontam, secrets, simhash, toxicity
from causeway.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenized(docs.select("doc_id", "lang", "source", "text"), bpe.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secret_scan", redact_secrets),
    ("bpe", tokenize),
]

#: Learned models, fingerprints and a tokenizer can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
