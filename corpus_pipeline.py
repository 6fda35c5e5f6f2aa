"""From documents to token files: rules, near duplicates, leaks, mix, ids.

Every stage takes what its predecessor kept, written as Parquet and read again, and
returns the columns of ``documents``; the last returns what its files hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palindra.llm import decontamination, mixing, quality_rules, shingle_join, token_files
from palindra.llm.queries import END_ID, tokenizer_path
from palindra.session import fresh_path


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    order = quality_rules.in_order(quality_rules.estimates(docs))
    return quality_rules.judged(docs, order, failed="_failed").where("_failed is null").drop("_failed")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of like ones."""
    groups = shingle_join.linked(docs)
    stay = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(docs.columns).unionAll(docs.where("doc_id is null"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of smaller sources more than once, to the target weights."""
    return mixing.repeated(mixing.mixed(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they hold for each row."""
    folder = fresh_path(spark, "pipeline-tokens")
    token_files.write(token_files.encode(docs, tokenizer_path(), END_ID), folder)
    return token_files.digests(token_files.read(spark, folder))


STAGES = [
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", leaks),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", token_ids),
]

#: Tokens of a public tokenizer, shingle sets and hashed permutations are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            folder = fresh_path(spark, "pipeline-stage")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
