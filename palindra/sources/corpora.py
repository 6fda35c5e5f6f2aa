"""Reading documents and conversations, and leaving out what was already used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palindra.operators import chat, exclusion


def web_documents(spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text", fmt: str = "parquet") -> DataFrame:
    """(doc_id, text) of documents with text; blank but not empty texts count."""
    rows = spark.read.format(fmt).load(path)
    return rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)


def conversation_turns(
    spark: SparkSession,
    path: str,
    conv_id: str = "conv_id",
    columns: Sequence[str] = ("messages", "conversations"),
    fmt: str = "parquet",
) -> DataFrame:
    """Turns in long form from a table with one nested conversation per row, or
    from one that is in long form already."""
    rows = spark.read.format(fmt).load(path)
    if any(c in rows.columns for c in columns):
        return chat.explode_messages(rows, conv_id, columns)
    return rows.withColumnRenamed(conv_id, "conv_id")


def not_yet_used(docs: DataFrame, used: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Documents whose id is not in ``used``, so a filtered row never shifts the rest."""
    return exclusion.not_used(docs, used, keys)
