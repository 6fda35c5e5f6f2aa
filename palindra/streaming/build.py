"""Building a corpus from streams of documents and conversations.

Both streams run as one query, so a batch holds what has arrived in either. Each batch is
a run of a resumed build, numbered by the batch: it goes on at the offsets, shards and
blocks that the earlier batches committed, leaves out ids that they used, and commits with
its row of progress. A batch that Spark repeats finds its row and does nothing, or
replaces what it had written without one. With ``ids``, new tokens get the next ids of a
vocabulary that only grows, so ids that are out never change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palindra.operators.packing import PackSettings
from palindra.plans.resume import ResumedBuild


@dataclass(frozen=True)
class StreamBuild:
    """A conversation arrives with all its turns: those of a later batch are left out.

    Validation is taken from the first batch, training follows until both sources have
    reached their targets; batches behind that are read and left.
    """

    folder: str
    settings: PackSettings
    ids: bool = False

    @property
    def build(self) -> ResumedBuild:
        return ResumedBuild(f"{self.folder}/corpus", self.settings, self.ids)

    def take(self, batch: DataFrame, batch_id: int) -> None:
        web, chat = batch.where("source = 'web'"), batch.where("source = 'chat'")
        self.build.run(
            web.select(F.col("doc").alias("doc_id"), "text"),
            chat.select(F.col("doc").alias("conv_id"), "turn", "role", "text"),
            batch_id,
        )

    def start(self, documents: DataFrame, turns: DataFrame) -> StreamingQuery:
        """Build from what has arrived in the streams (doc_id, text) and (conv_id, turn, role,
        text), then stop."""
        none = F.lit(None)
        web = documents.select(
            F.lit("web").alias("source"),
            F.col("doc_id").cast("bigint").alias("doc"),
            none.cast("bigint").alias("turn"),
            none.cast("string").alias("role"),
            "text",
        )
        chat = turns.select(
            F.lit("chat").alias("source"), F.col("conv_id").cast("bigint").alias("doc"), F.col("turn").cast("bigint").alias("turn"), "role", "text"
        )
        return (
            web.unionByName(chat)
            .writeStream.foreachBatch(self.take)
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
