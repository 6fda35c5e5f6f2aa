"""Packing documents as they arrive, exactly once, up to a token budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palindra.operators import packing
from palindra.session import stage
from palindra.streaming.state import VersionedTable, each_batch


class BudgetReached(Exception):
    """The token budget is met; the batch at hand is left for a larger one."""


@dataclass(frozen=True)
class PackStream:
    """Where a packing stream writes and how much it takes.

    At the budget the stream stops. The batch it stops in is packed as far as the budget
    goes but not committed: with the same budget it is packed to the same end again, with
    a larger one the stream goes on where it stopped. No document is lost.
    """

    folder: str
    max_tokens: int
    shard_tokens: int
    direction: str = "reverse"

    @property
    def progress(self) -> VersionedTable:
        return VersionedTable(f"{self.folder}/progress", "docs bigint, tokens bigint")

    def _batch_folder(self, batch_id: int) -> str:
        return f"{self.folder}/parts/batch_id={batch_id}"

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """Append the batch behind what is packed; documents of a batch go in id order."""
        spark = batch.sparkSession
        carried = self.progress.before(spark, batch_id).agg(
            F.coalesce(F.max("docs"), F.lit(0)), F.coalesce(F.max("tokens"), F.lit(0))
        ).first()
        docs, tokens = carried[0], carried[1]
        if tokens < self.max_tokens:
            pieces = packing.web_pieces(batch, self.direction)
            pieces = stage(pieces.withColumn("n", F.size("tokens").cast("bigint")), "arrived")
            spans = packing.offsets(pieces).withColumn("start", F.col("start") + tokens)
            spans = stage(spans, "arrived-spans")
            kept = spans.where(F.col("start") < self.max_tokens)
            placed = pieces.select("source", "doc", "piece", "tokens").join(
                kept.select("source", "doc", "piece", "start"), ["source", "doc", "piece"]
            )
            parts = packing.shard_parts(placed.select("source", "doc", "start", "tokens"), self.shard_tokens)
            parts.write.mode("overwrite").parquet(self._batch_folder(batch_id))
            added = kept.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
            docs, tokens = docs + added[0], tokens + added[1]
            beyond = not spans.where(F.col("start") >= self.max_tokens).isEmpty()
        else:
            beyond = not batch.isEmpty()
        if beyond:
            raise BudgetReached(f"{tokens} tokens in {docs} documents")
        # Written after the data: a batch without progress is packed again as a whole.
        self.progress.put(spark.createDataFrame([(docs, tokens)], self.progress.schema), batch_id)

    def start(self, documents: DataFrame) -> StreamingQuery:
        """Pack what has arrived in the stream (doc_id, text) and stop."""
        return each_batch(documents, f"{self.folder}/checkpoint", self.take)

    def run(self, documents: DataFrame) -> bool:
        """Pack what has arrived and wait for it; whether the budget was reached."""
        try:
            self.start(documents).awaitTermination()
        except StreamingQueryException as stopped:
            if BudgetReached.__name__ in str(stopped):
                return True
            raise
        return False

    def parts(self, spark: SparkSession) -> DataFrame:
        """Everything packed so far: (source, doc, shard, at, tokens)."""
        return spark.read.parquet(f"{self.folder}/parts").drop("batch_id")
