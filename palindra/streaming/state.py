"""State that streaming jobs carry from one micro-batch to the next.

Each batch writes its own version and reads the one before it. A batch that is
repeated after a failure reads the same input and replaces its own output, so
results do not depend on how often a batch ran.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


class VersionedTable:
    def __init__(self, path: str, schema: str):
        self.path, self.schema = path.rstrip("/"), schema

    def _version(self, batch_id: int) -> str:
        return f"{self.path}/v{batch_id:012d}"

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Rows as the previous batch left them; none before the first."""
        if batch_id == 0:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(self._version(batch_id - 1))

    def put(self, rows: DataFrame, batch_id: int) -> DataFrame:
        columns = [c.split()[0] for c in self.schema.split(",")]
        rows.select(*columns).write.mode("overwrite").parquet(self._version(batch_id))
        return rows.sparkSession.read.schema(self.schema).parquet(self._version(batch_id))

    def latest(self, spark: SparkSession, last_batch: int) -> DataFrame:
        return self.before(spark, last_batch + 1)


def each_batch(
    stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], mode: str = "append"
) -> StreamingQuery:
    """Run ``work`` over everything that has arrived, batch by batch, then stop."""
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
