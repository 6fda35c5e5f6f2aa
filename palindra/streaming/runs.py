"""Following run logs while they are written.

Batch operators do the work inside each micro-batch, so one run with most of the
rows is spread over tasks here too. What crosses batches is one row per run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palindra.functions.text import strip
from palindra.operators import runlog
from palindra.session import stage
from palindra.streaming.state import VersionedTable, each_batch

LINE = "run_id bigint, seq bigint, step bigint, wall_s double, loss double, heartbeat double"
COLUMNS = [c.split()[0] for c in LINE.split(",")]


@dataclass(frozen=True)
class RunFollower:
    """Keeps restarts, smoothed losses and the newest row of every run.

    Lines of a run must arrive in order of ``seq``; one that is not above what an
    earlier batch had stops the stream with an error, since it would change averages
    that are already out.
    """

    folder: str

    @property
    def newest(self) -> VersionedTable:
        return VersionedTable(f"{self.folder}/newest", f"{LINE}, ema double, batches bigint")

    def take(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = self.newest.before(spark, batch_id)
        lines = stage(batch.select(*COLUMNS).withColumn("_new", F.lit(True)), "lines")

        late = lines.join(seen.select("run_id", F.col("seq").alias("_had")), "run_id").where("seq <= _had").first()
        if late is not None:
            raise ValueError(f"run {late.run_id}: line {late.seq} came after line {late._had}")

        joined = lines.unionByName(seen.select(*COLUMNS, F.lit(False).alias("_new")))
        found = runlog.restarts(joined).where(F.col("_new") & F.col("restart"))
        found.select(
            "run_id", "seq", F.col("prev.step").alias("from_step"), "step"
        ).write.mode("overwrite").parquet(f"{self.folder}/restarts/batch_id={batch_id}")

        # The carried average stands in for the first loss, which seeds the fold.
        seeded = lines.unionByName(
            seen.select(*[F.col("ema").alias("loss") if c == "loss" else F.col(c) for c in COLUMNS], F.lit(False).alias("_new"))
        )
        smooth = stage(runlog.smoothed_loss(seeded), "smooth")
        smooth.where("_new").select("run_id", "seq", "ema").write.mode("overwrite").parquet(
            f"{self.folder}/ema/batch_id={batch_id}"
        )

        last = smooth.groupBy("run_id").agg(
            F.max_by(F.struct(*[c for c in COLUMNS if c not in ("run_id", "loss", "heartbeat")]), "seq").alias("r"),
            F.max("heartbeat").alias("heartbeat"),
            F.max_by("ema", F.when(F.col("ema").isNotNull(), F.col("seq"))).alias("ema"),
            F.max(F.col("_new").cast("bigint")).alias("batches"),
        )
        losses = joined.groupBy("run_id").agg(F.max_by("loss", "seq").alias("loss"))
        before = seen.select("run_id", F.col("batches").alias("_batches"))
        now = last.join(losses, "run_id").join(before, "run_id", "left")
        self.newest.put(
            now.select(
                "run_id",
                "r.*",
                "loss",
                "heartbeat",
                "ema",
                (F.col("batches") + F.coalesce("_batches", F.lit(0))).alias("batches"),
            ),
            batch_id,
        )

    def start(self, log: DataFrame) -> StreamingQuery:
        """Follow a log stream; its columns are those of ``LINE``."""
        return each_batch(log, f"{self.folder}/checkpoint", self.take)

    def restarts(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/restarts").drop("batch_id")

    def smoothed(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/ema").drop("batch_id")

    def status(self, spark: SparkSession, last_batch: int) -> DataFrame:
        """One row per run, as of a batch."""
        return self.newest.latest(spark, last_batch)


def stalled(status: DataFrame, now: Column, stale_seconds: float = runlog.STALE_SECONDS) -> DataFrame:
    """Runs whose heartbeat is older than allowed."""
    return status.where(now - F.col("heartbeat") > stale_seconds)


def given_up(status: DataFrame, now: Column, started: Column, stale_minutes: float = 15.0) -> DataFrame:
    """Runs to treat as dead: stale, and watched for longer than the start grace."""
    grace = max(stale_minutes * 60, 600.0)
    return stalled(status.where(now - started > grace), now, stale_minutes * 60)


def finished(status: DataFrame) -> DataFrame:
    """Runs that recorded why they stopped, or left an exit marker (``exit_code``)."""
    reason = F.col("stop_reason").isNotNull() & (F.col("stop_reason") != "")
    if "exit_code" not in status.columns:
        return status.where(reason).withColumn("clean", F.lit(True))
    left = strip(F.col("exit_code"))
    return status.where(reason | left.isNotNull()).withColumn(
        "clean", F.when(reason, True).otherwise(left == "0")
    )


def newest_rows(log: DataFrame) -> DataFrame:
    """Streaming aggregate for output mode ``update``: the newest line per run."""
    return log.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "run_id"]), "seq").alias("r")).select(
        "run_id", "r.*"
    )


def windows(log: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Rows and losses of each run per time window; later rows than ``late`` drop out."""
    return (
        log.withWatermark("ts", late)
        .groupBy("run_id", F.window("ts", width).alias("w"))
        .agg(F.count("*").alias("log_rows"), F.sum("loss").alias("loss_sum"), F.max("tokens").alias("tokens"))
        .select("run_id", F.col("w.start").alias("window_start"), "log_rows", "loss_sum", "tokens")
    )


def follow_windows(log: DataFrame, folder: str, late: str = "10 minutes", width: str = "1 hour") -> StreamingQuery:
    """Write what each batch changes in the windows of a log stream, open ones too."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/windows/batch_id={batch_id}")

    return each_batch(windows(log, late, width), f"{folder}/checkpoint", put, "update")


def newest_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Every window as the last batch that touched it left it."""
    rows = spark.read.parquet(f"{folder}/windows")
    kept = F.struct("log_rows", "loss_sum", "tokens")
    return rows.groupBy("run_id", "window_start").agg(F.max_by(kept, "batch_id").alias("r")).select("run_id", "window_start", "r.*")
