"""Which block is shown when: batch plans over a block table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palindra.functions.permute import EPOCH_STEP, permuted


@dataclass(frozen=True)
class BatchShape:
    micro_batch: int
    grad_accum: int
    world: int
    seed: int = 1337
    shuffle: bool = True

    @property
    def per_step(self) -> int:
        return self.micro_batch * self.grad_accum * self.world


def plan(spark: SparkSession, shape: BatchShape, n_blocks: int, first_step: int, steps: int) -> DataFrame:
    """(step, micro, rank, j, epoch, block_idx) for a range of steps.

    A row follows from its place alone, so any range of steps is as cheap as its
    size and needs nothing before it.
    """
    if n_blocks <= 0:
        raise ValueError("the split holds no whole block")
    begin = first_step * shape.per_step
    place = spark.range(begin, begin + steps * shape.per_step).select(
        F.expr(f"id div {shape.per_step}").alias("step"),
        F.expr(f"id div {shape.world * shape.micro_batch} % {shape.grad_accum}").alias("micro"),
        F.expr(f"id div {shape.micro_batch} % {shape.world}").alias("rank"),
        F.expr(f"id % {shape.micro_batch}").alias("j"),
        F.expr(f"id div {n_blocks}").alias("epoch"),
        F.expr(f"id % {n_blocks}").alias("pos"),
    )
    n = F.lit(n_blocks).cast("bigint")
    chosen = F.col("pos")
    if shape.shuffle:
        chosen = permuted("pos", n, F.lit(shape.seed) + F.col("epoch") * EPOCH_STEP)
    return place.withColumn("block_idx", chosen).drop("pos")


def batches(plan_rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Plan rows with their block's tokens: an equi-join, each block about once per epoch."""
    return plan_rows.join(blocks.select("block_idx", "tokens"), "block_idx")


def times_shown(plan_rows: DataFrame) -> DataFrame:
    return plan_rows.groupBy("block_idx").agg(F.count("*").alias("shown"))


def validation_prefix(blocks: DataFrame, micro_batch: int, n_batches: int) -> DataFrame:
    """The first blocks of a split as fixed batches; a short split gives fewer."""
    return blocks.where(F.col("block_idx") < micro_batch * n_batches).select(
        F.expr(f"block_idx div {micro_batch}").alias("batch"),
        F.expr(f"block_idx % {micro_batch}").alias("j"),
        "block_idx",
        "tokens",
    )


def locate(indices: DataFrame, shard_table: DataFrame) -> DataFrame:
    """Shard and block inside it for each ``block_idx``.

    Shards tile the index, so the shard is the latest one that begins at or before
    it. The shard table, a row per 2.5e8 tokens, goes to every task only while AQE
    measures it below the broadcast threshold; the bucket keeps the join an
    equi-join beyond that.
    """
    width = 1 << 16
    spans = shard_table.where(F.col("blocks") > 0).select(
        "stream",
        "shard",
        "first_block",
        "blocks",
        F.explode(
            F.sequence(
                F.expr(f"first_block div {width}"), F.expr(f"(first_block + blocks - 1) div {width}")
            )
        ).alias("_bucket"),
    )
    return (
        indices.withColumn("_bucket", F.expr(f"block_idx div {width}"))
        .join(spans, "_bucket")
        .where(
            (F.col("block_idx") >= F.col("first_block"))
            & (F.col("block_idx") < F.col("first_block") + F.col("blocks"))
        )
        .select(*indices.columns, "stream", "shard", (F.col("block_idx") - F.col("first_block")).alias("block"))
    )
