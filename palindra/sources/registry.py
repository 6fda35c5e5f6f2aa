"""The base models a corpus can be built for, as a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palindra.functions import schedule

SCHEMA = """key string, hf_name string, params bigint, vocab_size bigint, device string,
block_size bigint, micro_batch bigint, grad_accum bigint, world bigint, lr double,
warmup_steps bigint, lora_rank bigint, hours double, planned_tok_per_s double"""

# The registered bases, their batch shapes and planned sessions.
BASES = [
    ("small", "HuggingFaceTB/SmolLM2-135M", 135_000_000, 49_152, "gpu", 1024, 8, 8, 2, 3e-4, 100, 0, 0.5, 8_000.0),
    ("small-tpu", "HuggingFaceTB/SmolLM2-135M", 135_000_000, 49_152, "tpu", 1024, 8, 2, 8, 3e-4, 100, 0, 1.0, 40_000.0),
    ("large", "Qwen/Qwen3-0.6B-Base", 596_000_000, 151_669, "tpu", 1024, 2, 8, 8, 1e-4, 200, 0, 8.5, 12_000.0),
    ("large-gpu", "Qwen/Qwen3-0.6B-Base", 596_000_000, 151_669, "gpu", 1024, 1, 32, 2, 1e-4, 200, 0, 11.3, 1_200.0),
    ("large-lora-gpu", "Qwen/Qwen3-1.7B-Base", 1_700_000_000, 151_669, "gpu", 1024, 2, 16, 2, 2e-4, 200, 64, 11.3, 700.0),
    ("xlarge-lora", "Qwen/Qwen3-4B-Base", 4_000_000_000, 151_669, "tpu", 1024, 1, 16, 8, 2e-4, 200, 64, 8.5, 2_500.0),
]


def bases(spark: SparkSession) -> DataFrame:
    """Six rows with the derived dtype, token width and tokens per step."""
    vocab = F.col("vocab_size")
    return spark.createDataFrame(BASES, SCHEMA).select(
        "*",
        schedule.token_dtype(vocab).alias("dtype"),
        schedule.bytes_per_token(vocab).cast("bigint").alias("token_bytes"),
        schedule.tokens_per_step(*map(F.col, ("micro_batch", "grad_accum", "world", "block_size"))).alias(
            "tokens_per_step"
        ),
    )


def with_base(rows: DataFrame, key: str = "base_key") -> DataFrame:
    """Rows with their base; ``known`` is false where the key is not registered."""
    table = bases(rows.sparkSession).withColumnRenamed("key", key).withColumn("known", F.lit(True))
    return rows.join(F.broadcast(table), key, "left").na.fill(False, ["known"])
