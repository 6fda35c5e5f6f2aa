"""Packed shards on disk: Parquet by partition, or headerless fixed-width files."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Bytes per token of the two widths.
WIDTH = {"uint16": 2, "uint32": 4}
# Tokens per output row and per read task of a binary shard.
ROW_TOKENS = 1 << 16
TASK_TOKENS = 1 << 25


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Blocks under (split, stream, shard), sorted by index inside a file.

    Assembly leaves runs of consecutive blocks in one task, so a task writes few
    partitions and a reader finds a block by row-group statistics.
    """
    (
        blocks.sortWithinPartitions("split", "stream", "shard", "block_idx")
        .write.mode("overwrite")
        .partitionBy("split", "stream", "shard")
        .parquet(path)
    )


def read_blocks(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)


def _write_partition(path: str, dtype: str):
    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, handle, count = None, None, 0

        def finish():
            handle.flush()
            os.fsync(handle.fileno())
            handle.close()
            os.replace(handle.name, os.path.join(path, f"{current[0]}_{current[1]:03d}.bin"))
            return pd.DataFrame({"stream": [current[0]], "shard": [current[1]], "tokens": [count]})

        for batch in batches:
            for stream, shard, tokens in zip(batch["stream"], batch["shard"], batch["tokens"]):
                if current != (stream, shard):
                    if handle is not None:
                        yield finish()
                    current, count = (stream, int(shard)), 0
                    name = f".{stream}_{int(shard):03d}.{os.getpid()}.tmp"
                    handle = open(os.path.join(path, name), "wb")
                data = np.asarray(tokens).astype(dtype)
                data.tofile(handle)
                count += len(data)
        if handle is not None:
            yield finish()

    return written


def write_binary(parts: DataFrame, path: str, dtype: str) -> DataFrame:
    """Write shard parts (stream, shard, at, tokens as ids) as ``<stream>_<shard>.bin``.

    ``path`` is a folder that every executor mounts. A task streams its shards in
    order and renames each one when it is whole, so a retried task replaces its
    own files only. Returns what was written: (stream, shard, tokens).
    """
    os.makedirs(path, exist_ok=True)
    placed = parts.repartition("stream", "shard").sortWithinPartitions("stream", "shard", "at")
    done = placed.select("stream", "shard", "tokens").mapInPandas(
        _write_partition(path, dtype), "stream string, shard bigint, tokens bigint"
    )
    rows = done.collect()  # one row per shard file
    return parts.sparkSession.createDataFrame(rows, done.schema)


@dataclass
class TokenRange(InputPartition):
    path: str
    begin: int
    end: int


class BinaryShardReader(DataSourceReader):
    def __init__(self, options):
        self.dtype = options.get("dtype", "")
        if self.dtype not in WIDTH:
            raise ValueError("option 'dtype' must name the width the manifest records")
        self.path = options["path"]

    def partitions(self):
        size = WIDTH[self.dtype]
        folder = self.path
        names = sorted(n for n in os.listdir(folder) if n.endswith(".bin"))
        out = []
        for name in names:
            full = os.path.join(folder, name)
            total = os.path.getsize(full) // size
            out += [TokenRange(full, b, min(total, b + TASK_TOKENS)) for b in range(0, total, TASK_TOKENS)]
        return out

    def read(self, partition):
        stem = os.path.basename(partition.path)[: -len(".bin")]
        stream, shard = stem.rsplit("_", 1)
        size = WIDTH[self.dtype]
        with open(partition.path, "rb") as handle:
            handle.seek(partition.begin * size)
            at = partition.begin
            while at < partition.end:
                tokens = np.fromfile(handle, self.dtype, min(ROW_TOKENS, partition.end - at)).astype("int64")
                yield pa.RecordBatch.from_pydict(
                    {
                        "stream": pa.array([stream]),
                        "shard": pa.array([int(shard)], pa.int64()),
                        "at": pa.array([at], pa.int64()),
                        "tokens": pa.array([tokens], pa.list_(pa.int64())),
                    }
                )
                at += len(tokens)


class BinaryShards(DataSource):
    """``spark.read.format("token_shards").option("dtype", "uint16").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return "stream string, shard bigint, at bigint, tokens array<bigint>"

    def reader(self, schema):
        return BinaryShardReader(self.options)


def read_binary(spark: SparkSession, path: str, dtype: str) -> DataFrame:
    """Shard parts (stream, shard, at, tokens); large shards are read by ranges."""
    spark.dataSource.register(BinaryShards)
    return spark.read.format("token_shards").option("dtype", dtype).load(path)
