"""Token ids of documents in ORC files, in ascending order of their ids.

Documents are dealt to tasks by ranges of their id and encoded in order; a task
writes one file. ORC keeps the id arrays as run-length encoded integers in stripes,
with row indexes and a Bloom filter on ``doc_id``: readers take stripes in parallel
and skip files, stripes and row groups that cannot hold a wanted id.

Every row has its file's number and the count of ids before it in that file. One sum
per file then gives the place of every document in the whole sequence; no document
is ever compared with all those before it.

A null text counts as empty: only the end id is written. A null id comes first. Rows
with one id stay together, ordered by a hash of their text, and each counts. An empty
table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palindra.llm.encoding import encoder
from palindra.llm.words import texts_of

SCHEMA = "doc_id bigint, part int, before bigint, n_tokens bigint, tokens array<int>"
#: Bytes of a stripe and rows between entries of its row index.
STRIPE_BYTES = 64 << 20
INDEX_ROWS = 10_000


def encode(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every text and ``end_id`` after it, sorted within ranges of ids."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, coder = TaskContext.get().partitionId(), 0, encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), texts_of(batch.column(1))
            for lo, hi, counts, ids in coder.ids(texts, end_id):
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(lo, hi - lo),
                        pa.array(np.full(hi - lo, part, np.int32)),
                        pa.array(before + ends - counts),
                        pa.array(counts),
                        lists,
                    ],
                    ["doc_id", "part", "before", "n_tokens", "tokens"],
                )
                before += int(ends[-1])

    taken = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tie = F.xxhash64("text")
    dealt = taken.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    return dealt.mapInArrow(coded, SCHEMA)


def write(coded: DataFrame, folder: str) -> None:
    """One ORC file per task. Integers stay run-length encoded; zstd packs them further."""
    options = {
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
        "orc.row.index.stride": str(INDEX_ROWS),
        "orc.stripe.size": str(STRIPE_BYTES),
        "compression": "zstd",
    }
    coded.write.options(**options).orc(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The written rows; filters on ``doc_id`` reach the files' indexes."""
    return spark.read.schema(SCHEMA).orc(folder)


def starts(rows: DataFrame) -> DataFrame:
    """Rows of ``part, base``: ids in all files before. One row per file is ordered."""
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))


def digests(rows: DataFrame) -> DataFrame:
    """Per document: ``doc_id, start, n_tokens, ids_crc32`` as the files hold them."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at = np.asarray(lists.offsets)
            ids = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4").astype("<u4")).cast("B")
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "part", "before", "n_tokens", "ids_crc32"],
            )

    seen = rows.select("doc_id", "part", "before", "tokens").mapInArrow(
        summed, "doc_id bigint, part int, before bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return seen.join(starts(rows.select("part", "n_tokens")), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
