"""Token counts of whole texts.

Batches of texts go to the workers as Arrow data and only lengths come back. A
worker takes texts in ranges of about equal bytes, splits long ones at safe
boundaries and encodes what it has not met before (``encoding``).

A null text counts as empty and has no tokens. Rows are taken one by one, so rows
that repeat each give a result, an empty table gives no rows, and other columns of
the input are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palindra.llm.encoding import encoder
from palindra.llm.words import texts_of


def count_tokens(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``doc_id, n_bytes, n_tokens, over_limit`` for a tokenizer file."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = texts_of(batch.column(1))
            counts = coder.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts.ends - texts.starts), pa.array(counts), pa.array(counts > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    taken = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return taken.mapInArrow(lengths, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
