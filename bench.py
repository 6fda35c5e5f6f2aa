"""Timings of the headline queries; prints one JSON line.

Settings: BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import time
from fractions import Fraction


from palindra.operators import packing
from palindra.plans import corpus, queries
from palindra.session import fresh_path, local_session
from palindra.sources import shards

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "reverse_layout_counts",
    "vocabulary_ids",
    "encode_ids",
    "chat_normalised",
    "pack_offsets",
    "blocks",
    "batch_plan",
    "shuffle_order",
    "restart_audit",
    "loss_ema",
    "val_asof",
    "loss_chart_bins",
    "checkpoint_pick",
    "logit_topk",
    "stream_pack",
]


def build_corpus(spark, words) -> tuple[float, int]:
    """Read, tokenise to ids, lay out, mix, pack and write a corpus of everything there is."""
    begun = time.perf_counter()
    docs = queries.documents(spark, SF_DIR)
    turns = queries.table(spark, SF_DIR, "conversations")
    settings = packing.PackSettings(
        1 << 40, Fraction(1, 5), val_tokens=100_000, shard_tokens=1_000_000, block_size=1024
    )
    built = corpus.build(docs, turns, settings, words)
    shards.write_blocks(built.blocks(), fresh_path(spark, "bench-blocks"))
    total = packing.totals(built.counts()).first().total_tokens
    return time.perf_counter() - begun, total + settings.val_tokens


def main() -> None:
    spark = local_session(CPUS, "palindra-bench")
    queries.QUERIES["reverse_layout_counts"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    timings = {}
    begun = time.perf_counter()
    words = corpus.words_of(queries.documents(spark, SF_DIR), queries.table(spark, SF_DIR, "conversations"))
    timings["corpus_vocabulary"] = round(time.perf_counter() - begun, 3)
    seconds, tokens = build_corpus(spark, words)
    timings["corpus_build_cold"] = round(seconds, 3)
    seconds, tokens = build_corpus(spark, words)
    timings["corpus_build"] = round(seconds, 3)
    for name in HEADLINE:
        begun = time.perf_counter()
        queries.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - begun, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "corpus_tokens": tokens,
                "corpus_tokens_per_sec": round(tokens / seconds),
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
