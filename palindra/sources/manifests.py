"""The manifest of a corpus: one JSON object beside its shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palindra.sources.registry import with_base

SOURCE = "shards array<string>, docs bigint, tokens bigint, val_docs bigint"
SCHEMA = f"""base string, base_key string, tokenizer string, vocab_size bigint, dtype string,
direction string, block_hint bigint, shards struct<train: array<string>, val: array<string>>,
sources map<string, struct<shards: array<string>, docs: bigint, tokens: bigint, val_docs: bigint>>,
chat_frac double, web_dataset string, chat_dataset string, val_tokens bigint, total_tokens bigint,
created string"""


def _empty_source() -> Column:
    none = F.array().cast("array<string>")
    zero = F.lit(0).cast("bigint")
    return F.struct(none.alias("shards"), zero.alias("docs"), zero.alias("tokens"), zero.alias("val_docs"))


def parse(rows: DataFrame, column: str) -> DataFrame:
    """Manifest columns from JSON text, with defaults where keys are missing.

    Text that is not a JSON object gives no row.
    """
    parsed = rows.select(
        *[c for c in rows.columns if c != column],
        F.from_json(column, T.StructType.fromDDL(SCHEMA + ", _bad string"), {"columnNameOfCorruptRecord": "_bad"}).alias("m"),
    ).where(F.col("m").isNotNull() & F.col("m._bad").isNull())
    fields = [f.name for f in T.StructType.fromDDL(SCHEMA)]
    keep = [c for c in rows.columns if c != column]
    known = F.coalesce("sources", F.create_map().cast("map<string, struct<" + SOURCE.replace(" ", ": ").replace(",:", ",") + ">>"))
    filled = F.map_from_arrays(
        F.array(F.lit("web"), F.lit("chat")),
        F.array(*[F.coalesce(F.try_element_at(known, F.lit(s)), _empty_source()) for s in ("web", "chat")]),
    )
    return parsed.select(*keep, *[F.col("m")[f].alias(f) for f in fields]).select(
        *keep,
        F.coalesce("base", "tokenizer", F.lit("?")).alias("base"),
        *[F.col(f) for f in ("base_key", "tokenizer", "vocab_size")],
        F.coalesce("dtype", F.lit("uint16")).alias("dtype"),
        F.coalesce("direction", F.lit("forward")).alias("direction"),
        "block_hint",
        "shards",
        filled.alias("sources"),
        *[F.col(f) for f in ("chat_frac", "web_dataset", "chat_dataset")],
        F.coalesce("val_tokens", F.lit(0)).alias("val_tokens"),
        F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"),
        "created",
    )


def source_table(manifest_rows: DataFrame) -> DataFrame:
    """(source, docs, tokens, val_docs) of a manifest."""
    return manifest_rows.select(F.explode("sources").alias("source", "s")).select(
        "source", "s.docs", "s.tokens", "s.val_docs"
    )


def _names(shard_rows: DataFrame) -> DataFrame:
    name = F.format_string("%s_%03d", "stream", "shard")
    return shard_rows.groupBy("split", "stream").agg(
        F.array_sort(F.collect_list(F.struct("shard", name.alias("name")))).alias("s")
    ).select("split", "stream", F.transform("s", lambda x: x["name"]).alias("names"))


def manifest(built, base_key: str, created: Column | None = None, web: str = "documents", chat: str = "conversations") -> DataFrame:
    """One manifest row of a built corpus: totals, per-source counters, shard lists."""
    names = _names(built.shards)
    counted = built.counts().join(
        names.where(F.col("split") == "train").select(F.col("stream").alias("source"), "names"), "source", "left"
    )
    none = F.array().cast("array<string>")
    entry = F.struct(
        F.coalesce("names", none).alias("shards"), *[F.col(c) for c in ("docs", "tokens", "val_docs")]
    )
    one = counted.agg(
        F.map_from_entries(F.collect_list(F.struct("source", entry))).alias("sources"),
        F.sum("tokens").alias("total_tokens"),
    )
    # At most one row on either side.
    val = built.shards.where(F.col("split") == "val").groupBy(F.lit(base_key).alias("base_key")).agg(
        F.collect_list(F.format_string("%s_%03d", "stream", "shard")).alias("val"), F.sum("tokens").alias("val_tokens")
    )
    row = with_base(one.withColumn("base_key", F.lit(base_key))).join(F.broadcast(val), "base_key", "left")

    def listed(source: str) -> Column:
        return F.coalesce(F.try_element_at("sources", F.lit(source))["shards"], none)

    return row.select(
        F.col("hf_name").alias("base"),
        "base_key",
        F.col("hf_name").alias("tokenizer"),
        "vocab_size",
        "dtype",
        F.lit(built.settings.direction).alias("direction"),
        F.col("block_size").alias("block_hint"),
        F.struct(F.concat(listed("web"), listed("chat")).alias("train"), F.coalesce("val", none).alias("val")).alias(
            "shards"
        ),
        "sources",
        F.lit(float(built.settings.chat_frac)).alias("chat_frac"),
        F.lit(web).alias("web_dataset"),
        F.lit(chat).alias("chat_dataset"),
        F.coalesce("val_tokens", F.lit(0)).alias("val_tokens"),
        "total_tokens",
        (F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss") if created is None else created).alias("created"),
    )


def write(rows: DataFrame, path: str) -> None:
    """Write manifest rows as JSON lines; call it after the data is committed."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def scan(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """Manifests anywhere under ``root``, with their folder in ``path``."""
    raw = (
        spark.read.format("text")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .option("wholetext", "true")
        .load(root)
        .select("value", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("path"))
    )
    return parse(raw, "value")
