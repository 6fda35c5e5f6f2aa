"""Checkpoint listings, corpus manifests and configurations as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palindra.operators.ordered import newest
from palindra.sources.registry import with_base

# The checkpoint file name and what its prefix stands for.
CHECKPOINT_NAME = r"(?:^|/)[^/]*?(ckpt|weights|milestone|sft)_step([0-9]+)\.pt$"
KINDS = {"ckpt": "full", "weights": "weights", "milestone": "milestone", "sft": "sft"}
# Files kept per kind; milestones and tuned models always stay.
KEEP = {"full": 2, "weights": 4}
# What a resume must agree on.
COMPARED = ("base_key", "hf_name", "block_size", "vocab_size")


def parse_checkpoints(listing: DataFrame) -> DataFrame:
    """(…, step, kind, size_mb) of a file listing (path, length, …).

    Other names and empty files drop out; a file found twice counts once.
    """
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return (
        listing.where((F.col("length") > 0) & F.col("path").rlike(CHECKPOINT_NAME))
        .dropDuplicates(["path"])
        .select(
            "*",
            F.regexp_extract("path", CHECKPOINT_NAME, 2).cast("bigint").alias("step"),
            kinds[F.regexp_extract("path", CHECKPOINT_NAME, 1)].alias("kind"),
            (F.col("length") / 1e6).alias("size_mb"),
        )
    )


def newest_order() -> list[Column]:
    """By falling step, resumable ones before others of the same step."""
    return [F.desc("step"), F.desc(F.col("kind") == "full"), F.asc("path")]


def newest_first(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.orderBy(*newest_order())


def _resume() -> Column:
    """What a run goes on from: the newest resumable checkpoint, else the newest of any kind."""
    return F.struct(F.col("kind") == "full", F.col("step"), F.col("path"))


def _export() -> Column:
    """What is exported: the file written last of those that can be."""
    return F.when(F.col("kind").isin("weights", "milestone", "full"), F.struct("mtime", "path"))


def picks(checkpoints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per run, the paths to resume from and to export; one grouping gives both."""
    return checkpoints.groupBy(*keys).agg(
        F.max_by("path", _resume()).alias("resume_path"), F.max_by("path", _export()).alias("export_path")
    )


def resume_pick(checkpoints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per run, the checkpoint to resume from."""
    return checkpoints.groupBy(*keys).agg(F.max_by(F.struct("path", "step", "kind"), _resume()).alias("p")).select(*keys, "p.*")


def export_pick(checkpoints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per run, the file to export; runs without one are left out."""
    found = checkpoints.groupBy(*keys).agg(F.max_by("path", _export()).alias("path"))
    return found.where(F.col("path").isNotNull())


def expired(checkpoints: DataFrame, keys: Sequence[str], keep: Mapping[str, int] | None = None) -> DataFrame:
    """Files that retention removes: beyond the newest ``keep`` of their kind.

    The newest files of a run and kind are found in two ranking steps, so a run
    with very many files is not sorted in one task; the rest are expired.
    """
    keep = KEEP if keep is None else keep
    limits = F.create_map(*[F.lit(x) for kv in keep.items() for x in kv])
    pruned = checkpoints.withColumn("_limit", F.try_element_at(limits, F.col("kind"))).where(
        F.col("_limit").isNotNull()
    )
    salt = F.pmod(F.xxhash64("path"), F.lit(64))
    order = [F.desc("mtime"), F.desc("path")]
    kept = newest(pruned, [*keys, "kind"], order, max([0, *keep.values()]), salt).where(
        F.col("rank") <= F.col("_limit")
    )
    return pruned.join(kept.select("path"), "path", "left_anti").select(*checkpoints.columns)


def fingerprint(base: Column, direction: Column, dtype: Column, vocab: Column, total: Column) -> Column:
    return F.concat_ws(":", base, direction, dtype, vocab, total)


def usable_corpora(manifests: DataFrame) -> DataFrame:
    """Manifests that list shards and hold tokens."""
    return manifests.where(F.col("shards").isNotNull() & (F.col("total_tokens") > 0))


def largest_corpus(manifests: DataFrame, wanted: str | None = None) -> DataFrame:
    """The corpus at the wanted path, else the usable one with most tokens."""
    exact = F.col("path") == F.lit(wanted) if wanted else F.lit(False)
    fit = manifests.where(exact | (F.col("shards").isNotNull() & (F.col("total_tokens") > 0)))
    order = F.struct(exact, F.col("total_tokens"), F.col("path"))
    return fit.agg(F.max_by(F.struct(*manifests.columns), order).alias("m")).where("m is not null").select("m.*")


def base_mismatches(manifests: DataFrame, key: str = "base_key") -> DataFrame:
    """Corpora tokenised for another base than the one requested, or for none known."""
    return with_base(manifests, key).where(~F.col("known") | ~F.col("base").eqNullSafe(F.col("hf_name")))


def config_differences(saved: DataFrame, live: DataFrame, key: str, fields: Sequence[str] = COMPARED) -> DataFrame:
    """(key, field, saved, live) where two configurations disagree."""

    def long(side: DataFrame, name: str) -> DataFrame:
        texts = [F.col(f).cast("string").alias(f) for f in fields]
        return side.select(key, *texts).unpivot([key], list(fields), "field", name)

    both = long(saved, "saved").join(long(live, "live"), [key, "field"], "full")
    return both.where(~F.col("saved").eqNullSafe(F.col("live")))


def fingerprint_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Corpora whose fingerprint is not the one a checkpoint recorded."""
    return before.select(key, F.col("fingerprint").alias("saved")).join(
        after.select(key, F.col("fingerprint").alias("now")), key
    ).where(F.col("saved") != F.col("now"))


def completeness(counts: DataFrame, web_target: int, chat_target: int, has_val: bool) -> DataFrame:
    """One row: whether both sources reached their target and validation exists."""

    def done(source: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("source") == source, F.col("tokens"))), F.lit(0))

    return counts.agg(done("web").alias("web_tokens"), done("chat").alias("chat_tokens")).select(
        "web_tokens",
        "chat_tokens",
        ((F.col("web_tokens") >= web_target) & (F.col("chat_tokens") >= chat_target) & F.lit(has_val)).alias(
            "complete"
        ),
    )


def strip_wrappers(weights: Column) -> Column:
    """Map keys without the prefixes that wrapping a model adds."""
    return F.transform_keys(
        weights, lambda k, v: F.regexp_replace(k, r"^(module\.)*(_orig_mod\.)*(hf\.)*", "")
    )
