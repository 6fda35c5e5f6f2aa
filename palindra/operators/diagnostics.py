"""Checks over stored vectors and roll-ups over result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palindra.functions import permute, vectors

# The control flags a run knows.
FLAGS = ("SAVE_NOW", "DECAY_NOW", "STOP_NOW")


def agreement(stored: DataFrame, reloaded: DataFrame, key: str, column: str, *dtypes: str) -> DataFrame:
    """A row per type: largest difference of two vector tables, also relative, how many
    rows have no equal in size on the other side, and the verdict, which such rows fail."""
    here = stored.select(key, F.col(column).alias("_a"), F.lit(True).alias("_here"))
    there = reloaded.select(key, F.col(column).alias("_b"), F.lit(True).alias("_there"))
    pairs = here.join(there, key, "full")
    same = F.coalesce(F.col("_here") & F.col("_there") & (F.size("_a") == F.size("_b")), F.lit(False))
    worst = pairs.agg(
        F.max(F.when(same, vectors.max_delta(F.col("_a"), F.col("_b")))).alias("delta"),
        F.greatest(F.max(vectors.max_magnitude(F.col("_a"))), F.lit(1.0)).alias("scale"),
        F.count_if(~same).alias("unmatched"),
    )
    kinds = worst.withColumn("dtype", F.explode(F.array(*[F.lit(d) for d in dtypes])))
    relative = F.col("delta") / F.col("scale")
    close = F.coalesce(relative <= vectors.tolerance(F.col("dtype")), F.lit(True))
    return kinds.select("dtype", "delta", relative.alias("relative"), "unmatched", ((F.col("unmatched") == 0) & close).alias("ok"))


def mean_cross_entropy(rows: DataFrame, logits: str, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean loss over the targets that count."""
    return rows.groupBy(*keys).agg(
        F.avg(vectors.cross_entropy(F.col(logits), F.col(target))).alias("loss"),
        F.count_if(F.col(target) != -1).alias("targets"),
    )


# Aggregates by name, so that several of them take one grouping.


def passed() -> dict[str, Column]:
    """Passed and total of named checks (ok BOOLEAN)."""
    return {"passed": F.count_if("ok"), "total": F.count("*")}


def reduced() -> dict[str, Column]:
    """Reductions over workers: control bits by or, a value by max, mean and sum."""
    return {"bits": F.bit_or("bits"), "max_value": F.max("value"), "mean_value": F.avg("value"), "sum_value": F.sum("value")}


def flags_set() -> dict[str, Column]:
    """The set of known flags; never more than three names."""
    return {"raised": F.sort_array(F.collect_set(F.when(F.col("flag").isin(*FLAGS), F.col("flag"))))}


def session() -> dict[str, Column]:
    """Replies, tokens, seconds and rate; a session without time has rate 0."""
    tokens, seconds = F.sum("tokens"), F.sum("seconds")
    rate = F.when(seconds > 0, tokens / seconds).otherwise(0.0)
    return {"replies": F.count("*"), "tokens": tokens, "seconds": seconds, "rate": rate}


def grouped(rows: DataFrame, keys: Sequence[str], found: Mapping[str, Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in found.items()])


def roll_up(checks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return grouped(checks, keys, passed())


def session_totals(replies: DataFrame, keys: Sequence[str]) -> DataFrame:
    return grouped(replies, keys, session())


def raised(flags: DataFrame, keys: Sequence[str]) -> DataFrame:
    return grouped(flags.where(F.col("flag").isin(*FLAGS)), keys, flags_set())


def across_workers(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    return grouped(values, keys, reduced())


def uniform(seed: int, row: Column, i: Column) -> Column:
    """A number in (0, 1) from a row's number and a place in it, wherever it is computed."""
    key = permute.mix(row.cast("bigint").bitwiseAND(F.lit(permute.MASK32)), F.lit(seed))
    return (permute.mix(i, key) + F.lit(0.5)) / F.lit(float(permute.MASK32 + 1))


def draw(probs: Column, row: Column, seed: int) -> Column:
    """A seeded draw per row from its probabilities."""
    noise = F.transform(F.sequence(F.lit(1), F.size(probs)), lambda i: uniform(seed, row, i))
    return vectors.gumbel_draw(probs, noise)
