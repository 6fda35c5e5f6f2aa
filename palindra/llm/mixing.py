"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to a power between 0 and 1, normalised.
The power is the least (the flattest mix) at which no source is repeated more often
than a limit, or the one at which the weights have a wanted entropy. Both fall with
the power, so it is bisected; a pass over the source totals tries ``TRIES`` powers at
once, so that sources, however many, stay in Spark.

Without a budget, the total is the least with which every source is taken whole at
least once; then nothing is left out and the smaller sources are repeated.

A source's documents are dealt to blocks of about ``BLOCK_TOKENS`` tokens, at most
``MOST_BLOCKS``, by a hash of their key; so a source that holds a third of all rows is many
groups. A quota of ``f`` times a source takes ``floor(f)`` whole epochs, each a
permutation of its blocks, and of one more epoch the first blocks in its permutation
that fit; the next block is cut after the last document, in order of the hash, with
which the quota is not exceeded.

Null sources are a source of their own, null or empty texts have no tokens and go
where their block goes. A source without tokens has no weight and is kept once.
Repeated rows are equal in hash and so taken or left together. An empty table gives no
rows. All columns stay; only the names the operator adds replace columns so named.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palindra.llm.quality_rules import words
from palindra.session import stage

TRIES, PASSES = 16, 7
BLOCK_TOKENS = 1 << 18
MOST_BLOCKS = 4096


@dataclass(frozen=True)
class Target:
    """``repeats``: the most epochs of any source; or ``entropy`` in nats. ``budget``: tokens."""

    repeats: float | None = 2.0
    entropy: float | None = None
    budget: int | None = None
    seed: int = 1


def token_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def totals(docs: DataFrame) -> DataFrame:
    """Rows of ``source_key, tokens`` of ``source_key, n``."""
    return docs.groupBy("source_key").agg(F.sum("n").alias("tokens"))


def exponent(sources: DataFrame, target: Target) -> tuple[float, int]:
    """The power and the budget that meet the target."""
    some = sources.where("tokens > 0")
    total, most = some.agg(F.sum("tokens"), F.max("tokens")).first()
    if not total:
        return 1.0, 0
    share, top = F.col("tokens") / F.lit(float(total)), most / total

    def tried(powers: list[float]) -> list[bool]:
        """Whether the mix at each power is flat no more than it may be."""
        sums = []
        for a in powers:
            sums += [F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share)), F.max(F.pow(share, F.lit(a - 1.0)))]
        row = some.agg(*sums).first()
        out = []
        for i, a in enumerate(powers):
            z, s, steep = row[3 * i], row[3 * i + 1], row[3 * i + 2]
            if target.entropy is not None:
                out.append(math.log(z) - a * s / z <= target.entropy)
            else:
                budget = target.budget if target.budget is not None else total * z * top ** (1 - a)
                out.append(steep / z * budget / total <= (target.repeats or 1.0) * (1 + 1e-12))
        return out

    low, high = 0.0, 1.0
    for _ in range(PASSES):
        powers = [low + (high - low) * i / TRIES for i in range(TRIES)]
        good = tried(powers)
        first = good.index(True) if True in good else TRIES
        if first == 0:
            high = low
            break
        low, high = powers[first - 1], powers[first] if first < TRIES else high
    if target.budget is not None:
        return high, target.budget
    z = some.agg(F.sum(F.pow(share, F.lit(high)))).first()[0]
    return high, int(-(-total * z * top ** (1 - high) // 1))


def order_hash(key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)


def plan(docs: DataFrame, target: Target) -> tuple[DataFrame, DataFrame]:
    """Source quotas, and what every block gives: whole epochs, one more or not, and in the
    block that is cut the last hash taken. ``docs`` has ``source_key, doc_key, n``."""
    docs = stage(docs, "mix-docs")
    sources = stage(totals(docs), "mix-sources")
    power, budget = exponent(sources, target)
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    share = F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(power))
    z = sources.where("tokens > 0").agg(F.sum(share)).first()[0] or 1.0
    quotas = sources.select(
        "source_key",
        "tokens",
        F.when(F.col("tokens") > 0, share / F.lit(z)).otherwise(0.0).alias("weight"),
        F.when(F.col("tokens") > 0, F.floor(share / F.lit(z) * F.lit(float(budget)) + 0.5)).otherwise(0).cast("bigint").alias("quota"),
        F.least(F.greatest(F.ceil(F.col("tokens") / BLOCK_TOKENS), F.lit(1)), F.lit(MOST_BLOCKS)).cast("int").alias("blocks"),
    )
    quotas = stage(
        quotas.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(1)).withColumn(
            "rest", F.when(F.col("tokens") > 0, F.expr("quota % tokens")).otherwise(0)
        ),
        "mix-quotas",
    )
    placed = docs.join(quotas.select("source_key", "blocks"), "source_key").select(
        "source_key", "n", order_hash(F.col("doc_key"), target.seed).alias("h"), block_of(target.seed).alias("block")
    )
    sizes = placed.groupBy("source_key", "block").agg(F.sum("n").alias("block_tokens"))
    epoch = F.col("epochs")
    turn = Window.partitionBy("source_key").orderBy(F.xxhash64(F.lit(target.seed), "source_key", "block", epoch), "block")
    turns = stage(
        sizes.join(quotas, "source_key")
        .withColumn("turn", F.row_number().over(turn))
        .withColumn("upto", F.sum("block_tokens").over(turn.rowsBetween(Window.unboundedPreceding, 0)))
        .select(
            "source_key",
            "block",
            "epochs",
            "turn",
            ((F.col("upto") <= F.col("rest")) & (F.col("rest") > 0)).alias("more"),
            (F.col("rest") - F.col("upto") + F.col("block_tokens")).alias("room"),
            "block_tokens",
        ),
        "mix-turns",
    )
    cut = turns.where("not more and room > 0").select("source_key", "block", "room")
    inside = placed.join(cut, ["source_key", "block"]).groupBy("source_key", "block", "room", "h").agg(F.sum("n").alias("n"))
    along = Window.partitionBy("source_key", "block").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        inside.withColumn("run", F.sum("n").over(along)).where("run <= room").groupBy("source_key", "block").agg(F.max("h").alias("last_hash"))
    )
    return quotas, stage(turns.join(last, ["source_key", "block"], "left").select("source_key", "block", "epochs", "turn", "more", "last_hash"), "mix-plan")


def block_of(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed + 1), "doc_key"), F.col("blocks")).cast("int")


def keyed(docs: DataFrame, key: str, text: str, source: str, n: Column | None) -> DataFrame:
    count = token_count(F.col(text)) if n is None else n
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("source_key"),
        F.col(key).cast("bigint").alias("doc_key"),
        count.alias("n"),
    )


def mixed(
    docs: DataFrame,
    target: Target = Target(),
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    n: Column | None = None,
) -> DataFrame:
    """``docs`` with ``copies``, how often each row is taken, ``mix_block`` and ``mix_turn``,
    the block's place in the permutation of the last epoch."""
    quotas, blocks = plan(keyed(docs, key, text, source, n), target)
    key_of = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    names = [c for c in docs.columns if c not in ("copies", "mix_block", "mix_turn", "source_key", "doc_key", "blocks")]
    rows = docs.select(*names, key_of.alias("source_key"), F.col(key).cast("bigint").alias("doc_key"))
    rows = rows.join(quotas.select("source_key", "blocks"), "source_key").withColumn("block", block_of(target.seed))
    given = blocks.select("source_key", "block", "epochs", "turn", "more", "last_hash")
    h = order_hash(F.col("doc_key"), target.seed)
    extra = F.col("more") | F.coalesce(h <= F.col("last_hash"), F.lit(False))
    return rows.join(given, ["source_key", "block"]).select(
        *names,
        (F.col("epochs") + extra.cast("bigint")).alias("copies"),
        F.col("block").alias("mix_block"),
        F.col("turn").alias("mix_turn"),
    )


def repeated(rows: DataFrame) -> DataFrame:
    """Every row as often as ``copies`` says, without the columns that ``mixed`` added."""
    every = rows.where("copies > 0").withColumn("copies", F.explode(F.expr("sequence(1, copies)")))
    return every.drop("copies", "mix_block", "mix_turn")
