"""Building a corpus end to end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palindra.operators import chat, packing, vocabulary
from palindra.operators.packing import PackSettings
from palindra.session import stage


@dataclass(frozen=True)
class Corpus:
    """The tables of one packed corpus; all but ``limits`` and ``shards`` are lazy."""

    settings: PackSettings
    pieces: DataFrame
    spans: DataFrame
    val: DataFrame
    limits: DataFrame
    shards: DataFrame
    train: DataFrame
    held_out: DataFrame

    def counts(self) -> DataFrame:
        return packing.source_counts(self.train, self.val)

    def parts(self) -> DataFrame:
        """Shard parts of both splits: (split, stream, doc, shard, at, tokens)."""
        return packing.place_tokens(self.pieces, self.train.unionByName(self.held_out), self.settings)

    def blocks(self) -> DataFrame:
        return packing.blocks(self.parts(), self.shards, self.settings.block_size)


def laid_out(documents: DataFrame, turns: DataFrame, direction: str) -> DataFrame:
    """Pieces of both sources, tokens as text."""
    return packing.web_pieces(documents, direction).unionByName(
        chat.laid_out(chat.normalise(turns), direction)
    )


def words_of(documents: DataFrame, turns: DataFrame) -> DataFrame:
    """Vocabulary of both sources."""
    return vocabulary.build(vocabulary.count_tokens(laid_out(documents, turns, "forward")))


def build(
    documents: DataFrame,
    turns: DataFrame,
    settings: PackSettings | Callable[[int], PackSettings],
    words: DataFrame | None = None,
    direction: str = "reverse",
) -> Corpus:
    """Documents and conversation turns to a packed corpus, of ids if ``words`` is given.

    Laid-out pieces are written once; planning then reads only their sizes. Settings
    that depend on how many tokens there are come as a function of that number, for
    pieces laid out in ``direction``.
    """
    if isinstance(settings, PackSettings):
        direction = settings.direction
    pieces = laid_out(documents, turns, direction)
    if words is not None:
        pieces = vocabulary.encode_arrays(pieces, ["source", "doc", "piece"], "tokens", words)
    pieces = stage(pieces.withColumn("n", F.size("tokens").cast("bigint")), "pieces")
    spans = stage(packing.offsets(pieces), "spans")
    if not isinstance(settings, PackSettings):
        settings = settings(spans.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    val, limits = packing.split_plan(spans, settings)
    return Corpus(
        settings=settings,
        pieces=pieces,
        spans=spans,
        val=val,
        limits=limits,
        shards=packing.corpus_shards(limits, val, settings),
        train=packing.train_spans(spans, limits),
        held_out=packing.val_spans(spans, val, limits),
    )
