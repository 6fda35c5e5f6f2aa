"""From laid-out documents to shards and blocks.

Input is *pieces*: (source, doc, piece, tokens, starts_doc, ends_doc). A web
document is one piece, a conversation one piece per turn. ``source`` and ``doc``
order the stream, ``piece`` orders a document. Everything before block assembly
works on piece sizes only; token arrays move twice, to meet their offset and to
meet their block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palindra.functions import layout, text as txt
from palindra.operators.ordered import ID_BITS, POSITION_BITS, Running, running
from palindra.session import stage

SOURCES = ("web", "chat")
BITS = {"doc": ID_BITS, "piece": (POSITION_BITS[0],)}


@dataclass(frozen=True)
class PackSettings:
    """Sizes of one corpus. The token budget counts emitted tokens."""

    max_tokens: int
    chat_frac: Fraction = Fraction(1, 5)
    val_tokens: int = 5_000_000
    shard_tokens: int = 250_000_000
    block_size: int = 1024
    direction: str = "reverse"

    @property
    def chat_target(self) -> int:
        return int(self.max_tokens * self.chat_frac)

    @property
    def web_target(self) -> int:
        return self.max_tokens - self.chat_target


def web_pieces(docs: DataFrame, direction: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of text documents; null and empty texts drop out, blank ones stay."""
    laid = layout.orient(
        txt.tokens(F.col(text)), direction, F.lit(txt.EOS), F.lit(txt.IM_START), F.lit(txt.IM_END)
    )
    return docs.where(F.length(text) > 0).select(
        F.lit("web").alias("source"),
        F.col(doc_id).alias("doc"),
        F.lit(0).cast("bigint").alias("piece"),
        laid.alias("tokens"),
        F.lit(True).alias("starts_doc"),
        F.lit(True).alias("ends_doc"),
    )


def offsets(pieces: DataFrame) -> DataFrame:
    """Sizes with their start in the source's token stream.

    Where ``pieces`` is a table with an ``n`` column tokens are not read at all;
    otherwise the sizes are written down first, so that text is cut into tokens once.
    """
    columns = ("source", "doc", "piece", "n", "starts_doc", "ends_doc")
    if "n" in pieces.columns:
        sized = pieces.select(*columns)
    else:
        sized = stage(pieces.withColumn("n", F.size("tokens").cast("bigint")).select(*columns), "sizes")
    return running(sized, ["source"], ["doc", "piece"], [Running("sum", F.col("n"), "start")], BITS)


def document_cut(spans: DataFrame, target: Mapping[str, int] | Column, origin: Column | None = None) -> DataFrame:
    """Per source, the first document end at or past its target (``cut``), or the
    whole length when the target is not reached. A row per source, so two rows."""
    if not isinstance(target, Column):
        pairs = [F.lit(x) for kv in target.items() for x in kv]
        target = F.create_map(*pairs)[F.col("source")]
    origin = F.lit(0) if origin is None else origin
    end = F.col("start") + F.col("n") - origin
    reached = F.col("ends_doc") & (end >= target)
    # A target that is already met takes nothing.
    return spans.groupBy("source").agg(
        F.when(F.first(target) <= 0, F.lit(0))
        .otherwise(F.coalesce(F.min(F.when(reached, end)), F.max(end), F.lit(0)))
        .cast("bigint")
        .alias("cut")
    )


def _interleave_key(frac: Fraction) -> Column:
    """A BIGINT giving the order in which the greedy mix takes documents.

    With share N/D, a chat document at c chat tokens precedes a web document at w
    web tokens while (D-N)*c < N*w. The two low bits break ties: an untouched chat
    stream goes first, otherwise web does.
    """
    n, d = frac.numerator, frac.denominator
    chat = F.col("source") == "chat"
    start = F.col("start")
    far = F.lit(1 << 61)
    if n <= 0:
        return F.when(chat, far + start).otherwise(start)
    if n >= d:
        # A share of one is only missed once web has tokens: one web document goes in
        # behind the first chat document, the others when chat is used up.
        first = start == 0
        return F.when(chat, F.when(first, 0).otherwise(start + 1)).otherwise(F.when(first, 1).otherwise(far + start))
    tie = F.when(~chat, 1).when(start == 0, 0).otherwise(2)
    return F.when(chat, start * (d - n)).otherwise(start * n) * 4 + tie


def validation_documents(spans: DataFrame, val_tokens: int, frac: Fraction) -> DataFrame:
    """Documents of the validation split: (source, doc, start, n, val_start).

    A document can only be taken if its own source holds fewer than ``val_tokens``
    tokens before it, so at most ``val_tokens`` rows per source pass the first
    filter, however large the corpus.
    """
    opening = spans.where(F.col("starts_doc") & (F.col("start") < val_tokens))
    limits = document_cut(spans, F.lit(val_tokens))
    by_doc = Window.partitionBy("source").orderBy("doc")
    docs = (
        opening.select("source", "doc", "start")
        .join(F.broadcast(limits), "source")
        .withColumn("n", F.coalesce(F.lead("start").over(by_doc), F.col("cut")) - F.col("start"))
        .withColumn("mix", _interleave_key(frac))
        .select("source", "doc", "start", "n", "mix")
    )
    merged = running(docs, [], ["mix"], [Running("sum", F.col("n"), "val_start")])
    return merged.where(F.col("val_start") < val_tokens).drop("mix")


def split_plan(spans: DataFrame, settings: PackSettings) -> tuple[DataFrame, DataFrame]:
    """(validation documents, per-source limits).

    Both streams are consumed front to back, so validation holds the first
    documents of each source and training begins where they end: ``val_end`` is
    that offset and ``train_end`` the offset of the first document end at which
    training has reached its target. No anti-join is needed.
    """
    val = stage(validation_documents(spans, settings.val_tokens, settings.chat_frac), "val-docs")
    val_end = val.groupBy("source").agg(F.max(F.col("start") + F.col("n")).alias("val_end"))
    sources = spans.groupBy("source").agg(F.max(F.col("start") + F.col("n")).alias("length"))
    begun = sources.join(val_end, "source", "left").select(
        "source", "length", F.coalesce("val_end", F.lit(0)).alias("val_end")
    )
    training = spans.join(F.broadcast(begun), "source").where(F.col("start") >= F.col("val_end"))
    cuts = document_cut(
        training, {"web": settings.web_target, "chat": settings.chat_target}, F.col("val_end")
    )
    limits = begun.join(cuts, "source", "left").select(
        "source", "length", "val_end", (F.col("val_end") + F.coalesce("cut", F.lit(0))).alias("train_end")
    )
    return val, stage(limits, "limits")


def train_spans(spans: DataFrame, limits: DataFrame) -> DataFrame:
    """Training pieces with offsets that begin at 0 per source."""
    return (
        spans.join(F.broadcast(limits), "source")
        .where((F.col("start") >= F.col("val_end")) & (F.col("start") < F.col("train_end")))
        .select(
            F.lit("train").alias("split"),
            "source",
            "doc",
            "piece",
            "n",
            "starts_doc",
            "ends_doc",
            (F.col("start") - F.col("val_end")).alias("start"),
        )
    )


def val_spans(spans: DataFrame, val: DataFrame, limits: DataFrame) -> DataFrame:
    """Validation pieces with offsets in the one interleaved shard."""
    front = spans.join(F.broadcast(limits), "source").where(F.col("start") < F.col("val_end"))
    docs = val.select("source", "doc", "val_start", F.col("start").alias("_doc_start"))
    return front.join(docs, ["source", "doc"]).select(
        F.lit("val").alias("split"),
        "source",
        "doc",
        "piece",
        "n",
        "starts_doc",
        "ends_doc",
        (F.col("val_start") + F.col("start") - F.col("_doc_start")).alias("start"),
    )


def shards(lengths: DataFrame, settings: PackSettings) -> DataFrame:
    """Shard table of a corpus from stream lengths (split, stream, length).

    All shards of a stream but its last are full, so the table follows from the
    length alone. ``first_block`` continues across streams in split order: web
    before chat.
    """
    full, size = settings.shard_tokens, settings.block_size
    listed = lengths.where(F.col("length") > 0).select(
        "split",
        "stream",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / full))).alias("shard"),
        "length",
    )
    tokens = F.least(F.lit(full), F.col("length") - F.col("shard") * full).cast("bigint")
    counted = listed.select(
        "split",
        "stream",
        "shard",
        tokens.alias("tokens"),
        F.greatest(F.lit(0), F.expr(f"(least({full}, length - shard * {full}) - 1) div {size}")).cast("bigint").alias("blocks"),
    )
    # One row per shard of 2.5e8 tokens: 80,000 rows for a corpus of 2e13.
    before = (
        Window.partitionBy("split")
        .orderBy(F.col("stream") == "chat", "shard")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return counted.withColumn("first_block", F.coalesce(F.sum("blocks").over(before), F.lit(0)))


def stream_lengths(limits: DataFrame, val: DataFrame) -> DataFrame:
    """(split, stream, length): one training stream per source, one for validation."""
    train = limits.select(
        F.lit("train").alias("split"),
        F.col("source").alias("stream"),
        (F.col("train_end") - F.col("val_end")).alias("length"),
    )
    held = val.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("length")).select(
        F.lit("val").alias("split"), F.lit("val").alias("stream"), "length"
    )
    return train.unionByName(held)


def shard_lengths_for(settings: PackSettings, split: str) -> PackSettings:
    """Validation is a single shard, one million tokens beyond its target."""
    if split == "train":
        return settings
    return PackSettings(**{**settings.__dict__, "shard_tokens": settings.val_tokens + 1_000_000})


def corpus_shards(limits: DataFrame, val: DataFrame, settings: PackSettings) -> DataFrame:
    lengths = stream_lengths(limits, val)
    return shards(lengths.where(F.col("split") == "train"), settings).unionByName(
        shards(lengths.where(F.col("split") == "val"), shard_lengths_for(settings, "val"))
    )


def shard_parts(placed: DataFrame, shard_tokens: int | str) -> DataFrame:
    """Cut placed pieces (start, tokens, ...) at shard ends; ``at`` is the offset
    inside the shard. ``shard_tokens`` is a number or the column that has it. Parts are
    sliced before they are exploded, so a row never carries the whole document once per
    part."""
    start, n = F.col("start"), F.size("tokens")
    full = F.col(shard_tokens) if isinstance(shard_tokens, str) else F.lit(shard_tokens)
    full = full.cast("bigint")
    first = F.call_function("div", start, full)
    last = F.call_function("div", start + n - 1, full)

    def part(shard: Column) -> Column:
        begin = F.greatest(start, shard * full)
        end = F.least(start + n, (shard + 1) * full)
        return F.struct(
            shard.alias("shard"),
            (begin - shard * full).alias("at"),
            F.slice("tokens", (begin - start + 1).cast("int"), (end - begin).cast("int")).alias("tokens"),
        )

    rest = [c for c in placed.columns if c not in ("start", "tokens", "n", shard_tokens)]
    return placed.where(n > 0).select(
        *rest, F.explode(F.transform(F.sequence(first, last), part)).alias("s")
    ).select(*rest, "s.*")


def place_tokens(pieces: DataFrame, spans: DataFrame, settings: PackSettings) -> DataFrame:
    """Shard parts of the spans of both splits: (split, stream, doc, shard, at, tokens).

    Tokens meet their place in one join, whatever their split.
    """
    held = F.col("split") == "val"
    where = spans.select(
        "split",
        "source",
        "doc",
        "piece",
        "start",
        F.when(held, "val").otherwise(F.col("source")).alias("stream"),
        F.when(held, shard_lengths_for(settings, "val").shard_tokens).otherwise(settings.shard_tokens).alias("_full"),
    )
    tokens = pieces.select("source", "doc", "piece", "tokens")
    placed = tokens.join(where, ["source", "doc", "piece"])
    return shard_parts(placed.select("split", "stream", "doc", "start", "_full", "tokens"), "_full")


def block_parts(parts: DataFrame, block_size: int) -> DataFrame:
    """Cut shard parts (at, tokens) at blocks. A block spans ``block_size + 1``
    tokens and shares its last one with the next block."""
    at, n = F.col("at"), F.size("tokens")
    low = F.expr(f"greatest(0, (at + {block_size} - 1) div {block_size} - 1)")
    high = F.expr(f"(at + size(tokens) - 1) div {block_size}")

    def part(block: Column) -> Column:
        begin = F.greatest(at, block * block_size)
        end = F.least(at + n, block * block_size + block_size + 1)
        return F.struct(
            block.alias("block"),
            begin.alias("at"),
            F.slice("tokens", (begin - at + 1).cast("int"), (end - begin).cast("int")).alias("tokens"),
        )

    rest = [c for c in parts.columns if c not in ("at", "tokens")]
    return parts.select(*rest, F.explode(F.transform(F.sequence(low, high), part)).alias("b")).select(
        *rest, "b.*"
    )


def blocks(parts: DataFrame, shard_table: DataFrame, block_size: int, group_blocks: int = 32_768) -> DataFrame:
    """(split, stream, shard, block, block_idx, tokens) of every whole block.

    The shuffle key is a run of consecutive blocks of one shard, so the same
    shuffle assembles blocks and leaves them placed for the shard writer. A group
    is at most ``block_size + 1`` tokens. The shard table joins by broadcast when
    AQE measures it small, else by shuffle.
    """
    cut = block_parts(parts, block_size).withColumn("run", F.expr(f"block div {group_blocks}"))
    whole = (
        cut.repartition("split", "stream", "shard", "run")
        .groupBy("split", "stream", "shard", "run", "block")
        .agg(F.array_sort(F.collect_list(F.struct("at", "tokens"))).alias("pieces"))
        .select(
            "split",
            "stream",
            "shard",
            "block",
            F.flatten(F.transform("pieces", lambda p: p["tokens"])).alias("tokens"),
        )
    )
    return (
        whole.where(F.size("tokens") == block_size + 1)
        .join(
            shard_table.select("split", "stream", "shard", "blocks", "first_block"),
            ["split", "stream", "shard"],
        )
        .where(F.col("block") < F.col("blocks"))
        .select(
            "split",
            "stream",
            "shard",
            "block",
            (F.col("first_block") + F.col("block")).alias("block_idx"),
            "tokens",
        )
    )


def source_counts(train: DataFrame, val: DataFrame) -> DataFrame:
    """(source, docs, tokens, val_docs): documents and tokens of each source."""
    trained = train.groupBy("source").agg(
        F.count_if("ends_doc").alias("docs"), F.sum("n").alias("tokens")
    )
    held = val.groupBy("source").agg(F.count("*").alias("val_docs"))
    return trained.join(held, "source", "full").select(
        "source",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("docs", "tokens", "val_docs")],
    )


def totals(counts: DataFrame) -> DataFrame:
    """(total_tokens, chat_share) of a corpus; the share of an empty one is 0."""
    chat = F.sum(F.when(F.col("source") == "chat", F.col("tokens")).otherwise(0))
    total = F.sum("tokens")
    return counts.agg(
        F.coalesce(total, F.lit(0)).alias("total_tokens"),
        F.when(total > 0, chat / total).otherwise(0.0).alias("chat_share"),
    )


def union_in_order(frames: Sequence[DataFrame]) -> DataFrame:
    """Sources one after another; ``source_rank`` keeps their order."""
    out = None
    for rank, frame in enumerate(frames):
        ranked = frame.withColumn("source_rank", F.lit(rank))
        out = ranked if out is None else out.unionByName(ranked)
    return out


def split_stream(parts: DataFrame, shard_tokens: int, eos: str = txt.EOS) -> DataFrame:
    """(stream, number, tokens): documents of a packed stream, found by separators alone.

    A part knows how many separators precede it in its stream, so every part is
    cut where it lies and only lengths are summed per document.
    """
    seen = parts.select(
        "stream",
        (F.col("shard") * shard_tokens + F.col("at")).alias("pos"),
        F.size("tokens").alias("size"),
        F.filter(
            F.transform("tokens", lambda t, i: F.when(t == eos, i + 1)), lambda i: i.isNotNull()
        ).alias("ends"),
    )
    earlier = running(
        seen, ["stream"], ["pos"], [Running("sum", F.size("ends").cast("bigint"), "number")]
    )
    edges = F.array_distinct(F.concat(F.array(F.lit(0)), F.col("ends"), F.array(F.col("size"))))
    cuts = F.transform(
        F.sequence(F.lit(1), F.size(edges) - 1),
        lambda k: F.struct(
            (F.col("number") + k - 1).alias("number"),
            (
                F.get(edges, k)
                - F.get(edges, k - 1)
                - F.when(k <= F.size("ends"), 1).otherwise(0)
            )
            .cast("bigint")
            .alias("tokens"),
        ),
    )
    return (
        earlier.select("stream", F.explode(cuts).alias("d"))
        .groupBy("stream", "d.number")
        .agg(F.sum("d.tokens").alias("tokens"))
    )
