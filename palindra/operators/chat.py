"""Conversations in long form: one row per turn, whatever the length of the whole.

Normalising looks at earlier turns only through running values, so a conversation
of any size is spread over tasks. The result is *pieces*: one row per surviving
input turn, with flags that say where a merged turn or the conversation starts
and ends. Markup, tokens and packing all work on pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palindra.functions import layout, text as txt
from palindra.operators.ordered import POSITION_BITS, Running, attach_totals, running

# Role names and what they stand for.
ROLE_ALIASES = {
    "user": "user",
    "human": "user",
    "prompter": "user",
    "assistant": "assistant",
    "gpt": "assistant",
    "model": "assistant",
    "bot": "assistant",
}

# Turn numbers are 32-bit positions; mirrored ones order a conversation backwards.
LAST_POSITION = (1 << 31) - 1


def _first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def unify_fields(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, malformed) from either field naming.

    Takes the columns that exist among role/from and content/value/text; an empty
    string falls through to the other name, whitespace does not.
    """
    have = set(turns.columns)
    roles = [F.col(c) for c in ("role", "from") if c in have]
    bodies = [F.col(c) for c in ("content", "text", "value") if c in have]
    malformed = F.col("malformed") if "malformed" in have else F.lit(False)
    return turns.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.lower(_first_filled(*roles)).alias("role"),
        txt.strip(_first_filled(*bodies)).alias("text"),
        malformed.alias("malformed"),
    )


def explode_messages(rows: DataFrame, conv_id: str, columns: Sequence[str]) -> DataFrame:
    """Nested conversations to long form; the first non-empty list column wins.

    The lists may be of different structs. A null element, or one that is no struct, marks
    the conversation as malformed.
    """
    present = [c for c in columns if c in rows.columns]
    kinds = {c: rows.schema[c].dataType.elementType for c in present}
    plain = [c for c in present if not isinstance(kinds[c], T.StructType)]
    fields = list(dict.fromkeys(f for c in present if c not in plain for f in kinds[c].fieldNames()))

    def widened(column: str) -> Column:
        """The list with all fields that any of the lists has; what is no struct becomes null."""
        if column in plain:
            return F.transform(column, lambda m: F.lit(None).cast(T.StructType([T.StructField(f, T.StringType()) for f in fields or ["role"]])))
        have = kinds[column].fieldNames()
        return F.transform(
            column,
            lambda m: F.when(
                m.isNotNull(),
                F.struct(*[(m[f].cast("string") if f in have else F.lit(None).cast("string")).alias(f) for f in fields]),
            ),
        )

    lists = [F.when(F.size(c) > 0, widened(c)) for c in present]
    exploded = rows.select(
        F.col(conv_id).alias("conv_id"), F.posexplode(F.coalesce(*lists)).alias("turn", "message")
    )
    fields = exploded.schema["message"].dataType.fieldNames()
    return exploded.select(
        "conv_id",
        "turn",
        *[F.col("message")[f].alias(f) for f in fields],
        F.col("message").isNull().alias("malformed"),
    )


def normalise(turns: DataFrame) -> DataFrame:
    """Pieces of usable conversations: (conv_id, turn, role, text, starts_turn,
    starts_conv, ends_conv).

    Empty turns and unknown roles vanish; a system text moves to the front of the
    next user turn, the latest one winning; turns after the last answer go; a
    conversation needs a user turn before an answer. Consecutive pieces of one
    role belong to the same merged turn, which ``starts_turn`` delimits.
    """
    rows = unify_fields(turns)
    alias = F.create_map(*[F.lit(x) for kv in ROLE_ALIASES.items() for x in kv])
    known = F.when(F.col("role") == "system", F.lit("system")).otherwise(
        F.try_element_at(alias, F.col("role"))
    )
    rows = (
        rows.withColumn("role", known)
        .where(F.col("malformed") | (F.col("role").isNotNull() & (F.col("text") != "")))
        .select("conv_id", "turn", "role", "text", "malformed")
    )
    at = F.col("turn")
    usable = attach_totals(
        rows,
        ["conv_id"],
        F.shiftright("turn", POSITION_BITS[0]),
        {
            "_bad": F.max("malformed"),
            "_asked": F.min(F.when(F.col("role") == "user", at)),
            "_answered": F.max(F.when(F.col("role") == "assistant", at)),
        },
    ).where(
        ~F.col("_bad") & (F.col("_asked") < F.col("_answered")) & (at <= F.col("_answered"))
    )
    speaker = F.when(F.col("role") != "system", F.col("role"))
    instruction = F.when(
        F.col("role").isin("system", "user"),
        F.struct((F.col("role") == "system").alias("open"), F.col("text").alias("text")),
    )
    seen = running(
        usable,
        ["conv_id"],
        ["turn"],
        [Running("last", speaker, "_speaker"), Running("last", instruction, "_instruction")],
        {"turn": POSITION_BITS},
    ).where(F.col("role") != "system")
    folded = F.when(
        (F.col("role") == "user") & F.col("_instruction.open"),
        F.concat(F.col("_instruction.text"), F.lit(txt.PARAGRAPH), F.col("text")),
    ).otherwise(F.col("text"))
    return seen.select(
        "conv_id",
        "turn",
        "role",
        folded.alias("text"),
        (~F.col("_speaker").eqNullSafe(F.col("role"))).alias("starts_turn"),
        F.col("_speaker").isNull().alias("starts_conv"),
        (at == F.col("_answered")).alias("ends_conv"),
    )


def number_turns(pieces: DataFrame) -> DataFrame:
    """Add ``merged_turn``, 0-based, shared by the pieces of one merged turn."""
    opened = F.col("starts_turn").cast("bigint")
    return running(
        pieces, ["conv_id"], ["turn"], [Running("sum", opened, "_opened")], {"turn": POSITION_BITS}
    ).select(*pieces.columns, (F.col("_opened") + opened - 1).alias("merged_turn"))


def markup(pieces: DataFrame) -> DataFrame:
    """Add ``markup``: concatenated in turn order, the chat text of a conversation."""
    header = F.concat(F.lit(txt.IM_START), F.col("role"), F.lit("\n"))
    opening = (
        F.when(F.col("starts_conv"), header)
        .when(F.col("starts_turn"), F.concat(F.lit(txt.IM_END + "\n"), header))
        .otherwise(F.lit(txt.PARAGRAPH))
    )
    closing = F.when(F.col("ends_conv"), F.lit(txt.IM_END)).otherwise(F.lit(""))
    return pieces.withColumn("markup", F.concat(opening, F.col("text"), closing))


def laid_out(pieces: DataFrame, direction: str, source: str = "chat") -> DataFrame:
    """Packable pieces (source, doc, piece, tokens, starts_doc, ends_doc).

    No piece boundary can fall inside a token: text is stripped, and markers and
    whitespace runs end a token on either side. So tokens of the pieces, in order,
    are the tokens of the whole conversation, and reversing the order of pieces
    and the tokens within each reverses the whole.
    """
    layout.check_direction(direction)
    toks = txt.tokens(F.col("markup"))
    eos = F.array(F.lit(txt.EOS))
    none = F.array().cast("array<string>")
    both = direction == "both"

    def copy(backward: bool) -> Column:
        first, last = ("ends_conv", "starts_conv") if backward else ("starts_conv", "ends_conv")
        marker = F.array(F.lit(txt.IM_START if backward else txt.IM_END))
        body = F.reverse(toks) if backward else toks
        place = F.lit(LAST_POSITION) - F.col("turn") if backward else F.col("turn")
        offset = 0 if backward or not both else LAST_POSITION + 1
        opens = F.col(first) if both else F.lit(False)
        return F.struct(
            (place + F.lit(offset)).alias("piece"),
            F.concat(
                F.when(opens, marker).otherwise(none), body, F.when(F.col(last), eos).otherwise(none)
            ).alias("tokens"),
            (F.col(first) & F.lit(backward or not both)).alias("starts_doc"),
            (F.col(last) & F.lit(not backward or not both)).alias("ends_doc"),
        )

    copies = [copy(True)] if direction == "reverse" else [copy(False)]
    if both:
        copies = [copy(True), copy(False)]
    return (
        markup(pieces)
        .select("conv_id", F.explode(F.array(*copies)).alias("p"))
        .select(F.lit(source).alias("source"), F.col("conv_id").alias("doc"), "p.*")
    )
