"""Text helpers: strip, collapse, lossless tokens, chat markup. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers and separators of the chat format.
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
EOS = "<|endoftext|>"
PARAGRAPH = "\n\n"

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RUN = (
    r"[\t\n\x0b\x0c\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)

# Lossless: concatenating the matches gives the text back. A word keeps its
# leading space, a marker stays whole. Valid in Java and RE2 alike.
TOKEN = r"<\|im_(?:start|end)\|>| ?[^ \t\n\r\f<]+|<|[ \t\n\r\f]+"

# A rendered turn, and the end of text as the last turn's limit.
TURN = r"(?s)<\|im_start\|>([0-9A-Za-z_]+)\n(.*?)(?:<\|im_end\|>|\z)"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def collapse(text: Column) -> Column:
    """Runs of whitespace become one space, none at either end."""
    return F.regexp_replace(strip(text), WHITESPACE_RUN, " ")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def detokenize(toks: Column) -> Column:
    return F.array_join(toks, "")


def valid_text(text: Column) -> Column:
    """Replace byte sequences that are not valid text."""
    return F.make_valid_utf8(text)


def turn_markup(role: Column, content: Column) -> Column:
    return F.concat(F.lit(IM_START), role, F.lit("\n"), content, F.lit(IM_END))


def chat_markup(turns: Column) -> Column:
    """ARRAY<STRUCT<role, content>> as chat text: newline between turns, none after."""
    return F.array_join(F.transform(turns, lambda t: turn_markup(t["role"], t["content"])), "\n")


def extract_turns(text: Column) -> Column:
    """ARRAY<STRUCT<role, content>> from chat text; contents are stripped."""
    return F.zip_with(
        F.regexp_extract_all(text, F.lit(TURN), F.lit(1)),
        F.regexp_extract_all(text, F.lit(TURN), F.lit(2)),
        lambda role, content: F.struct(role.alias("role"), strip(content).alias("content")),
    )


def extract_question(text: Column) -> Column:
    """Content of the first user turn, else the stripped text."""
    asked = F.filter(extract_turns(text), lambda t: t["role"] == "user")
    return F.coalesce(F.get(asked, F.lit(0))["content"], strip(text))
