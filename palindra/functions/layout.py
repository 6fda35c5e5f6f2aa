"""Reading direction of a token array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIRECTIONS = ("reverse", "forward", "both")


def check_direction(direction: str) -> str:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}, got {direction!r}")
    return direction


def is_reverse(direction: Column | str) -> Column:
    """'both' counts as reverse."""
    direction = F.lit(direction) if isinstance(direction, str) else direction
    return direction.isin("reverse", "both")


def orient(
    toks: Column, direction: str, eos: Column, rev_marker: Column | None = None, fwd_marker: Column | None = None
) -> Column:
    """Lay a document out: the separator closes each copy, a marker opens it in 'both'."""
    check_direction(direction)
    end = F.array(eos)
    backward = F.concat(F.reverse(toks), end)
    forward = F.concat(toks, end)
    if direction == "reverse":
        return backward
    if direction == "forward":
        return forward
    parts = [backward, forward]
    for at, marker in ((0, rev_marker), (1, fwd_marker)):
        if marker is not None:
            parts[at] = F.concat(F.array(marker), parts[at])
    return F.concat(*parts)


def encode_prompt(
    toks: Column, direction: Column | str, eos: Column, im_end: Column, jeopardy: Column | bool = False
) -> Column:
    """A prompt in model order; never empty. Jeopardy matters only when reversed."""
    jeopardy = F.lit(jeopardy) if isinstance(jeopardy, bool) else jeopardy
    backward = F.when(jeopardy, F.concat(F.array(im_end), F.reverse(toks))).otherwise(F.reverse(toks))
    ids = F.when(is_reverse(direction), backward).otherwise(toks)
    return F.when(F.size(ids) == 0, F.array(eos)).otherwise(ids)


def reading_order(ids: Column, direction: Column | str) -> Column:
    """Model order back to reading order, prompt and completion at once."""
    return F.when(is_reverse(direction), F.reverse(ids)).otherwise(ids)


def shifted(block: Column) -> tuple[Column, Column]:
    """Inputs and next-token targets of a block."""
    n = F.size(block) - 1
    return F.slice(block, F.lit(1), n), F.slice(block, F.lit(2), n)


def starts_with(ids: Column, prefix: Column) -> Column:
    return F.slice(ids, F.lit(1), F.size(prefix)) == prefix
