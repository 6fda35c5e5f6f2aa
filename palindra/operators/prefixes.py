"""Which token sequences a document begins with.

A document is pieces (doc, piece, tokens) of any number, so its opening is never put into
one row to look for prefixes. The value of a prefix is a sum over its tokens and their
places: sums of earlier pieces run along a document, and inside a piece only the lengths
that some prefix has are summed up. Documents and prefixes then meet on length and value,
and those that do are compared token by token, piece by piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palindra.operators.ordered import Running, attach, running
from palindra.operators.packing import BITS
from palindra.session import stage

#: Lengths that are looked up together: 64.
LENGTH_BITS = 6
#: Parts that the documents with one opening are dealt in.
PARTS = 16


def value(tokens: Column, first: Column) -> Column:
    """What the tokens, the first one at place ``first``, add to a prefix's value: 32 bits each."""
    terms = F.transform(tokens, lambda t, i: F.xxhash64(t, (first + i).cast("bigint")).bitwiseAND(F.lit((1 << 32) - 1)))
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda s, t: s + t)


def openings(pieces: DataFrame, lengths: DataFrame) -> DataFrame:
    """(doc, length, value) of the documents' prefixes of the given lengths; ``pieces`` are
    (doc, piece, tokens, n, at), the last their place in the document."""
    whole = value(F.col("tokens"), F.col("at"))
    known = running(pieces, ["doc"], ["piece"], [Running("sum", whole, "_before")], BITS)
    block = F.sequence(F.shiftright(F.col("at") + 1, LENGTH_BITS), F.shiftright(F.col("at") + F.col("n"), LENGTH_BITS))
    asked = known.withColumn("_block", F.explode(block)).join(
        lengths.withColumn("_block", F.shiftright("length", LENGTH_BITS)), "_block"
    )
    inside = asked.where((F.col("length") > F.col("at")) & (F.col("length") <= F.col("at") + F.col("n")))
    part = F.slice("tokens", F.lit(1), F.greatest(F.col("length") - F.col("at"), F.lit(0)).cast("int"))
    return inside.select("doc", "length", (F.col("_before") + value(part, F.col("at"))).alias("value"))


def beginning_with(pieces: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(doc, prefix): documents of ``pieces`` and the ``prefixes`` (prefix, tokens) that they
    begin with. ``prefix`` names a sequence; an empty one begins nothing.
    """
    sought = stage(
        prefixes.where(F.size("tokens") > 0).select(
            "prefix", F.size("tokens").cast("bigint").alias("length"), value(F.col("tokens"), F.lit(0)).alias("value"), "tokens"
        ),
        "prefixes",
    )
    lengths = stage(sought.select("length").distinct(), "lengths")
    longest = lengths.agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]
    sized = stage(pieces.select("doc", "piece", "tokens", F.size("tokens").cast("bigint").alias("n")), "sized")
    place = running(sized.select("doc", "piece", "n"), ["doc"], ["piece"], [Running("sum", F.col("n"), "at")], BITS)
    # What lies behind the longest prefix is not looked at again.
    placed = stage(sized.join(place.where(F.col("at") < longest).drop("n"), ["doc", "piece"]), "placed")
    found = openings(placed, lengths)
    # Very many documents may share a short opening.
    met = attach(
        found, ["length", "value"], F.pmod(F.xxhash64("doc"), F.lit(PARTS)), F.lit(PARTS), sought.select("length", "value", "prefix")
    )
    pairs = stage(met.select("doc", "prefix", "length"), "met")
    spread = F.pmod(F.xxhash64("doc"), F.lit(PARTS))
    told = attach(pairs.select("doc", "prefix", "length"), ["prefix"], spread, F.lit(PARTS), sought.select("prefix", F.col("tokens").alias("_sought")))
    both = told.join(placed, "doc").where(F.col("at") < F.col("length"))
    shared = F.greatest(F.least(F.col("n"), F.col("length") - F.col("at")), F.lit(0)).cast("int")
    own = F.slice("tokens", F.lit(1), shared)
    theirs = F.slice("_sought", (F.col("at") + 1).cast("int"), shared)
    return both.groupBy("doc", "prefix").agg(F.bool_and(own == theirs).alias("same")).where("same").select("doc", "prefix")
