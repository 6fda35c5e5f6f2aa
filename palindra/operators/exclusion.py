"""Leaving out rows whose id was used before, without moving the rest.

The used ids are put into a Bloom filter by Spark's bitmap aggregates: a row per 32,768
bits, which combine before their shuffle. Rows whose id the filter does not hold are new
and stay where they are. Only ids that it holds are compared exactly, as ids alone; of
those, the few that it holds wrongly come back.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palindra.session import stage

#: Bits of the filter for each used id; two of them are set, so it holds about 1.4 % of new ids.
BITS_PER_ID = 16
#: Bytes of a filter that may be sent to all executors: 33 million ids.
MOST_BYTES = 64 << 20
_ROW_BITS = 1 << 15


def _places(keys: Sequence[str], bits: int) -> list[Column]:
    """Two places in the filter, from 1."""
    return [F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(i)), F.lit(bits)) + 1 for i in range(2)]


def filter_size(ids: int) -> int:
    """Bits of the filter of so many ids: a power of two."""
    return max(_ROW_BITS, 1 << (ids * BITS_PER_ID - 1).bit_length())


def bloom_filter(used: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """(row, bitmap) of the ids in ``used``."""
    place = F.explode(F.array(*_places(keys, bits))).alias("p")
    return (
        used.select(place)
        .groupBy(F.bitmap_bucket_number("p").alias("row"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))
    )


def with_hold(rows: DataFrame, filter_rows: DataFrame, keys: Sequence[str], bits: int, name: str) -> DataFrame:
    """Add whether the filter holds a row's id; it holds every used one. A null is never used."""
    out, held = rows, [F.col(k).isNotNull() for k in keys]
    for i, place in enumerate(_places(keys, bits)):
        bitmap, row = f"_bitmap{i}", f"_row{i}"
        side = F.broadcast(filter_rows.select(F.col("row").alias(row), F.col("bitmap").alias(bitmap)))
        out = out.join(side, F.bitmap_bucket_number(place) == F.col(row), "left").drop(row)
        at = F.bitmap_bit_position(place)
        byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10)
        bit = F.call_function("shiftright", byte.cast("int"), F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(1)
        held.append(F.col(bitmap).isNotNull() & (bit != 0))
    kept = reduce(lambda a, b: a & b, held)
    return out.select(*rows.columns, kept.alias(name))


def not_used(rows: DataFrame, used: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose id is not in ``used``; rows with a null in it stay.

    A filter of more than ``MOST_BYTES`` is not sent around: rows are then joined to the
    used ids by a shuffle, with the same result.
    """
    keys = list(keys)
    ids = used.select(*keys).dropna().distinct()
    n = ids.count()
    if n == 0:
        return rows
    bits = filter_size(n)
    if bits // 8 > MOST_BYTES:
        return rows.join(ids, keys, "left_anti")
    tested = with_hold(rows, stage(bloom_filter(ids, keys, bits), "used-filter"), keys, bits, "_held")
    wrongly = stage(tested.where("_held").select(*keys).join(ids, keys, "left_anti").distinct(), "held-wrongly")
    new = tested.where(~F.col("_held")).unionByName(tested.where("_held").join(wrongly, keys, "left_semi"))
    return new.select(*rows.columns)
