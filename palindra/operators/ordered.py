"""Running values over an order, without putting a key's rows into one task.

A plain ``Window.partitionBy(key).orderBy(seq)`` sends every row of a key to one
task. Here rows are windowed in chunks of ``2**bits`` consecutive order values;
each chunk is summarised to one row, the same question is asked of the summaries,
and the answer is joined back on the chunk. Because (key, order) is unique, a
chunk cannot hold more than ``2**bits`` rows, whatever the skew of the key.

Chunks follow from the order values: no sampling and no dependence on partition
ids, so a recomputed task gives the same rows. Summaries are written to the shared
folder. That keeps a chain of such steps linear, where self-joins would double the
work at each step, and tells how many there are: below ``ONE_WINDOW`` they take a
plain window, beyond it they are chunked again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palindra.session import stage

# Chunk widths in bits. Any 63-bit id is covered: 65,536 rows per chunk, 262,144
# summaries per parent twice, and at most 2,048 rows in the last window.
ID_BITS = (16, 18, 18)
# For a position counter below 2**31: 131,072 rows at most in the last window.
POSITION_BITS = (14,)
# Summaries that may share one window.
ONE_WINDOW = 1 << 20


@dataclass(frozen=True)
class Running:
    """One running column: the ``kind`` of all earlier rows' ``value``.

    ``sum`` starts at 0; ``min``, ``max`` and ``last`` (latest non-null value)
    start at null. The current row is excluded in every case.
    """

    kind: str
    value: Column
    name: str


def _over_earlier(kind: str, value: str, window) -> Column:
    fold = {
        "sum": F.sum(value),
        "min": F.min(value),
        "max": F.max(value),
        "last": F.last(value, ignorenulls=True),
    }[kind]
    return fold.over(window)


def _summarise(kind: str, value: str, order: str) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](value)


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "last":
        return F.coalesce(local, carry)
    return F.least(carry, local) if kind == "min" else F.greatest(carry, local)


def _scan(df, keys, order, kinds, bits, depth):
    values = [f"_v{i}" for i in range(len(kinds))]
    last, lead = order[-1], list(order[:-1])
    widths = bits.get(last, ())
    if widths:
        parent = f"_c{depth}"
        df = df.withColumn(parent, F.shiftright(F.col(last), widths[0]))
        parent_order = [*lead, parent]
        parent_bits = {**bits, parent: tuple(widths[1:])}
    else:
        parent_order, parent_bits = lead, bits
    group = [*keys, *parent_order]
    local = _windowed(df, group, [last], kinds)
    if not parent_order:
        return local
    summary = stage(
        df.groupBy(*group).agg(*[_summarise(k, v, last).alias(v) for k, v in zip(kinds, values)]),
        "summary",
    )
    if summary.count() <= ONE_WINDOW:
        scanned = _windowed(summary, keys, parent_order, kinds)
    else:
        scanned = _scan(summary, keys, parent_order, kinds, parent_bits, depth + 1)
    carried = scanned.select(
        *group, *[F.col(f"_r{i}").alias(f"_carry{i}") for i in range(len(kinds))]
    )
    keep = [F.col(c) for c in df.columns]
    return local.join(carried, group).select(
        *keep,
        *[_combine(k, F.col(f"_carry{i}"), F.col(f"_r{i}")).alias(f"_r{i}") for i, k in enumerate(kinds)],
    )


def _windowed(df, group, order, kinds):
    spec = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order)
    spec = spec.rowsBetween(Window.unboundedPreceding, -1)
    return df.select("*", *[_over_earlier(k, f"_v{i}", spec).alias(f"_r{i}") for i, k in enumerate(kinds)])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[Running],
    bits: Mapping[str, tuple[int, ...]] | None = None,
) -> DataFrame:
    """Add one column per ``Running``; ``keys + order`` must be unique and non-null.

    The order columns are non-negative integers, most significant first. ``bits``
    gives chunk widths per order column and defaults to ``ID_BITS``.
    """
    bits = {c: ID_BITS for c in order} | dict(bits or {})
    base = df.select("*", *[c.value.alias(f"_v{i}") for i, c in enumerate(columns)])
    kinds = [c.kind for c in columns]
    out = _scan(base, list(keys), list(order), kinds, bits, 0)
    found = [F.coalesce(f"_r{i}", F.lit(0)) if k == "sum" else F.col(f"_r{i}") for i, k in enumerate(kinds)]
    return out.select(*df.columns, *[r.alias(c.name) for r, c in zip(found, columns)])


#: Maps that are composed in one row: 64.
MAP_BITS = 6
#: Stands for a product of factors that is too small for a double, so that an infinite value stays one.
LEAST_FACTOR = 1e-300


@dataclass(frozen=True)
class Maps:
    """Values that rows map one to the next: ``then(x, row)`` is the value behind a row, ``start``
    the one before the first. ``both(m, row)`` is the map of what ``m`` stands for and the
    row behind it, ``none`` the map that changes nothing."""

    start: Column
    then: Callable[[Column, Column], Column]
    none: Column
    both: Callable[[Column, Column], Column]


def mapped(df: DataFrame, keys: Sequence[str], order: str, row: Column, maps: Maps, name: str) -> DataFrame:
    """Add the value before each row.

    Maps compose, so ``2**MAP_BITS`` neighbours become one row and one map, the same
    question is asked of those rows, and the answer is carried on inside each: no row
    holds more than so many maps, however many a key has. ``order`` is a non-negative
    integer that is unique in its key, best without gaps.
    """
    found = _mapped(df.select(*keys, order, row.alias("_m")), list(keys), order, maps, 0)
    return df.join(found.withColumnRenamed("_x", name), [*keys, order])


def _mapped(rows: DataFrame, keys: list[str], order: str, maps: Maps, depth: int) -> DataFrame:
    """(keys, order, _x) of (keys, order, _m)."""
    group = f"_g{depth}"
    near = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "_m"))).alias("_maps")
    packed = stage(rows.groupBy(*keys, F.shiftright(order, MAP_BITS).alias(group)).agg(near), "maps")
    if packed.where(F.col(group) > 0).isEmpty():
        begun = packed.withColumn("_x", maps.start)
    else:
        whole = packed.select(*keys, group, F.aggregate("_maps", maps.none, lambda m, r: maps.both(m, r["_m"])).alias("_m"))
        begun = packed.join(_mapped(whole, keys, group, maps, depth + 1), [*keys, group])
    placed = begun.select(*keys, "_x", "_maps", F.posexplode("_maps").alias("_k", "_r"))
    upto = F.aggregate(F.slice("_maps", F.lit(1), F.col("_k")), F.col("_x"), lambda x, r: maps.then(x, r["_m"]))
    return placed.select(*keys, F.col("_r.at").alias(order), upto.alias("_x"))


def affine(df: DataFrame, keys: Sequence[str], order: str, a: Column, b: Column, name: str) -> DataFrame:
    """Add the value that all earlier rows of a key make of 0, each mapping x to ``a * x + b``
    with a positive ``a``."""

    def both(m: Column, r: Column) -> Column:
        factor = F.greatest(r["a"] * m["a"], F.lit(LEAST_FACTOR))
        return F.struct(factor.alias("a"), (r["a"] * m["b"] + r["b"]).alias("b"))

    row = F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))
    none = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    maps = Maps(F.lit(0.0), lambda x, r: r["a"] * x + r["b"], none, both)
    return mapped(df, keys, order, row, maps, name)


def attach(
    df: DataFrame, keys: Sequence[str], spread: Column, parts: Column, per_key: DataFrame, how: str = "inner"
) -> DataFrame:
    """Join a table of one row per key to rows whose keys may be of any size.

    ``spread`` numbers the parts a key's rows are split into and ``parts`` says how
    many the key has. Its row in the table is repeated for each, so the join is
    keyed on both and no task gets more of a hot key than one part. The repeated
    table is joined by a shuffle: its size estimate is that of the table before
    the repeating, so a broadcast would build up to ``parts`` times more rows on
    the driver than planned.
    """
    added = [c for c in per_key.columns if c not in keys]
    repeated = per_key.withColumn("_spread", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    rows = df.withColumn("_spread", spread.cast("bigint"))
    return rows.join(repeated.hint("merge"), [*keys, "_spread"], how).select(*df.columns, *added)


def attach_totals(
    df: DataFrame, keys: Sequence[str], spread: Column, totals: Mapping[str, Column]
) -> DataFrame:
    """Give every row its key's aggregates; these combine before their shuffle."""
    per_key = df.groupBy(*keys).agg(
        *[c.alias(n) for n, c in totals.items()], (F.max(spread) + 1).cast("bigint").alias("_parts")
    )
    return attach(df, keys, spread, F.col("_parts"), stage(per_key, "totals")).drop("_parts")


def upper_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Per key, element ``n div 2`` of the sorted values; they must not be negative.

    Equal values are counted first. Ranks are running sums over the distinct
    values, so no task holds the values of a key.
    """
    distinct = stage(
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count("*").alias("_n"))
        .withColumn("_key", sort_key(F.col(value))),
        "distinct",
    )
    ranked = running(distinct, keys, ["_key"], [Running("sum", F.col("_n"), "_before")])
    sizes = distinct.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    sized = attach(ranked, keys, F.pmod("_key", F.lit(64)), F.lit(64), sizes)
    middle = F.expr("_all div 2")
    return sized.where((F.col("_before") <= middle) & (middle < F.col("_before") + F.col("_n"))).select(
        *keys, F.col(value).alias(name)
    )


def newest(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, spread: Column
) -> DataFrame:
    """Rows ranked 1..n per key under ``order``, with the rank in ``rank``.

    A first ranking inside (key, spread) leaves at most n rows per pair, so the
    final ranking sees n rows times the number of spread values.
    """
    near = Window.partitionBy(*keys, "_spread").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_spread", spread)
        .withColumn("_near", F.row_number().over(near))
        .where(F.col("_near") <= n)
        .withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= n)
        .drop("_spread", "_near")
    )


def dense_index(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number all rows 0..n-1 in a total order of any type.

    One range shuffle sorts the rows. Their place (partition, row) is written to
    the shared folder before the partition sizes are read, since range bounds
    come from sampling and could differ in a second run. Only the partition
    starts, one row per shuffle partition, are broadcast.
    """
    placed = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "index",
    ).withColumn("_part", F.shiftright("_place", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    row = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_start") + row).alias(name)
    )


def sort_key(value: Column) -> Column:
    """An integer that orders non-negative doubles exactly as they compare.

    Exponent and mantissa in one BIGINT; scaling by a power of two is exact.
    """
    guess = F.floor(F.log2(value))
    scaled = value / F.pow(F.lit(2.0), guess)
    exponent = F.when(scaled >= 2, guess + 1).when(scaled < 1, guess - 1).otherwise(guess)
    mantissa = value / F.pow(F.lit(2.0), exponent) - 1
    packed = (exponent + 1023) * F.lit(1 << 52) + (mantissa * F.lit(float(1 << 52))).cast("bigint")
    return F.when(value > 0, packed.cast("bigint") + 1).otherwise(F.lit(0).cast("bigint"))
