"""Short texts for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(seconds: Column, gap: str = "") -> Column:
    """Hours, minutes and seconds, never negative."""
    whole = F.greatest(F.lit(0), seconds.cast("bigint"))
    minutes = F.floor(whole / 60)
    return F.format_string(
        f"%dh{gap}%02dm{gap}%02ds", F.floor(whole / 3600), minutes % 60, whole % 60
    )


def age(seconds: Column) -> Column:
    def ago(unit: float, mark: str) -> Column:
        return F.concat(F.bround(seconds / unit).cast("bigint").cast("string"), F.lit(f"{mark} ago"))

    return (
        F.when(seconds < 90, ago(1, "s"))
        .when(seconds < 5400, ago(60, "m"))
        .when(seconds < 172800, ago(3600, "h"))
        .otherwise(ago(86400, "d"))
    )


def fraction(value: Column) -> Column:
    """A bar's filled share."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def bar(value: Column, width: int = 46) -> Column:
    """The share drawn in plain characters."""
    filled = F.bround(fraction(value) * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), F.lit(width) - filled))
