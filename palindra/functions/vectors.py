"""Diagnostics over stored logit vectors, ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relative tolerance per storage type.
TOLERANCE = {"float32": 1e-5, "float16": 2e-3, "bfloat16": 1.5e-2}
DEFAULT_TOLERANCE = 1e-5


def _bind(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities; the largest logit is taken out first."""
    scaled = F.transform(logits, lambda x: x / F.lit(max(1e-4, temperature)))
    powers = _bind(scaled, lambda v: F.transform(v, lambda x: F.exp(x - F.array_max(v))))
    return _bind(powers, lambda v: _bind(total(v), lambda z: F.transform(v, lambda x: x / z)))


def entropy(probs: Column) -> Column:
    return total(F.transform(probs, lambda p: -p * F.log(F.greatest(p, F.lit(1e-12)))))


def best(values: Column) -> Column:
    """0-based position of the first maximum."""
    return F.array_position(values, F.array_max(values)) - 1


def top(values: Column, k: int) -> Column:
    """The k largest as ARRAY<STRUCT<value, id>>, ids 0-based, lower id first on ties."""
    tagged = F.transform(values, lambda v, i: F.struct((-v).alias("neg"), i.alias("id")))
    return F.transform(
        F.slice(F.array_sort(tagged), 1, k),
        lambda s: F.struct((-s["neg"]).alias("value"), s["id"].alias("id")),
    )


def kept_by_top_k(values: Column, k: int) -> Column:
    """0-based ids at or above the k-th largest value, ties included."""
    kth = F.sort_array(values, asc=False)[F.least(F.lit(k), F.size(values)) - 1]
    return _bind(
        F.struct(values.alias("v"), kth.alias("t")),
        lambda s: F.filter(F.sequence(F.lit(0), F.size(s["v"]) - 1), lambda i: F.get(s["v"], i) >= s["t"]),
    )


def masked_top_k(values: Column, k: int) -> Column:
    """Values below the k-th largest become minus infinity."""
    kth = F.sort_array(values, asc=False)[F.least(F.lit(k), F.size(values)) - 1]
    return _bind(
        F.struct(values.alias("v"), kth.alias("t")),
        lambda s: F.transform(s["v"], lambda x: F.when(x < s["t"], F.lit(float("-inf"))).otherwise(x)),
    )


def cross_entropy(logits: Column, target: Column) -> Column:
    """Loss of one row; null where the target is -1, the ignored index."""
    logsum = _bind(
        logits,
        lambda v: F.log(total(F.transform(v, lambda x: F.exp(x - F.array_max(v))))) + F.array_max(v),
    )
    return F.when(target != -1, logsum - F.get(logits, target.cast("int")))


def gumbel_draw(probs: Column, uniforms: Column) -> Column:
    """One draw per row from its probabilities, given as many uniforms in (0, 1)."""
    return best(F.zip_with(probs, uniforms, lambda p, u: F.log(p) - F.log(-F.log(u))))


def max_delta(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def max_magnitude(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x)))


def tolerance(dtype: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in TOLERANCE.items() for x in kv])
    return F.coalesce(F.try_element_at(known, dtype), F.lit(DEFAULT_TOLERANCE))
