"""A keyed bijection on [0, n): block order without a stored shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Multipliers and round key step of the 32-bit mixer, network size,
# the bound on cycle walking and the seed step between epochs.
MULTIPLIERS = (0x7FEB352D, 0x846CA68B)
ROUND_STEP = 0x9E3779B9
ROUNDS = 4
MAX_WALK = 64
EPOCH_STEP = 7919
MASK32 = 0xFFFFFFFF


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body``."""
    return F.transform(F.array(value), body)[0]


def _times32(x: Column, k: int) -> Column:
    """Product modulo 2**32 in BIGINT, split so that it cannot overflow."""
    low = x.bitwiseAND(F.lit(0xFFFF)) * F.lit(k)
    high = (F.shiftright(x, 16) * F.lit(k)).bitwiseAND(F.lit(0xFFFF))
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(MASK32))


def mix(x: Column, key: Column) -> Column:
    """The 32-bit mixer as a column expression."""
    start = (x.cast("bigint") + key.cast("bigint")).bitwiseAND(F.lit(MASK32))
    a = _bind(start, lambda v: v.bitwiseXOR(F.shiftright(v, 16)))
    b = _bind(a, lambda v: _times32(v, MULTIPLIERS[0]))
    c = _bind(b, lambda v: v.bitwiseXOR(F.shiftright(v, 15)))
    d = _bind(c, lambda v: _times32(v, MULTIPLIERS[1]))
    return _bind(d, lambda v: v.bitwiseXOR(F.shiftright(v, 16)))


def _mix_batch(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    mask = np.uint64(MASK32)
    h = (x + key) & mask
    for shift, factor in zip((16, 15), MULTIPLIERS):
        h = ((h ^ (h >> np.uint64(shift))) * np.uint64(factor)) & mask
    return h ^ (h >> np.uint64(16))


def permute_batch(index: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Images of a batch of indices; all three arrays are BIGINT of one length."""
    size = n.astype(np.uint64)
    bits = np.frexp((n - 1).astype(np.float64))[1]
    half = ((np.maximum(bits, 1) + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    keys = [((seed.astype(np.int64) + r * ROUND_STEP) & MASK32).astype(np.uint64) for r in range(ROUNDS)]
    place = index.astype(np.uint64)
    todo = np.flatnonzero(n > 1)
    place[n <= 1] = 0
    for _ in range(MAX_WALK):
        if todo.size == 0:
            break
        h, m = half[todo], low[todo]
        left, right = (place[todo] >> h) & m, place[todo] & m
        for key in keys:
            left, right = right, left ^ (_mix_batch(right, key[todo]) & m)
        place[todo] = (left << h) | right
        todo = todo[place[todo] >= size[todo]]
    place[todo] %= size[todo]
    return place.astype(np.int64)


@F.pandas_udf(T.LongType())
def permuted(index: pd.Series, n: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series(permute_batch(index.to_numpy(), n.to_numpy(), seed.to_numpy()))
