"""Run-time filters: rows that can't have a partner go before their wide columns move.

The hashes of some keys are bits of one array of fixed size, whatever the number of
keys. With many more keys than bits a filter keeps most values; it never loses one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 22  # of a filter that is a subquery: half a MB
INLINE_BITS = 1 << 20  # of one that is a constant of the plan: 1 MB


def _words(keys: DataFrame, bits: int) -> DataFrame:
    """One row: the bits as an array of long words, set by a distributed aggregation."""
    place = F.pmod(F.xxhash64(*keys.columns), F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("id")).agg(F.bit_or(bit).alias("w"))
    every = keys.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("w", F.lit(0).cast("bigint")).alias("w"))
    return every.agg(F.sort_array(F.collect_list(F.struct("id", "w")))["w"].alias("w"))


def might_hold(keys: DataFrame, bits: int = BITS) -> Callable[..., Column]:
    """A test of whether some values may be a row of ``keys``; false only for values that are none.

    The array is a scalar subquery of the plan that uses the test, which is a filter
    of the scan, below any exchange. Not for use inside higher-order functions. A
    NULL hashes like any value; values must have the types of the keys.
    """
    table = _words(keys, bits).scalar()

    def test(*values: Column) -> Column:
        at = F.pmod(F.xxhash64(*values), F.lit(bits))
        return F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1

    return test


def might_hold_inline(keys: DataFrame, bits: int = INLINE_BITS) -> Callable[..., Column]:
    """The same test with the array read now and made a constant, for use inside higher-order functions."""
    words = np.array(_words(keys, bits).first()["w"], np.int64)
    table = F.lit(np.unpackbits(words.view(np.uint8), bitorder="little").tobytes())
    one = F.lit(b"\x01")
    return lambda *values: F.substring(table, F.pmod(F.xxhash64(*values), F.lit(bits)).cast("int") + 1, F.lit(1)) == one
