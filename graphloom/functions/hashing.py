"""32-bit hashes and seeded numbers as columns, with wrapping products.

Defined results: null gives null; the empty text has the hash's first value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a's first value and prime, and mulberry32's step.
FNV_FIRST, FNV_PRIME, STEP = 2166136261, 16777619, 0x6D2B79F5
LOW = 0xFFFFFFFF


def units(text: Column) -> Column:
    """A text's UTF-16 code units."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    pair = lambda c: F.array((F.lit(0xD800) + F.call_function("shiftright", c - 0x10000, F.lit(10))).cast("int"), (F.lit(0xDC00) + (c - 0x10000).bitwiseAND(F.lit(0x3FF))).cast("int"))
    return F.flatten(F.transform(codes, lambda c: F.when(c > 0xFFFF, pair(c)).otherwise(F.array(c))))


def fnv1a(text: Column) -> Column:
    """FNV-1a of a text's code units, as a long from 0 to 2 ** 32 - 1; a product has at most 57 bits."""
    step = lambda h, c: (h.bitwiseXOR(c.cast("long")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(LOW))
    return F.aggregate(units(text), F.lit(FNV_FIRST).cast("long"), step)


def product(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two longs below 2 ** 32, by halves of one of them."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)) * b, F.call_function("shiftright", a, F.lit(16)) * b
    return (low + high.bitwiseAND(F.lit(0xFFFF)) * F.lit(1 << 16)).bitwiseAND(F.lit(LOW))


def seeded(seed: Column, n: Column) -> Column:
    """The nth number (from 1) of mulberry32 from a seed, from 0 up to 1; each is computed by itself, as the state after n steps is
    the seed and n times the step."""
    shift = lambda x, k: F.call_function("shiftright", x, F.lit(k))
    state = (seed + product(n.cast("long"), F.lit(STEP).cast("long"))).bitwiseAND(F.lit(LOW))
    mixed = product(state.bitwiseXOR(shift(state, 15)), state.bitwiseOR(F.lit(1)))
    again = (mixed + product(mixed.bitwiseXOR(shift(mixed, 7)), mixed.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(LOW)).bitwiseXOR(mixed)
    return again.bitwiseXOR(shift(again, 14)) / F.lit(4294967296.0)
