"""Bits of 64-bit numbers; place 0 is the lowest, and -1 stands for none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_bits(x: Column) -> Column:
    return F.bit_count(x)


def get(x: Column, place: Column) -> Column:
    return F.shiftrightunsigned(x, 0).bitwiseAND(_one(place)) != 0


def _one(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def _from(place: Column) -> Column:
    """All places from this one on."""
    return F.call_function("shiftleft", F.lit(-1).cast("long"), place.cast("int"))


def put(x: Column, place: Column) -> Column:
    return x.bitwiseOR(_one(place))


def clear(x: Column, place: Column) -> Column:
    return x.bitwiseAND(F.bitwise_not(_one(place)))


def toggle(x: Column, place: Column) -> Column:
    return x.bitwiseXOR(_one(place))


def invert(x: Column) -> Column:
    return F.bitwise_not(x)


def first_set(x: Column) -> Column:
    """The lowest bit's place: of x and -x only it stays, and one less has as many ones as its place."""
    return F.when(x == 0, F.lit(-1)).when(x == F.lit(-(2**63)), F.lit(63)).otherwise(F.bit_count(x.bitwiseAND(F.bitwise_not(x) + 1) - 1))


def last_set(x: Column) -> Column:
    return F.when(x == 0, F.lit(-1)).when(x < 0, F.lit(63)).otherwise(F.length(F.bin(x)) - 1)


def next_set(x: Column, place: Column) -> Column:
    """The lowest place above ``place`` that is set."""
    above = F.when(place >= 63, F.lit(0).cast("long")).otherwise(x.bitwiseAND(_from(place + 1)))
    return first_set(above)


def previous_set(x: Column, place: Column) -> Column:
    """The highest place below ``place`` that is set."""
    return last_set(x.bitwiseAND(F.bitwise_not(_from(place))))


def log2(x: Column) -> Column:
    """The whole part for positive numbers."""
    return last_set(x)


def ceil_power(x: Column) -> Column:
    """The least power of two that is x or more."""
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(_one(last_set(x - 1) + 1))


def unsigned_difference(a: Column, b: Column) -> Column:
    """a - b of unsigned values, signed; one that does not fit in 64 bits raises, as casts do under ANSI rules."""
    wide = lambda x: F.when(x < 0, x.cast("decimal(21,0)") + F.lit(str(2**64)).cast("decimal(21,0)")).otherwise(x.cast("decimal(21,0)"))
    return (wide(a) - wide(b)).cast("long")
