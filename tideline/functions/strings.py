"""Byte-wise comparison, and strings of a bounded length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by unsigned bytes; null-safe, null first."""
    return F.when(a.eqNullSafe(b), F.lit(0)).when(a.isNull() | (a.cast("binary") < b.cast("binary")), F.lit(-1)).otherwise(F.lit(1))


def bounded(text: Column, capacity: int, strict: bool = True) -> Column:
    """A text of at most ``capacity`` bytes: a longer one raises, or is cut if not ``strict``."""
    fits = F.octet_length(text) <= capacity
    over = F.raise_error(F.lit(f"longer than {capacity} bytes")).cast("string") if strict else F.substring(text.cast("binary"), 1, capacity).cast("string")
    return F.when(text.isNull() | fits, text).otherwise(over)


def append(text: Column, more: Column, capacity: int, strict: bool = True) -> Column:
    return bounded(F.concat(text, more), capacity, strict)


def at(text: Column, place: Column) -> Column:
    """The character at a place from 0; out of range raises."""
    inside = (place >= 0) & (place < F.length(text))
    return F.when(inside, F.substr(text, place + 1, F.lit(1))).otherwise(F.raise_error(F.lit("out of range")).cast("string"))


def substr(text: Column, start: Column, count: Column) -> Column:
    return F.substr(text, start + 1, count)


def replace(text: Column, start: int, count: int, by: Column, capacity: int) -> Column:
    return bounded(F.overlay(text, by, start + 1, count), capacity)
