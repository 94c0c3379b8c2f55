"""Half-open intervals [pos, pos + count) as column expressions; an interval is a struct (pos, count)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval(pos: Column, count: Column) -> Column:
    return F.struct(pos.alias("pos"), count.alias("count"))


def end(a: Column) -> Column:
    return a["pos"] + a["count"]


def is_empty(a: Column) -> Column:
    return a["count"] == 0


def contains(a: Column, point: Column) -> Column:
    return (point >= a["pos"]) & (point < end(a))


def overlaps(a: Column, b: Column) -> Column:
    return ~is_empty(a) & ~is_empty(b) & (a["pos"] < end(b)) & (b["pos"] < end(a))


def is_included(outer: Column, inner: Column) -> Column:
    return (inner["pos"] >= outer["pos"]) & (end(inner) <= end(outer))


def left_adjacent(a: Column, b: Column) -> Column:
    """b ends where a begins."""
    return a["pos"] == end(b)


def right_adjacent(a: Column, b: Column) -> Column:
    """b begins where a ends."""
    return end(a) == b["pos"]


def adjacent(a: Column, b: Column) -> Column:
    return left_adjacent(a, b) | right_adjacent(a, b)


def less(a: Column, b: Column) -> Column:
    """a lies wholly before b."""
    return end(a) <= b["pos"]


def equal(a: Column, b: Column) -> Column:
    return (a["pos"] == b["pos"]) & (a["count"] == b["count"])


def hull(a: Column, b: Column) -> Column:
    """The least interval over both; an empty one adds nothing."""
    low = F.least(a["pos"], b["pos"])
    return F.when(is_empty(a), b).when(is_empty(b), a).otherwise(interval(low, F.greatest(end(a), end(b)) - low))


def intersection(a: Column, b: Column) -> Column:
    """What both have; of disjoint ones an empty interval at the greater position."""
    high = F.greatest(a["pos"], b["pos"])
    return interval(high, F.greatest(F.lit(0), F.least(end(a), end(b)) - high))


def offset(a: Column, by: Column) -> Column:
    return interval(a["pos"] + by, a["count"])
