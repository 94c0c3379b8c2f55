"""A sequence of rows: a DataFrame, its order trait, and what defines encounter order.

Spark rows have no order.  A ``Flow`` therefore carries two facts beside the DataFrame:

* ``order``: columns the sequence is *sorted* by, or None.  It is a promise, not a sort:
  operators choose their form by it (as ``auto_join`` does), and ``sort`` is elided by it.
* ``pos``: columns that define encounter order, unique in the sequence.  Only operators
  that need positions (zip, first-kept distinct, take_while ...) look at it.

A pipeline is composed with ``>>``: ``flow >> step``, ``step >> step``, a tuple of steps in
turn.  Nothing runs before an action, but that numbering rows writes them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import wraps
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


class UnorderedInput(RuntimeError):
    """An operator that needs a sorted input got one without the trait."""


class Step:
    """What turns a flow into another, or into a value; ``step >> step`` is a step too, without a source."""

    def __init__(self, run: Callable[[Flow], Any]):
        self.run = run

    def __call__(self, f: Flow) -> Any:
        return self.run(f)

    def __rshift__(self, other: Callable[[Flow], Any] | tuple) -> Step:
        return Step(lambda f: f >> self >> other)

    def __rrshift__(self, before: tuple) -> Step:
        return Step(lambda f: f >> before >> self)


def stepwise(make: Callable[..., Callable[[Flow], Any]]) -> Callable[..., Step]:
    """The steps that ``make`` gives can be composed."""

    @wraps(make)
    def made(*args, **options) -> Step:
        return Step(make(*args, **options))

    return made


@dataclass(frozen=True)
class Flow:
    df: DataFrame
    pos: tuple[str, ...] = ()
    order: tuple[str, ...] | None = None

    def __rshift__(self, step: Callable[[Flow], Any] | tuple) -> Any:
        if isinstance(step, tuple):
            out = self
            for s in step:
                out = out >> s
            return out
        return step(self)

    @property
    def ordered(self) -> bool:
        return self.order is not None

    def over(self, df: DataFrame, **changes) -> Flow:
        return replace(self, df=df, **changes)

    def columns(self) -> list[str]:
        """The element: all columns that are not positions of the engine's own."""
        return [c for c in self.df.columns if not c.startswith("_")]

    def element(self) -> DataFrame:
        return self.df.select(*self.columns())

    def ordinal(self, name: str = "pos") -> DataFrame:
        """The rows numbered from 0 in encounter order."""
        if not self.pos:
            raise UnorderedInput("encounter order is not defined for this flow")
        return number_rows(self.df, self.pos, name)


def flow(df: DataFrame, pos: str | Sequence[str] = (), order: str | Sequence[str] | None = None) -> Flow:
    listed = lambda c: (c,) if isinstance(c, str) else tuple(c)
    return Flow(df, listed(pos), None if order is None else listed(order))


def number_rows(df: DataFrame, by: Sequence[str], name: str = "pos") -> DataFrame:
    """``row_number() - 1`` over the order ``by``, without a global window.

    The rows are dealt to ranges of all columns of the order, sorted within, and written:
    a row's number is its place in its task's range and the sizes of the ranges before.
    """
    ranged, place = in_ranges(df, by)
    task = F.shiftright(place, 33).cast("int")
    sizes = ranged.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))  # a row per task
    before = sizes.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_before"))
    within = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(before), task == F.col("_task")).withColumn(name, F.col("_before") + within).drop(place, "_task", "_before")


def in_ranges(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, str]:
    """The rows, written in ranges of the order, and the column with the task and the place in its range (33 bits)."""
    order = [F.col(c).asc_nulls_first() for c in by]
    place = new_name(df, "_place")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.withColumn(place, F.monotonically_increasing_id()), "numbered"), place


def new_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
