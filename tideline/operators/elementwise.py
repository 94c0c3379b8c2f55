"""Operators on one sequence: projection, filter, flattening, defaults, errors, replay."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..flow import Flow, Step, UnorderedInput, stepwise
from ..shared import written


@stepwise
def mapping(*columns: Column, order: Sequence[str] | None = None, step: str | None = None) -> Step:
    """One element for each; ``order`` promises the result's order; ``step`` names a column with the position."""

    def run(f: Flow) -> Flow:
        df = f.ordinal(step) if step else f.df
        own = [c for c in f.pos if not c.startswith("_")]
        kept = [F.col(c) for c in df.columns if c.startswith("_")] + [F.col(c).alias(f"_{c}") for c in own]
        pos = tuple(c if c.startswith("_") else f"_{c}" for c in f.pos)
        return Flow(df.select(*kept, *columns), pos, None if order is None else tuple(order))

    return run


@stepwise
def where(condition: Column) -> Step:
    return lambda f: f.over(f.df.where(condition))


@stepwise
def where_stateful(keep: Callable[[dict, int], bool | None]) -> Step:
    """``keep(row, emitted)``: the step counts rows that were let through, None ends the sequence.

    Each decision needs the ones before: one ordered pass in one task.  What only counts is
    better said by ``where`` and ``take``, or by ordinals.
    """

    def run(f: Flow) -> Flow:
        def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            emitted, over = 0, False
            for frame in frames:
                mask = []
                for row in frame.to_dict("records"):
                    answer = False if over else keep(row, emitted)
                    over = over or answer is None
                    mask.append(bool(answer))
                    emitted += bool(answer)
                yield frame[pd.Series(mask, index=frame.index, dtype=bool)]

        df = f.df.repartition(1).sortWithinPartitions(*f.pos)
        return f.over(df.mapInPandas(fold, df.schema))

    return run


@stepwise
def take(n: int) -> Step:
    """The first n elements in encounter order: the n least of each task, then of all."""
    return lambda f: f.over(f.df.orderBy(*f.pos).limit(n))


@stepwise
def take_while(condition: Column) -> Step:
    """The elements before the first that fails: one aggregate, no window; the trait is dropped."""

    def run(f: Flow) -> Flow:
        place = F.struct(*f.pos)
        stop = f.df.where(~F.coalesce(condition, F.lit(False))).agg(F.min(place).alias("_stop"))  # one row
        df = f.df.crossJoin(F.broadcast(stop)).where(F.col("_stop").isNull() | (place < F.col("_stop"))).drop("_stop")
        return f.over(df, order=None)

    return run


@stepwise
def maf(condition: Column, *columns: Column, order: Sequence[str] | None = None) -> Step:
    """Map and filter in one: Catalyst fuses the two."""
    return lambda f: mapping(*columns, order=order)(where(condition)(f))


@stepwise
def flat_mapping(children: Column, name: str, order: Sequence[str] | None = None) -> Step:
    """Each element of the arrays ``children``; empty arrays give nothing."""

    def run(f: Flow) -> Flow:
        df = f.df.select("*", F.posexplode(children).alias("_child", name))
        return Flow(df, (*f.pos, "_child"), None if order is None else tuple(order))

    return run


@stepwise
def ordering_flat_mapping(children: Column, name: str, form: Callable[[Column], Column] | None = None) -> Step:
    """Flatten and merge: the result ascends by ``name``; arrays that do not ascend are an error.

    ``form`` gives a comparator as the normal form of a child that it compares.
    """

    def run(f: Flow) -> Flow:
        forms = children if form is None else F.transform(children, form)
        checked = F.when(F.array_sort(forms) == forms, children).otherwise(F.raise_error(F.lit("children must be ordered")))
        df = f.df.select("*", F.posexplode(checked).alias("_child", name))
        by = name
        if form is not None:
            by = "_form"
            df = df.withColumn(by, form(F.col(name)))
        return Flow(df, (by, *f.pos, "_child"), (by,))

    return run


@stepwise
def or_default(alternative: Flow) -> Step:
    """The alternative if the sequence is empty; decided in the plan by one row's existence."""

    def run(f: Flow) -> Flow:
        columns = f.columns()
        some = f.df.limit(1).agg((F.count("*") == 0).alias("_empty"))
        base = f.df.select(*[F.col(c) for c in columns], F.lit(0).alias("_src"))
        other = alternative.df.select(*columns, F.lit(1).alias("_src")).crossJoin(F.broadcast(some)).where("_empty").drop("_empty")
        both = f.ordered and alternative.ordered
        return Flow(base.unionByName(other), (), f.order if both else None)

    return run


@stepwise
def on_error(value: Column, name: str, alternative: DataFrame, default: Column | None = None, is_error: Column | None = None) -> Step:
    """``value`` for each element up to the first that fails, then the alternative's rows.

    ``value`` is null where it fails (``try_cast``, ``try_divide`` ...); ``is_error`` tells
    failures of the class that is caught; others raise.  The result has ``_src`` 0 and 1.
    """

    def run(f: Flow) -> Flow:
        place = F.struct(*f.pos)
        failed = is_error if is_error is not None else value.isNull()
        own = f.df.withColumn("_failed", failed)
        stop = own.where("_failed").agg(F.min(place).alias("_stop"))
        kept = own.crossJoin(F.broadcast(stop)).where(F.col("_stop").isNull() | (place < F.col("_stop")))
        checked = F.when(value.isNull(), F.raise_error(F.lit("an error of another class"))).otherwise(value) if is_error is not None else value
        head = kept.select(F.lit(0).alias("_src"), checked.alias(name))
        tail = alternative.select(F.lit(1).alias("_src"), F.col(name)).crossJoin(F.broadcast(stop)).where(F.col("_stop").isNotNull()).drop("_stop")
        return Flow(head.unionByName(tail))

    return run


@stepwise
def repeater() -> Step:
    """Materialise once and replay: written to the shared folder, so that no executor's memory holds it."""
    return lambda f: f.over(written(f.df, "replay"))


@stepwise
def sort(*by: str) -> Step:
    """Ordered by ``by``; nothing happens if the trait says so already."""

    def run(f: Flow) -> Flow:
        if f.order is not None and f.order[: len(by)] == by:
            return f
        return f.over(f.df.orderBy(*by), pos=(*by, *[p for p in f.pos if p not in by]), order=by)

    return run


@stepwise
def minibatch(rows: int) -> Step:
    """Prefetching has no meaning in a batch plan: content and order are the same."""
    if rows < 2:
        raise ValueError("a batch has two rows at least")
    return lambda f: f


def require_order(f: Flow) -> Flow:
    if not f.ordered:
        raise UnorderedInput("a sorted sequence is needed")
    return f
