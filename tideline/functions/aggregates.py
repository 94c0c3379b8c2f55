"""Collectors: what ends a pipeline with a value.  Each is ``flow >> collector`` and gives a one-row DataFrame.

``of`` is an expression over the element.  Sums of doubles are compensated: Kahan's and
Neumaier's fold runs in Arrow batches in each task, and the tasks' (sum, correction)
pairs are merged by the same step, so that no task sees all rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..flow import Flow, number_rows, stepwise

Collector = Callable[[Flow], DataFrame]


class EmptySequence(LookupError):
    """The first or last element of nothing."""


@stepwise
def total(of: Column, name: str = "sum", initial: Column | None = None) -> Collector:
    """The sum, zero for no elements, added to ``initial``."""

    def run(f: Flow) -> DataFrame:
        s = F.sum(of)
        return f.df.agg((F.coalesce(s, F.lit(0)) + (initial if initial is not None else F.lit(0))).alias(name))

    return run


@stepwise
def product(of: Column, initial: float = 1.0, name: str = "product") -> Collector:
    return lambda f: f.df.agg((F.lit(float(initial)) * F.coalesce(F.product(of), F.lit(1.0))).alias(name))


@stepwise
def count(name: str = "count", initial: int = 0) -> Collector:
    return lambda f: f.df.agg((F.count("*") + F.lit(initial)).alias(name))


#: rows of a block that a fold takes together
BLOCK = 8192


@stepwise
def fold(initial: Column, step: Callable[[Column, Column], Column], of: Column, name: str = "value", merge: Callable[[Column, Column], Column] | None = None) -> Collector:
    """A left fold in encounter order.

    With ``merge``, which joins the values of neighbouring stretches that were each folded
    from ``initial``, the stretches are folded where they are and their values merged, a
    block at a time.  Without it every step needs the one before, and the elements come
    together in one array: for short sequences.
    """

    def run(f: Flow) -> DataFrame:
        if merge is None:
            rows = F.array_sort(F.collect_list(F.struct(*f.pos, of.alias("_of"))))
            return f.df.agg(F.aggregate(F.transform(rows, lambda r: r["_of"]), initial, step).alias(name))
        rows = number_rows(f.df.select(*f.pos, of.alias("_of")), f.pos, "_n").select("_n", "_of")
        n, how, start = rows.count(), step, initial
        while True:
            block = F.array_sort(F.collect_list(F.struct("_n", "_of")))
            folded = F.aggregate(F.transform(block, lambda r: r["_of"]), start, how)
            if n <= BLOCK:
                return rows.agg(folded.alias(name))
            rows = rows.groupBy((F.col("_n") / BLOCK).cast("long").alias("_n")).agg(folded.alias("_of"))
            n, how = -(-n // BLOCK), merge

    return run


@stepwise
def collected(start: Callable[[], Any], consume: Callable[[Any, pa.RecordBatch], Any], merge: Callable[[Any, Any], Any], complete: Callable[[Any], dict], schema: str, *of: Column, fan: int = 16) -> Collector:
    """A collector of the user's own.

    ``start()`` makes a state in each task, ``consume(state, batch)`` takes in an Arrow
    batch of the columns ``of``, ``merge`` joins two states, ``complete(state)`` gives the
    row.  States are pickled; ``fan`` tasks merge those of all tasks, and one merges theirs.
    The order of rows is not kept.
    """

    def run(f: Flow) -> DataFrame:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = start()
            for b in batches:
                state = consume(state, b)
            yield pa.RecordBatch.from_pydict({"state": [pickle.dumps(state)]}, schema=pa.schema([("state", pa.binary())]))

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[Any]:
            state, some = start(), False
            for b in batches:
                for x in b.column(0):
                    state, some = merge(state, pickle.loads(x.as_py())) if some else pickle.loads(x.as_py()), True
            return state

        def fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_pydict({"state": [pickle.dumps(joined(batches))]}, schema=pa.schema([("state", pa.binary())]))

        def last_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_pylist([complete(joined(batches))], schema=kind)

        kind = to_arrow_schema(f.df.sparkSession.createDataFrame([], schema).schema)
        columns = [F.col(c) for c in f.columns()] if not of else list(of)
        states = f.df.select(*columns).mapInArrow(part, "state binary")
        return states.repartition(fan).mapInArrow(fewer, "state binary").repartition(1).mapInArrow(last_, schema)

    return run


@stepwise
def first(name: str = "first", of: Column | None = None) -> Collector:
    return lambda f: _end(f, F.min_by, of, name)


@stepwise
def last(name: str = "last", of: Column | None = None) -> Collector:
    return lambda f: _end(f, F.max_by, of, name)


def _end(f: Flow, pick, of: Column | None, name: str) -> DataFrame:
    value = of if of is not None else F.struct(*f.columns())
    found = f.df.agg(pick(value, F.struct(*f.pos)).alias(name), F.count("*").alias("_n"))
    return found.select(F.when(F.col("_n") > 0, F.col(name)).otherwise(F.raise_error(F.lit("the sequence is empty"))).alias(name))


def require_first(f: Flow) -> dict:
    """The first element as a dictionary; an exception if there is none."""
    rows = f.df.orderBy(*f.pos).select(*f.columns()).head(1)
    if not rows:
        raise EmptySequence("the sequence is empty")
    return rows[0].asDict()


def is_empty(f: Flow) -> bool:
    return f.df.isEmpty()


@stepwise
def for_each(act: Callable) -> Callable[[Flow], None]:
    return lambda f: f.element().foreach(act)


@stepwise
def drain(path: str, mode: str = "append") -> Callable[[Flow], None]:
    """All elements to a Parquet folder."""
    return lambda f: f.element().write.mode(mode).parquet(path)


# ---- compensated sums


def kahan_step(s: float, c: float, x: float) -> tuple[float, float]:
    y = x - c
    t = s + y
    return t, (t - s) - y


def neumaier_step(s: float, c: float, x: float) -> tuple[float, float]:
    t = s + x
    return t, c + ((s - t) + x if abs(s) >= abs(x) else (x - t) + s)


def _lanes(values: np.ndarray, kind: str, lanes: int = 256) -> tuple[float, float]:
    """Compensated sum of an array in ``lanes`` strands at once, merged at the end."""
    n = -(-len(values) // lanes) if len(values) else 0
    grid = np.zeros(n * lanes)
    grid[: len(values)] = values
    s, c = np.zeros(lanes), np.zeros(lanes)
    for row in grid.reshape(n, lanes):
        if kind == "kahan":
            y = row - c
            t = s + y
            c = (t - s) - y
        else:
            t = s + row
            c = c + np.where(np.abs(s) >= np.abs(row), (s - t) + row, (row - t) + s)
        s = t
    return merge_sums(zip(s.tolist(), c.tolist(), strict=True), kind)


def merge_sums(parts, kind: str) -> tuple[float, float]:
    """One (sum, correction) of many: Kahan's correction is what to take off, Neumaier's what to add."""
    s = c = 0.0
    for a, b in parts:
        if kind == "kahan":
            for x in (a, -b):
                s, c = kahan_step(s, c, x)
        else:
            for x in (a, b):
                s, c = neumaier_step(s, c, x)
    return s, c


@stepwise
def compensated(of: Column, kind: str, name: str = "sum") -> Collector:
    """``kind`` is kahan or neumaier; nulls are left out, nothing sums to 0."""

    def run(f: Flow) -> DataFrame:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [_lanes(b.column(0).drop_null().to_numpy(), kind) for b in batches]
            s, c = merge_sums(sums, kind)
            yield pa.RecordBatch.from_pydict({"s": [s], "c": [c]})

        parts = f.df.select(of.cast("double").alias("x")).mapInArrow(part, "s double, c double")
        # a row per task; merged in the order of size, so that the result does not depend on the tasks' order
        rows = F.array_sort(F.collect_list(F.struct("s", "c")))
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

        def kahan(a: Column, x: Column) -> Column:
            y = x - a["c"]
            t = a["s"] + y
            return F.struct(t.alias("s"), ((t - a["s"]) - y).alias("c"))

        def neumaier(a: Column, x: Column) -> Column:
            t = a["s"] + x
            return F.struct(t.alias("s"), (a["c"] + F.when(F.abs(a["s"]) >= F.abs(x), (a["s"] - t) + x).otherwise((x - t) + a["s"])).alias("c"))

        step, sign = (kahan, -1.0) if kind == "kahan" else (neumaier, 1.0)
        flat = F.flatten(F.transform(rows, lambda r: F.array(r["s"], F.lit(sign) * r["c"])))
        merged = F.aggregate(flat, zero, step, (lambda a: a["s"]) if kind == "kahan" else (lambda a: a["s"] + a["c"]))
        return parts.agg(merged.alias(name))

    return run


@stepwise
def pairwise(of: Column, name: str = "sum") -> Collector:
    """Neighbours in encounter order are added in pairs; pairs go to two strands in turn, which are added at the end.

    Nulls are left out; nothing sums to 0.
    """

    def run(f: Flow) -> DataFrame:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sums of whole pairs by strand; what stands alone at a batch's ends keeps its pair's number."""
            for batch in batches:
                n, x = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                order = np.argsort(n, kind="stable")
                n, x = n[order], x[order]
                first = np.flatnonzero((n[:-1] % 2 == 0) & (n[1:] == n[:-1] + 1)) if len(n) else np.zeros(0, np.int64)
                alone = np.ones(len(n), bool)
                alone[first] = alone[first + 1] = False
                sums, strand = x[first] + x[first + 1], n[first] // 2 % 2
                pairs = [-1, -2, *(n[alone] // 2).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array([sums[strand == 0].sum(), sums[strand == 1].sum(), *x[alone].tolist()], pa.float64())], ["pair", "s"])

        rows = f.df.select(*f.pos, of.cast("double").alias("_x")).where("_x is not null")
        numbered = number_rows(rows, f.pos, "_n") if f.pos else rows.withColumn("_n", F.monotonically_increasing_id())
        sums = numbered.select("_n", "_x").mapInArrow(part, "pair long, s double")
        strands = sums.groupBy("pair").agg(F.sum("s").alias("s")).groupBy(F.when(F.col("pair") < 0, -1 - F.col("pair")).otherwise(F.pmod("pair", F.lit(2))).alias("strand")).agg(F.sum("s").alias("s"))
        return strands.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias(name))

    return run
