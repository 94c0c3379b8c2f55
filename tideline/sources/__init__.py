"""Sources: where sequences begin.  Each returns a ``Flow``."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..flow import Flow, flow

_SORTED = (set, frozenset)


def of_table(spark: SparkSession, path: str, pos: str | Sequence[str] = (), order: str | Sequence[str] | None = None) -> Flow:
    """A Parquet table; ``order`` promises that ``pos`` ascends by it."""
    return flow(spark.read.parquet(path), pos, order)


def of_container(spark: SparkSession, items: Iterable, schema: T.DataType | str, name: str = "value") -> Flow:
    """Python items in their order; sets and dictionaries come sorted and carry the trait."""
    is_sorted = isinstance(items, (*_SORTED, dict))
    if isinstance(items, dict):
        rows = [(i, k, v) for i, (k, v) in enumerate(sorted(items.items()))]
        key, value = schema.split(",") if isinstance(schema, str) else schema
        df = spark.createDataFrame(rows, f"_pos long, key {key}, value {value}")
        return flow(df, "_pos", "key")
    rows = [(i, x) for i, x in enumerate(sorted(items) if is_sorted else items)]
    is_sorted = is_sorted or len(rows) <= 1
    kind = schema if isinstance(schema, str) else schema.simpleString()
    return flow(spark.createDataFrame(rows, f"_pos long, {name} {kind}"), "_pos", name if is_sorted else None)


def of_iterators(source: Flow, begin: int, end: int) -> Flow:
    """The elements at positions begin to end - 1; the trait is dropped."""
    df = source.ordinal("_slice").where((F.col("_slice") >= begin) & (F.col("_slice") < end)).drop("_slice")
    return source.over(df, order=None)


def of_optional(spark: SparkSession, value: Any, schema: str, name: str = "value") -> Flow:
    """One element, or none for None."""
    return of_container(spark, [] if value is None else [value], schema, name)


def null(spark: SparkSession, schema: str) -> Flow:
    """Always empty; ordered by whatever it has."""
    df = spark.createDataFrame([], f"_pos long, {schema}")
    return flow(df, "_pos", [c for c in df.columns if c != "_pos"])


def of_value(spark: SparkSession, value: Any, limit: int = 1, name: str = "value") -> Flow:
    """A value, ``limit`` times."""
    return of_lazy_value(spark, F.lit(value), limit, name)


def of_lazy_value(spark: SparkSession, value: Column | Callable[[Column], Column], limit: int = 1, name: str = "value") -> Flow:
    """An expression, or a function of the step, for each of ``limit`` steps."""
    df = spark.range(limit).select(F.col("id").alias("_pos"), (value(F.col("id")) if callable(value) else value).alias(name))
    return flow(df, "_pos", name if not callable(value) or limit < 2 else None)


def of_iota(spark: SparkSession, begin: int, end: int, step: int = 1, name: str = "value") -> Flow:
    """begin, begin + step, ... as long as a *whole* step fits before ``end``: (0, 10, 3) is 0, 3, 6."""
    if step == 0 or (step == 1 and begin > end):
        raise ValueError("the sequence would not end")
    count = max(0, (end - begin) // step if step > 0 else (begin - end) // -step)
    df = spark.range(count).select(F.col("id").alias("_pos"), (F.lit(begin) + F.col("id") * step).cast("long").alias(name))
    return flow(df, "_pos", name if step > 0 else None)


def generator(spark: SparkSession, make: Callable[[int], Any], schema: str, name: str = "value", keep_order: bool = False) -> Flow:
    """``make(step)`` until it gives None.

    A closed form of the step belongs in ``of_lazy_value``; this runs where each element
    needs the one before, as one table function on one executor.
    """

    class Pull:
        def eval(self):
            step = 0
            while (x := make(step)) is not None:
                yield step, x
                step += 1

    made = F.udtf(Pull, returnType=f"_pos long, {name} {schema}")
    return flow(made(), "_pos", name if keep_order else None)


def split_column(text: Column, seps: str = " ") -> Column:
    """Tokens between any of the characters ``seps``; empty tokens drop; without separators the whole text."""
    if not seps:
        return F.filter(F.array(text), lambda x: x != "")
    return F.filter(F.split(text, "[" + re.sub(r"([\\\]\[^&-])", r"\\\1", seps) + "]"), lambda x: x != "")


def of_string_split(spark: SparkSession, text: str, seps: str = " ", name: str = "value") -> Flow:
    df = spark.range(1).select(F.posexplode(split_column(F.lit(text), seps)).alias("_pos", name))
    return flow(df, "_pos")


def conditional(condition: bool | Callable[[], bool], yes: Flow | Callable[[], Flow], no: Flow | Callable[[], Flow]) -> Flow:
    """One of two pipelines, chosen when the plan is built; the other is not looked at."""
    chosen = yes if (condition() if callable(condition) else condition) else no
    return chosen() if callable(chosen) else chosen


def outer(df: DataFrame, pos: str | Sequence[str] = (), order: str | Sequence[str] | None = None) -> Flow:
    """A DataFrame of the user's own."""
    return flow(df, pos, order)


def iterate(source: Flow) -> Iterable:
    """Rows of the element in encounter order, pulled partition by partition."""
    df = source.df.orderBy(*source.pos) if source.pos else source.df
    return df.select(*source.columns()).toLocalIterator()


def of_source(spark: SparkSession, parts: Sequence[Any], read: Callable[[Any], Iterable[tuple]], schema: str, pos: str | Sequence[str] = (), order: str | Sequence[str] | None = None) -> Flow:
    """A source of the user's own: ``read(part)`` gives the rows of a part, one task for each."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(p) for p in parts]

        def read(self, partition):
            yield from read(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return f"tideline_{key}"

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    key = uuid.uuid4().hex
    spark.dataSource.register(Source)
    return flow(spark.read.format(f"tideline_{key}").load(), pos, order)


def chosen_late(condition: DataFrame, yes: Flow, no: Flow) -> Flow:
    """One of two pipelines with the same columns by a one-row DataFrame of a boolean, each time the plan runs."""
    flag = F.broadcast(condition.toDF("_flag"))
    taken = lambda f, c: f.df.crossJoin(flag).where(c).drop("_flag")
    both = yes.ordered and yes.order == no.order
    return Flow(taken(yes, F.col("_flag")).unionByName(taken(no, ~F.coalesce("_flag", F.lit(False)))), yes.pos if yes.pos == no.pos else (), yes.order if both else None)
