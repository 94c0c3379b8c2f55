"""Set algebra with multiset semantics."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..flow import Flow, Step, in_ranges, stepwise
from .elementwise import require_order


@stepwise
def union_all(*others: Flow) -> Step:
    """One sequence after the other, duplicates kept; the trait is dropped."""

    def run(f: Flow) -> Flow:
        columns = f.columns()
        out = None
        for k, x in enumerate((f, *others)):
            order = [F.col(p).alias(f"_at{i}") for i, p in enumerate(x.pos)]
            part = x.df.select(*[F.col(a).alias(b) for a, b in zip(x.columns(), columns, strict=True)], F.lit(k).alias("_src"), *order)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return Flow(out, ("_src", *sorted(c for c in out.columns if c.startswith("_at"))))

    return run


@stepwise
def union_merge(other: Flow, by: Sequence[str | Column] | None = None) -> Step:
    """Two sorted sequences as one, duplicates kept: a union and a sort, which Catalyst plans by ranges.

    ``by`` may hold expressions: the normal forms that a comparator compares.
    """

    def run(f: Flow) -> Flow:
        if by is None:
            require_order(f)
            require_order(other)
        key = tuple(by) if by is not None else f.order
        df = f.element().withColumn("_src", F.lit(0)).unionByName(other.element().withColumn("_src", F.lit(1)))
        names = []
        for i, k in enumerate(key):  # normal forms become columns of the engine's own
            names.append(k if isinstance(k, str) else f"_by{i}")
            if not isinstance(k, str):
                df = df.withColumn(names[-1], k)
        return Flow(df.orderBy(*names, "_src"), (*names, "_src"), tuple(names))

    return run


def _element_key(f: Flow, key: Sequence[Column] | None) -> list[Column]:
    return list(key) if key is not None else [F.col(c) for c in f.columns()]


@stepwise
def diff(other: Flow, key: Sequence[Column] | None = None) -> Step:
    """Multiset difference: of m equal elements here and n there, the last m - n in encounter order stay.

    ``key`` gives a comparator as the normal form of an element (``lower(k)``); without
    it and without positions ``exceptAll`` does the same.
    """

    def run(f: Flow) -> Flow:
        if key is None and not f.pos:
            return Flow(f.element().exceptAll(other.element()), (), f.order)
        keys = _element_key(f, key)
        names = [f"_k{i}" for i in range(len(keys))]
        counts = other.df.select(*[k.alias(n) for k, n in zip(_element_key(other, key), names, strict=True)]).groupBy(*names).agg(F.count("*").alias("_n"))
        left = f.df.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
        counts = counts.select(*[F.col(n).alias(f"_o{n}") for n in names], "_n")

        def same(suffix: str) -> Column:
            return reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_{suffix}{n}")) for n in names])

        # rows in ranges of the encounter order: a frequent element is numbered in many tasks, from the numbers before on
        ranged, place = in_ranges(left.join(counts, same("o"), "left"), f.pos)
        ranged = ranged.withColumn("_task", F.shiftright(place, 33).cast("int"))
        others = ranged.where("_n is null")
        some = ranged.where("_n is not null")
        parts = some.groupBy("_task", *names).agg(F.count("*").alias("_m"))
        before = parts.select(F.col("_task").alias("_btask"), *[F.col(n).alias(f"_b{n}") for n in names], (F.sum("_m").over(Window.partitionBy(*names).orderBy("_task")) - F.col("_m")).alias("_before"))
        number = F.row_number().over(Window.partitionBy("_task", *names).orderBy(place))
        kept = some.withColumn("_r", number).join(before, (F.col("_task") == F.col("_btask")) & same("b")).where(F.col("_r") + F.col("_before") > F.col("_n"))
        columns = f.df.columns
        return f.over(others.select(*columns).unionByName(kept.select(*columns)))

    return run


@stepwise
def ordered_diff(other: Flow, key: Sequence[Column] | None = None) -> Step:
    """The difference of two sorted sequences; the result is sorted."""
    return lambda f: diff(require_order(other), key)(require_order(f))


@stepwise
def auto_diff(other: Flow, key: Sequence[Column] | None = None) -> Step:
    """By the traits: the form for sorted sequences if both are, else the one for any."""
    return lambda f: (ordered_diff if f.ordered and other.ordered else diff)(other, key)(f)


@stepwise
def distinct_first(key: Sequence[Column] | None = None) -> Step:
    """The first of equal elements in encounter order; partial aggregation before the shuffle."""

    def run(f: Flow) -> Flow:
        keys = [k.alias(f"_k{i}") for i, k in enumerate(_element_key(f, key))]
        place = F.struct(*[F.col(p).alias(f"p{i}") for i, p in enumerate(f.pos)])
        whole = F.struct(*[F.col(c) for c in f.df.columns])
        df = f.df.groupBy(*keys).agg(F.min_by(whole, place).alias("_row")).select("_row.*")
        return f.over(df)

    return run


@stepwise
def distinct_sorted() -> Step:
    """Equal neighbours drop; the sequence must be sorted."""

    def run(f: Flow) -> Flow:
        return distinct_first()(require_order(f))

    return run


@stepwise
def distinct_adjacent(form: Column) -> Step:
    """Neighbours with equal normal forms drop: an element stays if its form differs from the one before."""

    def run(f: Flow) -> Flow:
        numbered = require_order(f).ordinal("_n").withColumn("_form", form)
        before = numbered.select((F.col("_n") + 1).alias("_n"), F.struct("_form").alias("_last"))
        df = numbered.join(before, "_n", "left").where(F.col("_last").isNull() | ~F.col("_last._form").eqNullSafe(F.col("_form")))
        return f.over(df.drop("_n", "_form", "_last"))

    return run


@stepwise
def distinct_last_kept(equal: Callable[[dict, dict], bool]) -> Step:
    """Each element is compared with the last one *kept*; for relations that are not transitive.

    The ranges of the encounter order are walked side by side, at first as if nothing had
    been kept before; then again from what the range before has kept last, until that is
    the same as in the walk before.  Most relations fall into step within a range, and
    need two walks; at worst there are as many as ranges.
    """

    def run(f: Flow) -> Flow:
        columns = f.df.columns
        ranged, place = in_ranges(require_order(f).df, f.pos)
        dealt = ranged.withColumn("_task", F.shiftright(place, 33).cast("int")).repartition("_task").sortWithinPartitions("_task", place)

        def walk(frames: Iterator[pd.DataFrame], carry: dict[int, dict]) -> Iterator[tuple[int, pd.DataFrame, list[bool], dict | None]]:
            """(task, rows of it, which stay, the last kept so far) of each stretch."""
            task, last = None, None
            for frame in frames:
                for number, part in frame.groupby("_task", sort=True):
                    if number != task:
                        task, last = number, carry.get(number)
                    part, mask = part[columns], []
                    for row in part.to_dict("records"):
                        keep = last is None or not equal(last, row)
                        if keep:
                            last = row
                        mask.append(keep)
                    yield int(task), part, mask, last

        def ends(carry: dict[int, dict]) -> dict[int, bytes]:
            def last_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                found = {task: last for task, _, _, last in walk(frames, carry)}
                yield pd.DataFrame({"task": list(found), "last": [pickle.dumps(v) for v in found.values()]})

            return {r.task: r.last for r in dealt.mapInPandas(last_of, "task int, last binary").collect()}  # a row per task

        carry, before = {}, None
        while True:
            found = ends(carry)
            if found == before:
                break
            before, tasks = found, sorted(found)
            carry = {t: pickle.loads(found[u]) for u, t in pairwise(tasks)}

        def kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for _, part, mask, _ in walk(frames, carry):
                yield part[pd.Series(mask, index=part.index, dtype=bool)]

        return f.over(dealt.mapInPandas(kept, f.df.schema))

    return run


@stepwise
def distinct_auto() -> Step:
    return lambda f: (distinct_sorted() if f.ordered else distinct_first())(f)
