"""Joins: membership, cartesian, by prefix, by overlap of intervals, by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..flow import Flow, Step, stepwise
from .elementwise import require_order

#: pairs of keys, here and there: names, or expressions as the normal forms under which elements are equal
On = Sequence[tuple[str | Column, str | Column]]


def _key(k: str | Column) -> Column:
    return F.col(k) if isinstance(k, str) else k


def _members(df: DataFrame, other: DataFrame, on: On) -> DataFrame:
    """Rows of ``df`` with a partner: the other side is cut to its key before the shuffle.

    Sizes choose the form: AQE broadcasts a side that is small, and splits keys that are hot.
    """
    keys = other.select(*[_key(b).alias(f"_m{i}") for i, (_, b) in enumerate(on)])
    same = None
    for i, (a, _) in enumerate(on):
        equal = _key(a) == F.col(f"_m{i}")
        same = equal if same is None else same & equal
    return df.join(keys, same, "left_semi")


@stepwise
def ordered_join(other: Flow, on: On) -> Step:
    """Elements here that have an equal there, as often as they are here; both are sorted, and so is the result.

    The order is a trait of the result, not a form of the join.
    """

    def run(f: Flow) -> Flow:
        return f.over(_members(require_order(f).df, require_order(other).df, on))

    return run


@stepwise
def unordered_join(other: Flow, on: On) -> Step:
    """The same of sequences in any order."""
    return lambda f: f.over(_members(f.df, other.df, on))


@stepwise
def auto_join(other: Flow, on: On) -> Step:
    """By the traits: an unordered sequence against a sorted one gives the *sorted* side's elements."""

    def run(f: Flow) -> Flow:
        if f.ordered and other.ordered:
            return ordered_join(other, on)(f)
        if not f.ordered and other.ordered:
            return unordered_join(f, [(b, a) for a, b in on])(other)
        return unordered_join(other, on)(f)

    return run


@stepwise
def cartesian(*others: Flow) -> Step:
    """All combinations; the leftmost varies fastest, so that positions count from the right."""

    def run(f: Flow) -> Flow:
        df, pos = f.df.select(*f.columns(), *[F.col(p).alias(f"_p0_{i}") for i, p in enumerate(f.pos)]), [f"_p0_{i}" for i in range(len(f.pos))]
        for k, x in enumerate(others, 1):
            own = [f"_p{k}_{i}" for i in range(len(x.pos))]
            df = df.crossJoin(x.df.select(*x.columns(), *[F.col(p).alias(n) for p, n in zip(x.pos, own, strict=True)]))
            pos = own + pos
        return Flow(df, tuple(pos))

    return run


def _at_lengths(keys: DataFrame, key: str, prefixes: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Keys with their beginnings of each length that a prefix has; the lengths are few and are broadcast."""
    lengths = prefixes.select(F.length(prefix).alias("_len")).where("_len > 0").distinct()
    longest = lengths.agg(F.sort_array(F.collect_set("_len")).alias("_lens"))  # at most one entry a length
    heads = keys.crossJoin(F.broadcast(longest)).select("*", F.explode(F.filter("_lens", lambda n: n <= F.length(key))).alias("_n")).drop("_lens")
    return heads.withColumn("_head", F.expr(f"substring(`{key}`, 1, _n)")).drop("_n"), lengths


@stepwise
def prefix_join_inner(keys: DataFrame, key: str, prefix: str) -> Step:
    """For every prefix, duplicates included, all keys that start with it: an equi-join on cut keys, no nested loop."""

    def run(f: Flow) -> Flow:
        heads, _ = _at_lengths(keys, key, f.df, prefix)
        df = f.df.where(F.length(prefix) > 0).join(heads, F.col(prefix) == F.col("_head")).drop("_head")
        return Flow(df, (*f.pos, key))

    return run


@stepwise
def prefix_join_semi(keys: DataFrame, key: str, prefix: str) -> Step:
    """Each key that starts with some prefix, once, in key order."""

    def run(f: Flow) -> Flow:
        wanted = require_order(f).df.select(F.col(prefix).alias("_prefix")).distinct()
        heads, _ = _at_lengths(keys, key, f.df, prefix)
        df = heads.join(wanted, F.col("_head") == F.col("_prefix"), "left_semi").drop("_head").dropDuplicates([key])
        return Flow(df, (key,), (key,))

    return run


@stepwise
def prefix_join(keys: DataFrame, key: str, prefix: str) -> Step:
    """By the trait: a sorted source filters the keys, an unsorted one is joined with them."""
    return lambda f: (prefix_join_semi if f.ordered else prefix_join_inner)(keys, key, prefix)(f)


def overlap_join(left: DataFrame, right: DataFrame, l_pos: Column, l_count: Column, r_pos: Column, r_count: Column, width: int) -> DataFrame:
    """Pairs of half-open intervals [pos, pos + count) with a point in common.

    Bins are of ``width``, 8 * ``width``, 64 * ``width`` ...: an interval goes to the at most
    nine bins of the level at which it spans at most eight steps, so that long ones do not
    explode.  At each pair of levels, which are few, the finer bins are taken up to the
    coarser; a pair is taken in the first bin that both have, so that it comes once.
    Empty intervals meet nothing.
    """
    steps = [width * 8**k for k in range(21) if width * 8**k < 2**59]

    def leveled(df: DataFrame, pos: Column, count: Column, side: str) -> DataFrame:
        own = df.withColumns({f"_{side}a": pos.cast("long"), f"_{side}b": pos.cast("long") + count}).where(count > 0)
        level = F.lit(len(steps) - 1)
        for k in range(len(steps) - 1, -1, -1):
            level = F.when(F.col(f"_{side}b") - F.col(f"_{side}a") <= 8 * steps[k], k).otherwise(level)
        return own.withColumn(f"_{side}level", level)

    def levels(df: DataFrame, side: str) -> DataFrame:
        """The levels that a side has: at most one row each."""
        return df.select(F.col(f"_{side}level").alias("_level")).distinct()

    def binned(df: DataFrame, side: str, others: DataFrame) -> DataFrame:
        """A row's bins at its own level and at each coarser one that the other side has."""
        coarser = others.agg(F.sort_array(F.collect_set("_level")).alias("_levels"))
        at = df.crossJoin(F.broadcast(coarser)).withColumn("_at", F.explode(F.array_union(F.filter("_levels", lambda v: v > F.col(f"_{side}level")), F.array(f"_{side}level")))).drop("_levels")
        step = F.element_at(F.array(*[F.lit(s).cast("long") for s in steps]), F.col("_at") + 1)
        first, last = F.col(f"_{side}a"), F.col(f"_{side}b") - 1
        down = lambda x: ((x - F.pmod(x, step)) / step).cast("long")  # noqa: E731  # whole, towards minus infinity
        at = at.withColumn("_step", step).withColumn(f"_{side}f", down(first))
        return at.withColumn("_bin", F.explode(F.sequence(F.col(f"_{side}f"), down(last))))

    a, b = leveled(left, l_pos, l_count, "l"), leveled(right, r_pos, r_count, "r")
    x, y = binned(a, "l", levels(b, "r")), binned(b, "r", levels(a, "l")).withColumnsRenamed({"_bin": "_bin2", "_at": "_at2", "_step": "_step2"})
    # a pair meets at the coarser of its two levels
    met = x.join(y, (x["_at"] == y["_at2"]) & (x["_bin"] == y["_bin2"]) & (x["_at"] == F.greatest("_llevel", "_rlevel")))
    hit = (F.col("_la") < F.col("_rb")) & (F.col("_ra") < F.col("_lb")) & (F.col("_bin") == F.greatest("_lf", "_rf"))
    return met.where(hit).drop("_bin", "_bin2", "_at", "_at2", "_step", "_step2", *[f"_{s}{c}" for s in "lr" for c in ("a", "b", "f", "level")])


@stepwise
def zip_short(*others: Flow, name: str = "pos") -> Step:
    """By position, up to the shortest."""
    return _zip(others, "inner", name)


@stepwise
def zip_longest(*others: Flow, name: str = "pos") -> Step:
    """By position, up to the longest; what is missing is null, and ``_has<k>`` tells it from a null."""
    return _zip(others, "full", name)


def _zip(others: Sequence[Flow], how: str, name: str) -> Step:
    def run(f: Flow) -> Flow:
        parts = []
        for k, x in enumerate((f, *others)):
            df = x.ordinal(name).select(name, *x.columns())
            parts.append(df.withColumn(f"_has{k}", F.lit(True)) if how == "full" else df)
        df = parts[0]
        for p in parts[1:]:
            df = df.join(p, name, how)
        for c in df.columns:
            if c.startswith("_has"):
                df = df.withColumn(c, F.coalesce(c, F.lit(False)))
        return Flow(df, (name,))

    return run
