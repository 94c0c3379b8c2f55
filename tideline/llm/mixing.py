"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key ``-ln(u) / quality`` with u uniform, made from its doc_id
and a seed: ascending keys are a weighted sample without replacement.  Documents are
sorted by (source, key) over all tasks by a range partitioning, so that a source with a
third of all rows is spread over many; prefix sums are those within a task plus the
sums of the tasks before.  A source's target is ``e`` complete epochs of its size and a
rest: each document is taken e times, and those whose prefix lies within the rest once
more; the document at the edge is taken in part, so that targets are met exactly.

Sizes are numbers of words ``[^\\x20\\x09-\\x0D]+``.  Sources by code point, null last,
weigh ``weights`` in turn; targets share ``share`` of all sizes by weight, none above
``most`` times its source's size, the excess shared anew: target = min(most * size,
level * weight) with one level for all.

Defined results: a null or empty text has size 0 and is taken 0; rows with the same
doc_id are documents of their own, in the order of their text's hash; a null doc_id
counts as an id; a null source is a source, ``''`` another; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_name, written

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The number of words: code units that begin one."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")
    return F.size(F.filter(F.split(flat, " "), lambda w: w != "")).cast("long")


def quality(text: Column) -> Column:
    """Between 0.1 and 1: the share of a text's characters that are ASCII letters, spaces or beyond ASCII."""
    n = F.length(text)
    odd = F.length(F.regexp_replace(text, r"[A-Za-z \u0080-\x{10FFFF}]+", ""))
    return F.when(n > 0, F.lit(1.0) - F.lit(0.9) * odd / n).otherwise(F.lit(1.0))


def uniform(*by: Column) -> Column:
    """In (0, 1), from the first 52 bits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *by)), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sources`` (source, source_size) with weight and target; one row per source.

    With caps r = most * size / weight ascending, the level is the first for which all
    capped sources have r below it and all others do not.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighted = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    caps = weighted.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    below = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    levels = caps.withColumn("level", rest / left)
    # at the first source that is not capped its level holds for it and all after it
    found = levels.withColumn("found", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return found.select("source", "source_size", "weight", F.coalesce(F.least("cap", F.col("found") * F.col("weight")), "cap").alias("target"))


def mix(docs: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and key, that of ``key_col``."""
    tie = F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        (F.col(key_col) if key_col else F.lit(None)).cast("long").alias("key"),
        words(F.col(text_col)).alias("size"),
        (-F.log(uniform(F.lit(str(seed)), name)) / quality(F.coalesce(F.col(text_col), F.lit("")))).alias("order"),
        tie.alias("tie"),
    )
    rows = written(rows, "mix-features")  # the texts are read once: a range partitioning reads its input twice
    order = ("source", "order", "doc_id", "tie")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("row"))
    ordered = written(ordered.drop("tie", "order"), "mix-order")
    parts = ordered.groupBy("source", "task").agg(F.sum("size").alias("part"))
    before = parts.select("source", "task", (F.sum("part").over(Window.partitionBy("source").orderBy("task")) - F.col("part")).alias("before"))
    aims = targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, share, most)
    aims = before.join(aims.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    inner = ordered.withColumn("within", F.sum("size").over(Window.partitionBy("task", "source").orderBy("row")) - F.col("size"))
    b = aims.select(F.col("source").alias("source_"), F.col("task").alias("task_"), "before", "source_size", "target")
    joined = inner.join(b, (F.col("task") == F.col("task_")) & F.col("source").eqNullSafe(F.col("source_")))
    whole = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0))
    rest = whole - epochs * F.col("source_size")
    once = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("within")))
    return joined.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + once).cast("long").alias("taken"), "key")


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: a document taken twice is there twice.

    Of a document taken in part, the row holds the words taken, up to the last one's end;
    documents of size 0 are taken 0 and go.  ``length_col``, where it is there, is kept right.
    """
    columns = docs.columns
    key = new_name(docs, "row_key")
    numbered = written(docs.select(*[F.col(f"`{c}`") for c in columns], F.monotonically_increasing_id().alias(key)), "mix-rows", "zstd")
    taken = mix(numbered, id_col=f"`{id_col}`", text_col=f"`{text_col}`", key_col=key, **options).where("taken > 0")
    # one row per copy: all words, or the first n
    copies = F.expr("transform(sequence(1, cast(ceil(taken / size) as int)), i -> least(size, taken - (i - 1) * size))")
    n, whole = new_name(numbered, "n_words"), new_name(numbered, "n_whole")
    plan = taken.select(F.col("key").alias(key), F.col("size").alias(whole), F.explode(copies).alias(n))
    text = F.col(f"`{text_col}`")
    # split at single separators keeps every word where it was: a cut after n words ends with the n-th
    bits = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.when(F.col(n) < F.col(whole), F.array_join(F.slice(bits, F.lit(1), F.col(n).cast("int")), "")).otherwise(text)
    out = numbered.join(plan, key).withColumn(text_col, cut)
    if length_col in columns:
        out = out.withColumn(length_col, F.when(F.col(n) < F.col(whole), F.length(F.col(f"`{text_col}`")).cast(docs.schema[length_col].dataType)).otherwise(F.col(f"`{length_col}`")))
    return out.select(*[F.col(f"`{c}`") for c in columns])
