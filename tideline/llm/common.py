"""Shared plumbing: the shared folder, written tables, row identifiers."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..flow import new_name
from ..shared import drop_written, new_path, remove, shared_dir, written
from ..workers import importable

__all__ = ["beside_texts", "drop_written", "given_back", "new_name", "new_path", "remove", "shared_dir", "sieved", "table", "without", "written"]


def given_back(batches):
    """Batches of a task in Python; at its end the worker, which lives on, gives free memory back to the system."""
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such function
            ctypes.CDLL(None).malloc_trim(0)


#: bits of the sieve in front of a shuffle of texts, whatever the number of rows
SIEVE = 1 << 22


def _sieve(spark: SparkSession, wanted: DataFrame, wanted_key: str, key: str) -> tuple[DataFrame, Column]:
    """One row with a bit set of the wanted keys' hashes, and whether a key's bit is set."""
    place = F.pmod(F.xxhash64(F.col(wanted_key)), F.lit(SIEVE))
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    words = wanted.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(one(place)).alias("bits"))
    table = np.zeros(SIEVE // 64, np.int64)
    found = words.toArrow()  # at most SIEVE / 64 rows
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(SIEVE))
    there = F.element_at("_sieve", F.shiftright(at, 6).cast("int") + 1).bitwiseAND(one(at)) != 0
    return spark.createDataFrame(pa.table({"_sieve": pa.array([table], pa.list_(pa.int64()))})), there


def sieved(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """``rows`` without most of those whose key is not wanted: a bit set of ``SIEVE`` bits is broadcast, so that some others stay."""
    bits, there = _sieve(rows.sparkSession, wanted, wanted_key, key)
    return rows.join(F.broadcast(bits), there).drop("_sieve")


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``rows`` whose key is not in ``gone`` (key): where few are, most rows pass the sieve and go through no shuffle."""
    bits, there = _sieve(rows.sparkSession, gone, key, key)
    here = rows.join(F.broadcast(bits), ~there).drop("_sieve")
    unsure = rows.join(F.broadcast(bits), there).drop("_sieve")
    return here.unionByName(unsure.join(gone, key, "left_anti").select(*rows.columns))


def beside_texts(rows: DataFrame, wanted: DataFrame, per_list: int, name: str, few: bool = False) -> DataFrame:
    """(text, doc_id, l) of ``rows`` (d, text, doc_id): each text with what is wanted of it, rows (w, l).

    That comes in lists of about ``per_list``; a text of which very much is wanted is there
    once a list, and its lists go to different tasks.  ``few``: most texts are not wanted,
    and do not go through the shuffle.
    """
    if few:
        wanted = written(wanted, f"{name}-wanted")
        rows = sieved(rows, "d", wanted, "w")
    hubs = written(wanted.groupBy("w").count().where(F.col("count") > per_list).select("w", F.ceil(F.col("count") / per_list).cast("int").alias("lists")), f"{name}-hubs")
    listed = wanted.join(hubs, "w", "left").select("w", F.when(F.col("lists").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("l"), F.col("lists"))).cast("int").alias("list"), "l")
    lists = listed.groupBy("w", "list").agg(F.collect_list("l").alias("l"))
    texts = rows.join(hubs, rows["d"] == hubs["w"], "left").select("d", "text", "doc_id", F.explode(F.when(F.col("lists").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), "lists"))).alias("list"))
    return texts.join(lists, (texts["d"] == lists["w"]) & (texts["list"] == lists["list"])).select("text", "doc_id", "l")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")
