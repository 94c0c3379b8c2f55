"""Streams: an append-only log, a queue, micro-batches that change a store."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import Files, Store


class Log:
    """Append-only Parquet in buckets (row groups) of ``bucket`` rows; columns in ``bloom`` get Bloom filters, ``sort`` gives tight statistics for skipping."""

    def __init__(self, spark: SparkSession, path: str, schema: str, sort: str | None = None, bloom: Iterable[str] = (), bucket: int | None = None):
        self.spark, self.path, self.schema, self.sort, self.bloom, self.bucket = spark, path, schema, sort, tuple(bloom), bucket

    def append(self, df: DataFrame) -> None:
        out = df.repartitionByRange(self.sort).sortWithinPartitions(self.sort) if self.sort else df
        writer = out.write.mode("append")
        if self.bucket:
            writer = writer.option("parquet.block.row.count.limit", self.bucket)
        for c in self.bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def indexed(self, condition: Column) -> DataFrame:
        """Row groups are skipped by statistics and filters, and the rows are checked too."""
        return self.read().where(condition)

    def rows_read(self, condition: Column) -> int:
        """How many rows the scan of ``indexed`` gave to the check of rows: all of the buckets that were not skipped."""
        found = self.indexed(condition)
        found.collect()
        leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
        plans = [leaves.apply(k) for k in range(leaves.size())]
        plans = [p.plan() if p.getClass().getSimpleName() == "ShuffleQueryStageExec" else p for p in plans]
        return sum(p.metrics().apply("numOutputRows").value() for p in plans if p.metrics().contains("numOutputRows"))

    def last(self, by: str) -> DataFrame:
        """The row with the greatest ``by``."""
        return self.read().orderBy(F.desc(by)).limit(1)

    def size(self) -> DataFrame:
        return self.read().agg(F.count("*").alias("size"))

    def tail(self, max_files: int = 1) -> DataFrame:
        """The log as a stream, ``max_files`` a micro-batch."""
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", max_files).parquet(self.path)


class Queue:
    """Items pushed by one side, read as a stream by the other; nothing is pushed after ``stop``."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.files, self.stopped, self.pushed = Files(spark, path), False, 0

    def push(self, *items: dict) -> None:
        if self.stopped:
            raise RuntimeError("the queue has been stopped")
        self.files.create(f"{self.pushed:012d}-{uuid.uuid4().hex}.json", "\n".join(json.dumps(x) for x in items))
        self.pushed += 1

    def stop(self) -> None:
        self.stopped = True

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).option("pathGlobFilter", "*.json").json(self.path)


def run_once(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """All that is there now, in micro-batches, then an end."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def upsert_into(store: Store, by: str | None = None) -> Callable[[DataFrame, int], None]:
    """Each micro-batch is one transaction; of several rows of a key the one with the greatest ``by`` counts.

    A batch that comes again after a failure writes the same values again.
    """

    def each(batch: DataFrame, number: int) -> None:
        rows = batch
        if by:
            whole = F.struct(*batch.columns)
            rows = batch.groupBy(store.key).agg(F.max_by(whole, by).alias("_row")).select("_row.*").drop(by)
        with store.begin() as t:
            t.upsert(rows.select(*store.schema.names))

    return each
