"""Versioned storage of a key-value table: immutable Parquet data and a manifest for each version.

A version is a base and a few deltas, rows that were written or erased since; a read lays
the latest of them over the base.  A transaction reads a pinned version, stages its
changes as a plan, and commits by writing its delta, so that what a commit costs depends
on what it changes, and then creating the next version's manifest, which fails if another
transaction has created it.  Data without a manifest is never read, so that a crash leaves
no half version, and ``clean`` removes it.  Deltas beyond ``max_deltas`` become one;
``compact`` writes a new base.  It is a conflict if both transactions' keys overlap; if
they do not, the changes are laid over the newer version.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from enum import Enum

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kv import KeyValues


class StoreError(RuntimeError):
    pass


class ConcurrentChange(StoreError):
    """Another transaction has changed keys in the same range."""


class ClosedTransaction(StoreError):
    """A transaction that is committed or rolled back does nothing more."""


class Isolation(Enum):
    PREVENT = "prevent"
    READ_COMMITTED = "read_committed"
    READ_UNCOMMITTED = "read_uncommitted"


class Files:
    """What is needed of Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def create(self, name: str, text: str) -> bool:
        """Write a file that is not there yet, whole or not at all; False if it is there."""
        path, own = (self._path(f"{self.root}/{n}") for n in (name, f"_{name}.{uuid.uuid4().hex}"))
        out = self._fs.create(own, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.getScheme() != "file":  # a rename does not replace a file there
            done = self._fs.rename(own, path)
        else:  # there it would; a link does not
            local = lambda p: self._jvm.java.nio.file.Path.of(self._fs.makeQualified(p).toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0))
            try:
                self._jvm.java.nio.file.Files.createLink(local(path), local(own))
                done = True
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                    raise
                done = False
        if self._fs.exists(own):
            self._fs.delete(own, False)
        return done

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(f"{self.root}/{name}")).getLength()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]


class Store:
    def __init__(self, spark: SparkSession, root: str, schema: str = "k string, v string", key: str = "k", max_deltas: int = 8):
        self.spark, self.root, self.key, self.max_deltas = spark, root.rstrip("/"), key, max_deltas
        self.files = Files(spark, root)
        self.schema = spark.createDataFrame([], schema).schema
        self.delta_schema = T.StructType([*self.schema, T.StructField("_gone", T.BooleanType())])
        self.listeners: list[Callable[[str, Transaction], bool | None]] = []
        self.open: list[Transaction] = []
        if not self.versions():
            base = self._write("data", spark.createDataFrame([], self.schema))
            self._publish(0, base, [], None)

    def versions(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self.files.names() if n.startswith("manifest-"))

    def manifest(self, version: int) -> dict:
        return json.loads(self.files.read(f"manifest-{version}.json"))

    def table(self, version: int | None = None) -> KeyValues:
        found = self.manifest(self.versions()[-1] if version is None else version)
        base = self.spark.read.schema(self.schema).parquet(f"{self.root}/{found['base']}")
        if not found["deltas"]:
            return KeyValues(base, self.key)
        changed = self._latest(found["deltas"])
        live = changed.where("not _gone").drop("_gone")
        return KeyValues(base.join(changed.select(self.key), self.key, "left_anti").unionByName(live), self.key)

    def _latest(self, deltas: list[str]) -> DataFrame:
        """Of each key that some delta has its row in the last of them."""
        parts = [self.spark.read.schema(self.delta_schema).parquet(f"{self.root}/{d}").withColumn("_at", F.lit(k)) for k, d in enumerate(deltas)]
        if len(parts) == 1:
            return parts[0].drop("_at")
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        return both.groupBy(self.key).agg(F.max_by(F.struct(*self.delta_schema.names), "_at").alias("_row")).select("_row.*")

    def _write(self, kind: str, df: DataFrame) -> str:
        """Data sorted by key, so that row groups are skipped by their statistics."""
        name = f"{kind}-{uuid.uuid4().hex}"
        df.repartitionByRange(self.key).sortWithinPartitions(self.key).write.parquet(f"{self.root}/{name}")
        return name

    def _publish(self, version: int, base: str, deltas: list[str], keys: list[str] | None) -> bool:
        return self.files.create(f"manifest-{version}.json", json.dumps({"base": base, "deltas": deltas, "keys": keys}))

    def compact(self) -> bool:
        """The deltas laid over the base for good: a new version with the same rows; False if another came before."""
        latest = self.versions()[-1]
        return self._publish(latest + 1, self._write("data", self.table(latest).df), [], [])

    def clean(self, keep: int = 10) -> list[str]:
        """Remove versions but the last ``keep``, and data that no manifest names: what crashes left, too.  Not beside writers."""
        versions = self.versions()
        named = {d for v in versions[-keep:] for d in (self.manifest(v)["base"], *self.manifest(v)["deltas"])}
        gone = [f"manifest-{v}.json" for v in versions[:-keep]]
        gone += [n for n in self.files.names() if n.startswith(("data-", "delta-", "_manifest-")) and n not in named]
        for n in gone:
            self.files.delete(n)
        return gone

    def tell(self, event: str, transaction: Transaction) -> None:
        """Listeners in turn; one that returns True is the last."""
        for listen in self.listeners:
            if listen(event, transaction):
                break

    def begin(self, isolation: Isolation = Isolation.READ_COMMITTED) -> Transaction:
        return Transaction(self, isolation)

    def read(self, isolation: Isolation = Isolation.READ_COMMITTED) -> KeyValues:
        """What a reader outside of transactions sees."""
        pending = [t for t in self.open if t.changes]
        if pending and isolation is Isolation.PREVENT:
            raise ConcurrentChange("a transaction is under way")
        if pending and isolation is Isolation.READ_UNCOMMITTED:
            return pending[-1].table()
        return self.table()


@dataclass(frozen=True)
class Change:
    """``how`` changes a table; ``delta`` gives the rows it writes, those that it erases with ``_gone``; ``keys`` are the keys of these, None stands for all."""

    how: Callable[[KeyValues], KeyValues]
    delta: Callable[[KeyValues], DataFrame] | None = None
    keys: DataFrame | None = None


class Savepoint:
    """A transaction within: its rollback drops what came since, its commit keeps it."""

    def __init__(self, transaction: Transaction):
        self.transaction, self.mark = transaction, len(transaction.changes)

    def __enter__(self) -> Savepoint:
        return self

    def __exit__(self, kind, *_) -> None:
        if self in self.transaction.savepoints:
            self.rollback() if kind else self.commit()

    def _end(self) -> None:
        """What was begun within ends with it."""
        points = self.transaction.savepoints
        if self not in points:
            raise ClosedTransaction("the savepoint is closed")
        del points[points.index(self) :]

    def commit(self) -> None:
        self._end()

    def rollback(self) -> None:
        self._end()
        del self.transaction.changes[self.mark :]


class Transaction:
    def __init__(self, store: Store, isolation: Isolation):
        self.store, self.isolation = store, isolation
        self.base = store.versions()[-1]
        self.changes: list[Change] = []
        self.savepoints: list[Savepoint] = []
        self.closed, self.readers = False, 0
        store.open.append(self)
        store.tell("started", self)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if not self.closed:
            self.savepoints.clear()  # the outermost ends, and all within it
            self.rollback() if kind else self.commit()

    def _check(self) -> None:
        if self.closed:
            raise ClosedTransaction("the transaction is closed")

    @contextmanager
    def shared(self) -> Iterator[KeyValues]:
        """The table for readers beside the transaction, which cannot end before they do."""
        self._check()
        self.readers += 1
        try:
            yield self.table()
        finally:
            self.readers -= 1

    def table(self) -> KeyValues:
        """The pinned version with this transaction's own changes."""
        self._check()
        out = self.store.table(self.base)
        for change in self.changes:
            out = change.how(out)
        return out

    def change(self, how: Callable[[KeyValues], KeyValues], keys: DataFrame | None = None, delta: Callable[[KeyValues], DataFrame] | None = None) -> None:
        """Any change of the table; without ``delta`` the commit writes the whole table."""
        self._check()
        self.changes.append(Change(how, delta, keys))

    def _rows(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.store.schema.names, F.lit(False).alias("_gone"))

    def _gone(self, keys: DataFrame) -> DataFrame:
        values = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != self.store.key else F.col(f.name) for f in self.store.schema]
        return keys.select(self.store.key).distinct().select(*values, F.lit(True).alias("_gone"))

    def insert(self, rows: DataFrame) -> None:
        self.change(lambda t: t.insert(rows), rows, lambda t: self._rows(t._new(rows).join(t.df.select(t.key), t.key, "left_anti")))

    def update(self, rows: DataFrame) -> None:
        self.change(lambda t: t.update(rows), rows, lambda t: self._rows(t._new(rows).join(t.df.select(t.key), t.key, "left_semi")))

    def upsert(self, rows: DataFrame) -> None:
        self.change(lambda t: t.upsert(rows), rows, lambda t: self._rows(t._new(rows)))

    def erase(self, keys: DataFrame) -> None:
        self.change(lambda t: t.erase(keys), keys, lambda t: self._gone(keys))

    def erase_prefix(self, prefix: str, erase_prefix: bool = True) -> None:
        def below(t: KeyValues) -> DataFrame:
            gone = t.df.where(t.k.startswith(prefix))
            return self._gone(gone if erase_prefix else gone.where(t.k != prefix))

        self.change(lambda t: t.erase_prefix(prefix, erase_prefix), None, below)

    def savepoint(self) -> Savepoint:
        self._check()
        self.savepoints.append(Savepoint(self))
        return self.savepoints[-1]

    def _range(self) -> list[str] | None:
        """The least and the greatest key that is written."""
        if any(c.keys is None for c in self.changes):
            return None
        low = high = None
        for c in self.changes:
            a, b = c.keys.agg(F.min(self.store.key), F.max(self.store.key)).first()
            if a is not None:
                low, high = (a, b) if low is None else (min(low, a), max(high, b))
        return [] if low is None else [low, high]

    def _delta(self) -> DataFrame | None:
        """All changes as one delta of the pinned version; None if one of them has none."""
        if any(c.delta is None for c in self.changes):
            return None
        key, out, table = self.store.key, None, self.store.table(self.base)
        for c in self.changes:
            rows = c.delta(table)
            out = rows if out is None else out.join(rows.select(key), key, "left_anti").unionByName(rows)
            table = c.how(table)
        return out

    def commit(self) -> None:
        self._check()
        if self.savepoints:
            self.savepoints[-1].commit()
            return
        self._unshared()
        self.store.tell("before_commit", self)
        store, own = self.store, self._range()
        while self.changes:
            latest = store.versions()[-1]
            for v in range(self.base + 1, latest + 1):
                other = store.manifest(v)["keys"]
                if own is None or other is None or (own and other and own[0] <= other[1] and other[0] <= own[1]):
                    self.rollback()
                    raise ConcurrentChange(f"version {v} has changed keys in the same range")
            self.base = latest
            found, delta = store.manifest(latest), self._delta()
            if delta is None:
                base, deltas = store._write("data", self.table().df), []
            else:
                base, deltas = found["base"], [*found["deltas"], store._write("delta", delta)]
                if len(deltas) > store.max_deltas:
                    deltas = [store._write("delta", store._latest(deltas))]
            if store._publish(latest + 1, base, deltas, own):
                break
        self._close("committed")

    def rollback(self) -> None:
        self._check()
        if self.savepoints:
            self.savepoints[-1].rollback()
            return
        self._unshared()
        self.store.tell("before_rollback", self)
        self.changes = []
        self._close("rolled_back")

    def _unshared(self) -> None:
        if self.readers:
            raise StoreError("readers share the transaction")

    def _close(self, event: str) -> None:
        self.closed = True
        self.store.open.remove(self)
        self.store.tell(event, self)


def with_retries(times: int, work: Callable[[], object], pause_s: float = 0.0):
    """``work`` again after a conflict, at most ``times`` times in all."""
    for k in range(times):
        try:
            return work()
        except ConcurrentChange:
            if k == times - 1:
                raise
            time.sleep(pause_s)
    return None
