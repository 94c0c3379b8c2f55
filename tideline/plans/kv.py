"""An ordered key-value table: keys are byte strings, unique and not empty.

Reads are plans over (key, value) rows: prefix predicates and comparisons reach the
Parquet scan; tree queries become equi-joins on cut keys, never nested loops.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..flow import Flow
from ..operators.elementwise import take_while
from ..shared import written


_SHORT = 1 << 16  # keys that are broadcast at most


@dataclass(frozen=True)
class KeyValues:
    df: DataFrame
    key: str = "k"

    @property
    def k(self) -> Column:
        return F.col(self.key)

    def _least(self, condition: Column) -> DataFrame:
        """The row with the least key, by a top-1 without a sort of the rest."""
        return self.df.where(condition).orderBy(self.key).limit(1)

    def size(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("size"))

    def scan(self) -> Flow:
        """All rows in key order."""
        return Flow(self.df, (self.key,), (self.key,))

    def find(self, key: str, suffix: str = "") -> DataFrame:
        return self.df.where(self.k == key + suffix)

    def exists(self, key: str) -> DataFrame:
        """Whether the very key is there."""
        return self.find(key).limit(1).agg((F.count("*") > 0).alias("found"))

    def prefix_exists(self, prefix: str) -> DataFrame:
        return self.with_prefix(prefix).df.limit(1).agg((F.count("*") > 0).alias("found"))

    def value_of(self, key: str, value: str = "v") -> DataFrame:
        """The value; raises if the key is not there."""
        found = self.find(key).agg(F.first(value).alias(value), F.count("*").alias("_n"))
        return found.select(F.when(F.col("_n") > 0, F.col(value)).otherwise(F.raise_error(F.lit("no such key"))).alias(value))

    def nodes_count(self) -> DataFrame:
        """How many keys have others below them, and the root."""
        return self.parents().select("parent").where("parent is not null").distinct().agg((F.count("*") + 1).alias("nodes"))

    def lower_bound(self, key: str, prefix: str = "") -> DataFrame:
        """The first row at or after ``key``; none for the empty key.  Within a prefix ``key`` goes on from it."""
        if prefix:
            return self._least(self.k.startswith(prefix) & (self.k >= prefix + key))
        return self._least((self.k >= key) & F.lit(key != ""))

    def next_lower_bound(self, current: str, key: str) -> DataFrame:
        """The first row after ``current`` that is at or after ``key``; an empty key stays where it is."""
        return self.find(current) if key == "" else self._least((self.k > current) & (self.k >= key))

    def next_sibling(self, key: str) -> DataFrame:
        """The first row after ``key`` that does not begin with it."""
        return self._least((self.k > key) & ~self.k.startswith(key))

    def with_prefix(self, prefix: str) -> Flow:
        """Rows whose key begins with the prefix, itself included; none for the empty prefix."""
        return Flow(self.df.where(self.k.startswith(prefix) & F.lit(prefix != "")), (self.key,), (self.key,))

    def prefixed_begin(self, prefix: str) -> DataFrame:
        return self.with_prefix(prefix).df.orderBy(self.key).limit(1)

    def _below(self, key: str) -> DataFrame:
        return self.df.where(self.k.startswith(key) & (F.length(self.k) > len(key)))

    def has_child(self, key: str) -> DataFrame:
        return self._below(key).limit(1).agg((F.count("*") > 0).alias("found"))

    def _minimal(self, rows: DataFrame) -> DataFrame:
        """Rows that no other of these rows' keys is a proper prefix of.  What is needed more than once is written.

        The shortest keys, which cover most, are few: what is below them goes where it is
        read.  Only the rest meets all its keys.
        """
        rows = written(rows, "kv-rows")
        counts = rows.groupBy(F.length(self.key).alias("n")).count().where("n is not null").orderBy("n").collect()  # one row a length
        short, size = [], 0
        for n, count in counts[:-1]:  # nothing is below the longest
            if (size := size + count) > _SHORT:
                break
            short.append(n)
        if short:
            left = rows
            for n in short:
                above = rows.where(F.length(self.key) == n).select(F.col(self.key).alias("_a")).distinct()
                left = left.join(F.broadcast(above), (F.substring(self.key, 1, n) == F.col("_a")) & (F.length(self.key) > n), "left_anti")
            rows = written(left, "kv-left")
        keys = rows.select(F.col(self.key).alias("_a")).distinct()
        lengths = keys.agg(F.sort_array(F.collect_set(F.when(F.length("_a") > (short[-1] if short else 0), F.length("_a")))).alias("_lens"))  # one entry a length
        heads = rows.select(self.key).crossJoin(F.broadcast(lengths)).select(self.key, F.explode(F.filter("_lens", lambda n: n < F.length(self.key))).alias("_n"))
        heads = heads.select(self.key, F.expr(f"substring(`{self.key}`, 1, _n)").alias("_a"))
        covered = heads.join(keys, "_a", "left_semi").select(self.key).distinct()
        return rows.join(covered, self.key, "left_anti")

    def children(self, key: str) -> Flow:
        """The least proper extensions of a key: nothing lies between; none if the key is not there."""
        there = self.find(key).select(F.lit(1).alias("_there")).limit(1)
        df = self._minimal(self._below(key)).crossJoin(F.broadcast(there)).drop("_there")
        return Flow(df, (self.key,), (self.key,))

    def first_child(self, key: str) -> DataFrame:
        """The least key below: what it goes on from would be before it."""
        there = self.find(key).select(F.lit(1).alias("_there")).limit(1)
        return self._below(key).orderBy(self.key).limit(1).crossJoin(F.broadcast(there)).drop("_there")

    def last_child(self, key: str) -> DataFrame:
        return self.children(key).df.orderBy(F.desc(self.key)).limit(1)

    def siblings(self, key: str) -> Flow:
        """From the key on, row after row, each time past what begins with the row; none if the key is not there."""
        there = self.find(key).select(F.lit(1).alias("_there")).limit(1)
        df = self._minimal(self.df.where(self.k >= key)).crossJoin(F.broadcast(there)).drop("_there")
        return Flow(df, (self.key,), (self.key,))

    def top_level(self, prefix: str) -> Flow:
        """Entries under a prefix that no other entry under it is above of."""
        return Flow(self._minimal(self.with_prefix(prefix).df), (self.key,), (self.key,))

    def parents(self) -> DataFrame:
        """Each key with its nearest ancestor, or null: all children queries at once."""
        keys = self.df.select(F.col(self.key).alias("parent"))
        lengths = keys.agg(F.sort_array(F.collect_set(F.length("parent"))).alias("_lens"))
        heads = self.df.select(self.key).crossJoin(F.broadcast(lengths)).select(self.key, F.explode(F.filter("_lens", lambda n: n < F.length(self.key))).alias("_n"))
        heads = heads.select(self.key, F.expr(f"substring(`{self.key}`, 1, _n)").alias("parent"))
        nearest = heads.join(keys, "parent", "left_semi").groupBy(self.key).agg(F.max_by("parent", F.length("parent")).alias("parent"))
        return self.df.join(nearest, self.key, "left")

    def range(self) -> KeyRange:
        """A range to be put together from its beginning, its step and its end."""
        return KeyRange(self)

    # ---- changes give a new table

    def _new(self, rows: DataFrame) -> DataFrame:
        """Rows to write, each key once; an empty key is an error."""
        key = F.col(self.key)
        checked = F.when(F.length(key) > 0, key).otherwise(F.raise_error(F.lit("keys are not empty")).cast("string"))
        return rows.select(*self.df.columns).withColumn(self.key, checked).dropDuplicates([self.key])

    def insert(self, rows: DataFrame) -> KeyValues:
        """Add what is not there; values that are there stay."""
        return KeyValues(self.df.unionByName(self._new(rows).join(self.df.select(self.key), self.key, "left_anti")), self.key)

    def update(self, rows: DataFrame) -> KeyValues:
        """New values for keys that are there."""
        changed = self._new(rows).join(self.df.select(self.key), self.key, "left_semi")
        return KeyValues(self.df.join(changed.select(self.key), self.key, "left_anti").unionByName(changed), self.key)

    def upsert(self, rows: DataFrame) -> KeyValues:
        new = self._new(rows)
        return KeyValues(self.df.join(new.select(self.key), self.key, "left_anti").unionByName(new), self.key)

    def prefixed_insert(self, prefix: str, rows: DataFrame) -> KeyValues:
        """Insert below a prefix: the rows' keys go on from it, an empty one stands for the prefix itself."""
        return self.insert(self._prefixed(prefix, rows))

    def prefixed_upsert(self, prefix: str, rows: DataFrame) -> KeyValues:
        return self.upsert(self._prefixed(prefix, rows))

    def _prefixed(self, prefix: str, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.key, F.concat(F.lit(prefix), F.col(self.key)))

    def erase(self, keys: DataFrame) -> KeyValues:
        return KeyValues(self.df.join(keys.select(self.key), self.key, "left_anti"), self.key)

    def erase_prefix(self, prefix: str, erase_prefix: bool = True) -> KeyValues:
        """Take out a subtree; its root may stay."""
        keep = ~self.k.startswith(prefix)
        return KeyValues(self.df.where(keep if erase_prefix else keep | (self.k == prefix)), self.key)


@dataclass(frozen=True)
class KeyRange:
    """A walk over a table in key order: where it begins, how it steps, while what it goes on.

    A condition ends the walk at the first row that fails, as a loop would.
    """

    table: KeyValues
    first: Column | None = None
    rows: DataFrame | None = None
    siblings: bool = False
    condition: Column | None = None

    def starting(self, at: str | None = None, prefix: str | None = None) -> KeyRange:
        """From the first row at or after a key, or from the first that begins with a prefix; nothing begins with the empty one."""
        k = self.table.k
        return replace(self, first=k >= at if at is not None else k.startswith(prefix) & F.lit(prefix != ""), rows=None)

    def starting_at_child_of(self, key: str) -> KeyRange:
        """From the first child of a key on; nothing if the key is not there."""
        return replace(self, rows=self.table.first_child(key), first=None)

    def by_sibling(self) -> KeyRange:
        """Each step goes past what begins with the row."""
        return replace(self, siblings=True)

    def going_on(self, condition: Column | None = None, prefix: str | None = None) -> KeyRange:
        more = condition if condition is not None else self.table.k.startswith(prefix)
        return replace(self, condition=more if self.condition is None else self.condition & more)

    def lower_bound(self, key: str) -> DataFrame:
        """The first row of the range at or after a key."""
        return self.flow().df.where(self.table.k >= key).orderBy(self.table.key).limit(1)

    def flow(self) -> Flow:
        key, df = self.table.key, self.table.df
        begin = self.rows if self.rows is not None else df.where(self.first if self.first is not None else F.lit(True))
        begin = begin.agg(F.min(key).alias("_begin"))  # one row
        df = df.crossJoin(F.broadcast(begin)).where(F.col(key) >= F.col("_begin")).drop("_begin")
        if self.siblings:
            df = self.table._minimal(df)
        out = Flow(df, (key,), (key,))
        return out if self.condition is None else replace(take_while(self.condition)(out), order=(key,))
