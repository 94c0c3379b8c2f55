"""Exact deduplication by Grace hashing with open-addressing tables.

Texts are equal when identical after deleting the characters ``[\\x20\\x09-\\x0D]``.

1. *Combine.* Each task runs its own rows, a bounded chunk at a time, through an
   open-addressing table that compares complete contents.  It writes one row per
   document (``uid``, ``gid`` of its local group) and, once per local group, the
   content.  A group that holds a third of all rows thus leaves a task as one content.
2. *Partition.* Contents are shuffled by their hash.  In each task a table takes them
   in; when the distinct contents pass ``memory_bytes`` the table and all later
   records go to spill files by the next bits of the hash, and each file is treated in
   the same way, until a bucket fits.
3. *Return.* Documents join their group's verdict on ``gid``, which is spread evenly
   because a hot group has a gid of its own in every task and chunk.

Defined results: a null text counts as empty; empty texts equal each other; rows with
the same doc_id are rows of their own; a null doc_id sorts after all others; full ties
(same length and doc_id) keep the row met first; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, given_back, new_name, without, written

SPACES = b" \t\n\x0b\x0c\r"
NO_ID = 2**63 - 1


class ContentTable:
    """Open addressing with linear probing; equality is of the complete content."""

    def __init__(self, slots: int = 1024):
        self.mask = slots - 1
        self.slots = np.full(slots, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def add(self, h: int, content: bytes) -> tuple[int, bool]:
        """(index of the entry, whether it is new)."""
        slots, mask, i = self.slots, self.mask, h & self.mask
        while (k := slots[i]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                return int(k), False
            i = (i + 1) & mask
        slots[i] = k = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 200
        if len(self.contents) * 5 > mask * 3:
            self._grow()
        return k, True

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = np.full(self.mask + 1, -1, np.int64)
        for k, h in enumerate(self.hashes):
            i = h & self.mask
            while self.slots[i] >= 0:
                i = (i + 1) & self.mask
            self.slots[i] = k


#: of a record: digest, length in code points, doc_id, uid, rows, number of gids
_HEAD = struct.Struct("<32sqqqqIQ")


class Record:
    """A content with the best row so far, the number of rows and the local groups."""

    __slots__ = ("best", "content", "digest", "gids", "rows")

    def __init__(self, digest: bytes, content: bytes, best: tuple[int, int, int], rows: int, gids: list[int]):
        self.digest, self.content, self.best, self.rows, self.gids = digest, content, best, rows, gids

    def pack(self) -> bytes:
        n, i, u = self.best
        return _HEAD.pack(self.digest, n, i, u, self.rows, len(self.gids), len(self.content)) + np.array(self.gids, "<i8").tobytes() + self.content


def _read(path: str) -> Iterator[Record]:
    with open(path, "rb", buffering=1 << 20) as f:
        while head := f.read(_HEAD.size):
            digest, n, i, u, rows, gids, size = _HEAD.unpack(head)
            yield Record(digest, gids=np.frombuffer(f.read(8 * gids), "<i8").tolist(), content=f.read(size), best=(n, i, u), rows=rows)


def better(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """Of (code points, doc_id, uid): most code points, then smallest doc_id, then smallest uid."""
    return min(a, b, key=lambda x: (-x[0], x[1], x[2]))


def grace(records: Iterable[Record], memory_bytes: int, folder: str, fan_out_bits: int = 4, depth: int = 0) -> Iterator[Record]:
    """Merge the records of equal contents, in bounded memory."""
    table, merged, files, names = ContentTable(), [], None, []
    fan, low = 1 << fan_out_bits, 64 + fan_out_bits * depth

    def spill(r: Record) -> None:
        files[int.from_bytes(r.digest, "little") >> low & (fan - 1)].write(r.pack())

    try:
        for r in records:
            if files is not None:
                spill(r)
                continue
            k, new = table.add(int.from_bytes(r.digest[:8], "little") & (2**62 - 1), r.content)
            if new:
                merged.append(r)
            else:
                m = merged[k]
                m.best, m.rows = better(m.best, r.best), m.rows + r.rows
                m.gids.extend(r.gids)
            if table.bytes > memory_bytes and len(merged) > 1 and low + fan_out_bits <= 256:
                names = [os.path.join(folder, f"{depth}-{i:02d}") for i in range(fan)]
                files = [open(n, "wb", buffering=1 << 18) for n in names]  # noqa: SIM115
                for m in merged:
                    spill(m)
                table, merged = ContentTable(), []
    finally:
        for f in files or ():
            f.close()
    yield from merged
    for i, name in enumerate(names):
        os.makedirs(below := os.path.join(folder, f"d{depth}-{i:02d}"))
        yield from grace(_read(name), memory_bytes, below, fan_out_bits, depth + 1)
        os.remove(name)
        shutil.rmtree(below)


_LOCAL = "uid long, gid long, key long, doc_id long, text_sha256 string, digest binary, content binary, best_chars long, best_id long, best_uid long, n_rows long"


def _combine(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (TaskContext.get().partitionId() + 1) << 38
        uid, rows, size, table, merged = base, [], 0, ContentTable(), []

        def flush():
            seen: set[int] = set()
            out = {name: [] for name in schema.names}
            for u, k, key, i in rows:
                r = merged[k]
                first = k not in seen
                seen.add(k)
                for name, v in zip(schema.names, (u, r.gids[0], key, i, r.digest.hex(), r.digest if first else None, r.content if first else None, *(r.best if first else (None,) * 3), r.rows if first else None), strict=True):
                    out[name].append(v)
            for at in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name][at : at + 4096], f.type) for f in schema], schema=schema)

        schema = pa.schema([("uid", pa.int64()), ("gid", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("digest", pa.binary()), ("content", pa.binary()), ("best_chars", pa.int64()), ("best_id", pa.int64()), ("best_uid", pa.int64()), ("n_rows", pa.int64())])
        for batch in batches:
            for doc_id, text, chars, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = (text or b"").translate(None, SPACES)
                digest = hashlib.sha256(content).digest()
                best = (chars or 0, NO_ID if doc_id is None else doc_id, uid)
                k, new = table.add(int.from_bytes(digest[:8], "little") & (2**62 - 1), content)
                if new:
                    merged.append(Record(digest, content, best, 1, [uid]))
                else:
                    merged[k].best, merged[k].rows = better(merged[k].best, best), merged[k].rows + 1
                rows.append((uid, k, key, doc_id))
                uid += 1
                if table.bytes + 100 * len(rows) > chunk_bytes:
                    yield from flush()
                    rows, table, merged = [], ContentTable(), []
        yield from flush()

    return run


_VERDICT = "gid long, keep_id long, keep_uid long, group_size long"


def _resolve(memory_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for gid, digest, content, chars, i, u, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield Record(digest, content, (chars, i, u), n, [gid])

        schema = pa.schema([("gid", pa.int64()), ("keep_id", pa.int64()), ("keep_uid", pa.int64()), ("group_size", pa.int64())])

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        rows: list[tuple] = []
        with tempfile.TemporaryDirectory() as folder:
            for r in grace(records(), memory_bytes, folder):
                _, i, u = r.best
                rows += [(g, None if i == NO_ID else i, u, r.rows) for g in r.gids]
                if len(rows) >= 4096:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    return run


def _groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None, chunk_bytes: int = 48 << 20, memory_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """The groups, and the written table of local contents that they are read from."""
    key = F.col(key_col) if key_col else F.lit(None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"), F.length(text_col).cast("long").alias("c"), key.cast("long").alias("key"))
    local = written(rows.mapInArrow(lambda b: given_back(_combine(chunk_bytes)(b)), _LOCAL), "exact-local")
    contents = local.where(F.col("content").isNotNull()).select("gid", "digest", "content", "best_chars", "best_id", "best_uid", "n_rows")
    verdict = contents.repartition("digest").mapInArrow(lambda b: given_back(_resolve(memory_bytes)(b)), _VERDICT)
    groups = local.select("uid", "gid", "key", "doc_id", "text_sha256").join(verdict, "gid").select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256", "key")
    return groups, local


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None, chunk_bytes: int = 48 << 20, memory_bytes: int = 64 << 20) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, key (that of ``key_col``).

    ``chunk_bytes`` bounds what a task combines at once, ``memory_bytes`` the distinct
    contents a table holds before it spills.
    """
    return _groups(docs, id_col=id_col, text_col=text_col, key_col=key_col, chunk_bytes=chunk_bytes, memory_bytes=memory_bytes)[0]


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 48 << 20, memory_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and no others."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = new_name(docs, "row_key")
    numbered = written(docs.select(*columns, F.monotonically_increasing_id().alias(key)), "exact-rows", "zstd")
    groups, local = _groups(numbered, id_col=f"`{id_col}`", text_col=f"`{text_col}`", key_col=key, chunk_bytes=chunk_bytes, memory_bytes=memory_bytes)
    gone = written(groups.where("not kept").select(F.col("key").alias(key)), "exact-gone")
    del groups
    drop_written(docs.sparkSession, local)  # the contents have been compared
    return without(numbered, key, gone).select(*columns)
