"""Token-id shards compressed by Re-Pair, written to files and read back.

Documents are put in ascending doc_id order by a range partitioning; each task cuts its
run into shards of about ``shard_ids`` ids.  In a shard, frequent pairs of neighbouring
symbols within a document are replaced by new symbols again and again: each round counts
all pairs exactly and replaces those that are there ``min_count`` times or more; where two
overlap the more frequent one is replaced.  Rounds go on until no pair is that frequent.

A file (little-endian): magic, version, counts; the rules as two arrays (left, right)
and their expansion lengths; for each document its id, its number of ids and where its
symbols begin; the symbols, in 16 bits where they fit.  The expansion lengths let a
reader find any id of any document without expanding what comes before.

Defined results: a null text counts as empty (its ids are the end id alone); rows with
the same doc_id are documents of their own, in the order of their text; null doc_ids
come first; an empty table gives no files and an empty result; other columns are not read.
A task that runs again writes the same names with the same contents.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import given_back, new_path, written
from .tokenizing import encoder_of, small_batches

MAGIC = b"RPTK"
#: magic, version, bytes a symbol, first nonterminal, rules, documents, symbols, ids
_HEAD = struct.Struct("<4sHHIIIQQ")
_NO_ID = -(2**63)


def re_pair(ids: np.ndarray, begins: np.ndarray, first_symbol: int, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, firsts, lefts, rights): ``begins`` marks each document's first id, ``firsts`` tells its first symbol.

    A round counts the pairs in cells of a hash table, of another hash each round; only
    those in cells that reach ``min_count`` are counted exactly.
    """
    seq, firsts = ids.astype(np.uint32), np.flatnonzero(begins)
    lefts, rights, made = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)], 0
    bits = max(10, min(18, len(seq).bit_length()))
    factor = 0x9E3779B1
    while len(seq) > 1:
        factor = (factor * 0x2C1B3C6D + 0x12) & 0xFFFFFFFF | 1
        cell_of = lambda x, y, f=np.uint32(factor): (x * f + y) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits)
        cell = cell_of(seq[:-1], seq[1:])
        cell[firsts[firsts > 0] - 1] = 1 << bits  # pairs over the edge of two documents
        counts = np.bincount(cell, minlength=(1 << bits) + 1)
        counts[-1] = 0
        where = np.flatnonzero(np.take(counts >= min_count, cell))
        pair = seq[where].astype(np.uint64) << np.uint64(32) | seq[where + 1]
        ordered = np.sort(pair)
        begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        counts = np.diff(np.append(begin, len(ordered)))
        frequent = np.flatnonzero(counts >= min_count)
        if not len(frequent):
            break
        pairs = ordered[begin[frequent]]
        pairs = pairs[np.lexsort((pairs, -counts[frequent]))]  # the most frequent first
        x, y = (pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32)
        rule = np.full(1 << bits, -1, np.int32)
        rule[cell_of(x, y)[::-1]] = np.arange(len(pairs), dtype=np.int32)[::-1]  # of two in one cell the rarer waits for another hash
        rank = rule[cell[where]]
        hit = pairs[rank] == pair
        where, rank = where[hit], rank[hit]
        taken = _without_overlap(where, rank)
        uses = np.bincount(rank[taken], minlength=len(pairs))
        useful = uses >= min(4, (min_count + 1) // 2)
        taken &= useful[rank]
        number = np.cumsum(useful) - 1 + first_symbol + made
        where, rank = where[taken], rank[taken]
        seq[where] = number[rank]
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        seq = seq[keep]
        firsts = firsts - np.searchsorted(where + 1, firsts)
        lefts.append(x[useful])
        rights.append(y[useful])
        made += int(useful.sum())
    return seq, firsts, np.concatenate(lefts), np.concatenate(rights)


def _without_overlap(where: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the ascending places to replace: of two that overlap the one of lower rank, of a run of one rank every other."""
    n = len(where)
    touch = np.zeros(n + 1, bool)  # overlaps the one before
    touch[1:-1] = where[1:] == where[:-1] + 1
    taken = ~(touch[:-1] | touch[1:])
    open_ = np.flatnonzero(~taken)
    run = touch[open_] & (rank[open_] == rank[open_ - 1])
    place = np.arange(len(open_))
    none = np.int32(2**31 - 1)
    value = np.full(n + 2, none, np.int32)  # of what is still open; those of the ends are none
    value[open_ + 1] = 2 * rank[open_] + (place - np.maximum.accumulate(np.where(run, 0, place))) % 2
    while len(open_):
        own = value[open_ + 1]
        before, after = touch[open_], touch[open_ + 1]
        best = (~before | (own < value[open_])) & (~after | (own < value[open_ + 2]))
        taken[open_[best]] = True
        value[open_[best] + 1] = none
        value[open_[best & after] + 2] = none
        value[open_[best & before]] = none
        open_ = open_[value[open_ + 1] != none]
    return taken


def expansion_lengths(lefts: np.ndarray, rights: np.ndarray, first_symbol: int) -> np.ndarray:
    out = np.ones(len(lefts), np.uint32)
    for k, (a, b) in enumerate(zip(lefts.tolist(), rights.tolist(), strict=True)):
        out[k] = (out[a - first_symbol] if a >= first_symbol else 1) + (out[b - first_symbol] if b >= first_symbol else 1)
    return out


def encode_shard(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, first_symbol: int, *, min_count: int = 16) -> bytes:
    begins = np.zeros(len(ids), bool)
    begins[np.cumsum(counts) - counts] = True  # every document has its end id at least
    seq, firsts, lefts, rights = re_pair(ids, begins, first_symbol, min_count)
    wide = 2 if first_symbol + len(lefts) <= 1 << 16 else 4
    keys = np.array([_NO_ID if i is None else i for i in doc_ids], "<i8")
    head = _HEAD.pack(MAGIC, 1, wide, first_symbol, len(lefts), len(keys), len(seq), len(ids))
    parts = [lefts.astype("<u4"), rights.astype("<u4"), expansion_lengths(lefts, rights, first_symbol).astype("<u4"), keys, counts.astype("<i8"), firsts.astype("<i8"), seq.astype(f"<u{wide}")]
    return b"".join([head, *(p.tobytes() for p in parts)])


class Shard:
    """Random access to the documents of a shard's bytes."""

    def __init__(self, data: bytes):
        magic, version, wide, self.first_symbol, rules, docs, symbols, self.n_ids = _HEAD.unpack_from(data)
        if (magic, version) != (MAGIC, 1):
            raise ValueError("not a token shard")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.lefts, self.rights, self.lengths = take("<u4", rules), take("<u4", rules), take("<u4", rules)
        self.keys, self.counts, self.begins = take("<i8", docs), take("<i8", docs), take("<i8", docs)
        self.symbols = take(f"<u{wide}", symbols)

    def doc_ids(self) -> list[int | None]:
        return [None if k == _NO_ID else k for k in self.keys.tolist()]

    def _lengths_of(self, symbols: np.ndarray) -> np.ndarray:
        table = np.ones(len(self.lengths) + 1, np.int64)
        table[1:] = self.lengths
        return table[np.maximum(symbols.astype(np.int64) - self.first_symbol + 1, 0)]

    @cached_property
    def _expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rules one after the other, and where each begins."""
        made: list[bytes] = []
        for a, b in zip(self.lefts.tolist(), self.rights.tolist(), strict=True):
            made.append(b"".join([made[x - self.first_symbol] if x >= self.first_symbol else x.to_bytes(4, "little") for x in (a, b)]))
        return np.frombuffer(b"".join(made), "<u4"), np.cumsum(self.lengths, dtype=np.int64) - self.lengths

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.uint32)
        flat, begins = self._expanded
        lengths = self._lengths_of(symbols)
        rule = np.flatnonzero(symbols >= self.first_symbol)
        source = len(flat) + np.arange(len(symbols), dtype=np.int64)  # an id stands for itself
        source[rule] = begins[symbols[rule] - self.first_symbol]
        last = np.cumsum(lengths)
        at = np.repeat(source - (last - lengths), lengths)
        at += np.arange(len(at))
        return np.concatenate([flat, symbols])[at]

    def document(self, k: int) -> np.ndarray:
        end = self.begins[k + 1] if k + 1 < len(self.begins) else len(self.symbols)
        return self.expand(self.symbols[self.begins[k] : end])

    def id_at(self, k: int, position: int) -> int:
        """One id of document ``k``: only the symbol that holds it is expanded."""
        end = self.begins[k + 1] if k + 1 < len(self.begins) else len(self.symbols)
        ends = np.cumsum(self._lengths_of(self.symbols[self.begins[k] : end]))
        s = int(np.searchsorted(ends, position, side="right"))
        symbol, left = int(self.symbols[self.begins[k] + s]), position - (int(ends[s - 1]) if s else 0)
        while symbol >= self.first_symbol:
            a, b = int(self.lefts[symbol - self.first_symbol]), int(self.rights[symbol - self.first_symbol])
            size = int(self.lengths[a - self.first_symbol]) if a >= self.first_symbol else 1
            symbol, left = (a, left) if left < size else (b, left - size)
        return symbol


def _put(folder: str, name: str, data: bytes) -> None:
    """Write under a name of its own, then rename: readers never see half a file."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/_{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(data)
    fs.move(own, f"{path}/{name}")


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str | Callable[[], str], *, end_id: int = 0, shard_ids: int = 1 << 20, min_count: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents to ``folder``; a row per file: task, shard, name, n_docs, n_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path() if callable(tokenizer_path) else tokenizer_path)
        first_symbol = encoder.tokenizer.get_vocab_size()
        task, shard, keys, counts, ids = TaskContext.get().partitionId(), 0, [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal shard, keys, counts, ids
            name = f"{task:07d}-{shard:05d}.rptk"
            n, flat = np.concatenate(counts), np.concatenate(ids)
            _put(folder, name, encode_shard(keys, n, flat, first_symbol, min_count=min_count))
            row = pa.RecordBatch.from_pydict({"task": [task], "shard": [shard], "name": [name], "n_docs": [len(keys)], "n_ids": [len(flat)]}, schema=pa.schema([("task", pa.int32()), ("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            shard, keys, counts, ids = shard + 1, [], [], []
            return row

        for batch in (b for large in batches for b in small_batches(large)):
            flat, n = encoder.encode(batch.column(1), end_id)
            keys += batch.column(0).to_pylist()
            counts.append(n)
            ids.append(flat)
            if sum(map(len, ids)) >= shard_ids:
                yield flush()
        if keys:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(lambda b: given_back(run(b)), "task int, shard int, name string, n_docs long, n_ids long")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document in the files: name, number (in its file), doc_id, local_start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(content.as_py())
                ids = shard.expand(shard.symbols).astype("<u4").tobytes()
                ends = np.cumsum(shard.counts)
                starts = ends - shard.counts
                crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(crcs)
                for at in range(0, n, 65536):
                    part = slice(at, at + 65536)
                    yield pa.RecordBatch.from_pydict(
                        {"name": [path.rpartition("/")[2]] * len(crcs[part]), "number": np.arange(n)[part], "doc_id": shard.doc_ids()[part], "local_start": starts[part], "n_tokens": shard.counts[part], "ids_crc32": crcs[part]},
                        schema=pa.schema([("name", pa.string()), ("number", pa.int64()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]),
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rptk").load(folder).select("path", "content")
    return files.mapInArrow(lambda b: given_back(run(b)), "name string, number long, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str | Callable[[], str], folder: str | None = None, *, end_id: int = 0, **options) -> DataFrame:
    """Write the shards, read them back; per document: doc_id, start, n_tokens, ids_crc32, file."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-shards")
    made = written(write_shards(docs, folder, tokenizer_path, end_id=end_id, **options), "token-manifest")
    if made.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
    # ids before each file: those of earlier tasks (a row per task), then of the task's earlier files
    tasks = made.groupBy("task").agg(F.sum("n_ids").alias("n"))
    before = tasks.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("task").orderBy("shard")) - F.col("n_ids")
    starts = made.withColumn("within", within).join(before, "task").select("name", (F.col("before") + F.col("within")).alias("first"))
    return read_shards(spark, folder).join(starts, "name").select("doc_id", (F.col("first") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", F.col("name").alias("file"))
