"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

The candidates are dealt to blocks of about ``candidate_block_bytes``, evenly, whatever
their ids; the queries, the far smaller side, go to every block.  A task holds one block
and streams the queries by.  Its candidates are turned into postings by dimension (those
with a component other than 0, and its value).  For each dimension in turn the queries'
components are scattered, weighted, into dense score arrays (query x candidate) of at
most ``score_bytes``.  A partition selection keeps the k best of each array, merged with
the best so far; the blocks' bests are merged after a shuffle by query.

Scores are exact: integers, added in 64 bits where the largest possible score fits, and
as Python integers otherwise; a score beyond 64 bits is returned as the nearest that fits.

Defined results: vectors that are null, or hold null or non-finite components, take no
part; neither do rows with a null id.  Vectors of other lengths are padded with zeros.
Ties go to the smaller id.  A row with a query's id is the query's own and no candidate
for it; of queries with the same id the row with the smallest vector stands, candidates
with the same id are candidates of their own.  Empty vectors score 0.  An empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import given_back

LIMIT = 2**63 - 1


def scaled(vector: Column, scale: float) -> Column:
    """Each component as floor(scale * x), a whole double."""
    return F.transform(vector, lambda x: F.expr("0D") + F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))


def usable(vector: Column) -> Column:
    """Whether all components are finite; null vectors are not."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))


def _matrix(vectors: pa.Array, scale: float, width: int | None = None) -> np.ndarray:
    """Rows of floor(scale * x): int64 where that is exact, else Python integers."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    width = max(int(lengths.max(initial=0)), width or 0)
    big = bool(len(flat)) and np.abs(flat).max() >= 2**31
    out = np.zeros((len(lengths), width), object if big else np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    columns = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, columns] = np.array([int(x) for x in flat], object) if big else flat.astype(np.int64)
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All inner products (queries x candidates), one dimension at a time; in 32 bits if all fit."""
    width = min(queries.shape[1], candidates.shape[1])
    top = lambda m: int(max(abs(m.max()), abs(m.min()))) if m.size else 0
    bound = top(queries) * top(candidates) * max(width, 1)
    exact = queries.dtype != object and candidates.dtype != object and bound <= LIMIT
    kind = (np.int32 if bound < 2**31 else np.int64) if exact else object
    scores, part = np.zeros((len(queries), len(candidates)), kind), np.empty((len(queries), len(candidates)), kind)
    for d in range(width):
        asked, posting = np.flatnonzero(queries[:, d]), np.flatnonzero(candidates[:, d])
        if not len(asked) or not len(posting):
            continue
        weights = queries[asked, d].astype(kind)
        values = candidates[posting, d].astype(kind)
        if len(asked) == len(queries) and len(posting) == len(candidates):
            np.multiply(weights[:, None], values[None, :], out=part)
            scores += part
        else:
            scores[np.ix_(asked, posting)] += weights[:, None] * values[None, :]
    return scores if exact else np.clip(scores, -LIMIT - 1, LIMIT).astype(np.int64)


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best, best first: high scores, then small ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        need = k - len(above)
        if len(level) > need:  # of the ties those with the smallest ids
            level = level[np.argpartition(ids[level], need - 1)[:need]]
        chosen = np.concatenate([above, level])
    else:
        chosen = np.arange(len(scores))
    return chosen[np.lexsort((ids[chosen], ~scores[chosen]))]


def select_rows(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of each row's k best; ``ids`` ascend; a row's ``own`` id takes no part."""
    n, m = scores.shape
    first, last = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
    top = int(max(abs(int(scores.max())), abs(int(scores.min())))) if scores.size else 0
    if (top + 2) * m > 2**62:  # row by row
        out = [(np.zeros(0, np.int64),) * 3]
        for q in range(n):
            kept = np.delete(np.arange(m), slice(first[q], last[q]))
            chosen = kept[select(scores[q, kept], ids[kept], k)]
            out.append((np.full(len(chosen), q), ids[chosen], scores[q, chosen]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))
    # score and place in one number: ties go to the smaller id
    key = scores.astype(np.int64)
    key *= m
    key += np.arange(m - 1, -1, -1)
    none = -(2**63)
    for q in np.flatnonzero(last > first).tolist():
        key[q, first[q] : last[q]] = none
    if m > k:
        key.partition(m - k, axis=1)
        key = key[:, m - k :]
    row, at = np.nonzero(key != none)
    key = key[row, at]
    return row, ids[m - 1 - key % m], key // m


def _search(k: int, scale: float, block: int, score_bytes: int):
    """Rows (cell, asking, id, vector), a cell's candidates before its queries."""

    def solve(ids: np.ndarray, candidates: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, score_bytes // (8 * block))
        for q in range(0, len(query_ids), step):
            found = [select_rows(accumulate(queries[q : q + step], candidates[c : c + block]), ids[c : c + block], query_ids[q : q + step], k) for c in range(0, len(ids), block)]
            row, vec, score = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((vec, ~score, row))
            order = order[np.arange(len(row)) - np.searchsorted(row[order], row[order]) < k]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (query_ids[q : q + step][row[order]], vec[order], score[order])], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, ids, candidates = None, [], None, None

        def close() -> None:
            """All candidates of the cell are there."""
            nonlocal held, ids, candidates
            if held:
                ids = np.concatenate([h.column(2).to_numpy() for h in held])
                order = np.argsort(ids, kind="stable")
                ids, candidates = ids[order], _matrix(pa.concat_arrays([h.column(3) for h in held]), scale)[order]
                held = []

        for batch in batches:
            cells, asking = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]) | (asking[1:] != asking[:-1])])) if len(cells) else np.zeros(0, np.int64)
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(cells)]):  # noqa: B905
                part = batch.slice(a, b - a)
                if cells[a] != cell:
                    cell, held, ids, candidates = cells[a], [], None, None
                if not asking[a]:
                    held.append(part)
                    continue
                close()
                if ids is not None:
                    yield from solve(ids, candidates, part.column(2).to_numpy(), _matrix(part.column(3), scale))

    return run


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding", candidate_block_bytes: int = 64 << 20, score_bytes: int = 16 << 20, block: int = 4096) -> DataFrame:
    """For each row with ``is_query`` its k best others: query_id, rank (from 1), vec_id, score."""
    id_, vector = F.col(id_col).cast("long"), F.col(vector_col)
    rows = vectors.where(id_.isNotNull() & usable(vector))
    candidates = rows.select(id_.alias("vec_id"), vector.alias("vector"))
    queries = rows.where(is_query).select(id_.alias("vec_id"), vector.alias("vector"))
    n, size = candidates.select(F.count("*"), F.sum(8 * F.size("vector").cast("long"))).first()
    # blocks of a bounded size, and enough of them for all cores
    cells = max(1, -(-(size or 0) // candidate_block_bytes), min(-(-n // block), vectors.sparkSession.sparkContext.defaultParallelism))
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cells)).cast("int")
    asked = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    dealt = candidates.select(number.alias("cell"), F.lit(0).alias("asking"), "vec_id", "vector").unionAll(asked.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(1).alias("asking"), "vec_id", "vector"))
    dealt = dealt.repartition("cell").sortWithinPartitions("cell", "asking")
    best = dealt.mapInArrow(lambda b: given_back(_search(k, scale, block, score_bytes)(b)), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
