"""Order-preserving packing of token streams into windows by dynamic programming.

Documents are put one after the other by ascending doc_id (a range partitioning, so
that every task holds a run of the order) and the stream of their ids is cut into
windows of at most ``window`` ids.  A window costs its padding (none if its length is a
power of two) plus ``per_window``; a cut costs nothing at a document's end,
``sentence_cut`` at a sentence's end and ``any_cut`` elsewhere.  With candidates
c_0 < c_1 < ... the least cost of cutting at c_j is

    f(j) = cut(j) + min( min_{i : c_j - c_i <= window} f(i) + c_i  +  window - c_j,
                         min_{i : c_j - c_i a power of two} f(i) ) + per_window

The first minimum is over a sliding window and comes from a monotone queue; the second
needs a few lookups.  Candidates are all document ends and sentence ends, at least
``grain`` ids apart, and every ``fill`` ids where there are none.  The program runs over
blocks of about ``block`` ids; the last windows of a block are decided with the next.

Defined results: a null text counts as empty (its ids are the end id alone); rows with
the same doc_id are documents of their own, in the order of their text; null doc_ids
come first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back
from .tokenizing import MAX_BYTES, WordEncoder, encoder_of, small_batches


def padding(length: int, window: int) -> int:
    return 0 if length & (length - 1) == 0 else window - length


def best_cuts(positions: list[int], cost: list[float], window: int, per_window: float = 4.0) -> tuple[list[int], float]:
    """The cheapest cuts of a stream: indices into ``positions``, first and last included.

    ``positions`` ascend by at most ``window``; ``cost`` is what a cut at each costs.
    """
    n = len(positions)
    f, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(positions[0], 0)])  # f(i) + c_i ascends from the left
    at = {positions[0]: 0}
    powers = [1 << k for k in range(window.bit_length())]
    get = at.get
    for j in range(1, n):
        c = positions[j]
        least = c - window
        while positions[queue[0][1]] < least:
            queue.popleft()
        value, i = queue[0]
        value += window - c
        for p in powers[(c - positions[j - 1] - 1).bit_length() :]:  # none begins within the last step
            if (k := get(c - p)) is not None and f[k] <= value:
                value, i = f[k], k
        f[j] = value = value + cost[j] + per_window
        back[j] = i
        at[c] = j
        value += c
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [n - 1], n - 1
    while j:
        j = back[j]
        cuts.append(j)
    return cuts[::-1], f[-1]


def tail_powers(length: int, window: int, any_cut: float) -> list[int]:
    """Lengths to cut a stream's last window into, if that costs less than its padding."""
    parts = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    return parts if (len(parts) - 1) * any_cut < padding(length, window) else [length]


class _Packer:
    """A stream of documents; yields pieces (document, start, length, window, offset)."""

    def __init__(self, window, sentence_ends, sentence_cut, any_cut, per_window, grain, fill, block):
        self.window, self.sentence_ends = window, sentence_ends
        self.sentence_cut, self.any_cut, self.per_window, self.grain, self.fill, self.block = sentence_cut, any_cut, per_window, grain, fill, block
        self.ids: list[np.ndarray] = []
        self.docs: list[list] = []  # key, ids in all, first id here, ids here
        self.held = 0
        self.windows = 0

    def add(self, key, ids: np.ndarray) -> None:
        self.docs.append([key, len(ids), 0, len(ids)])
        self.ids.append(ids)
        self.held += len(ids)

    def candidates(self, ids: np.ndarray) -> tuple[list[int], list[float]]:
        n = len(ids)
        ends = np.cumsum([d[3] for d in self.docs])
        sentence = np.flatnonzero(self.sentence_ends[ids]) + 1
        sentence = sentence[sentence < n]
        spots = np.unique(np.concatenate([[0], ends, sentence, np.arange(self.fill, n, self.fill)]))
        is_end = np.isin(spots, ends)
        is_end[0] = True
        rank = np.where(is_end, 0, np.where(np.isin(spots, sentence), 1, 2))
        cell = spots // self.grain
        keep = is_end.copy()  # of each cell of the grid all document ends, or the first sentence end, or a filler
        order = np.lexsort((spots, rank, cell))
        keep[order[np.concatenate([[True], cell[order][1:] != cell[order][:-1]])]] = True
        fills = keep & (rank == 2)
        if fills.any():  # fillers only where nothing better is near
            near = spots[keep & (rank < 2)]
            k = np.searchsorted(near, spots[fills])
            before, after = near[np.maximum(k - 1, 0)], near[np.minimum(k, len(near) - 1)]
            keep[np.flatnonzero(fills)[after - before <= self.fill]] = False
        spots, rank = spots[keep], rank[keep]
        cost = np.array([0.0, self.sentence_cut, self.any_cut])[rank]
        return spots.tolist(), cost.tolist()

    def drain(self, last: bool):
        if not self.held:
            return
        ids = np.concatenate(self.ids)
        spots, cost = self.candidates(ids)
        cuts, _ = best_cuts(spots, cost, self.window, self.per_window)
        edges = [spots[c] for c in cuts]
        if last:
            parts = tail_powers(edges[-1] - edges[-2], self.window, self.any_cut)
            edges = [*edges[:-1], *(edges[-2] + np.cumsum(parts)).tolist()]
        else:  # the last windows may still change
            edges = [e for e in edges if e <= len(ids) - 8 * self.window] or [0]
        raw = ids.astype("<u4").tobytes()
        d, used = 0, 0  # the document that is under way, and what has been taken of its ids here
        for a, b in zip(edges, edges[1:]):  # noqa: B905
            at = a
            while at < b:
                doc = self.docs[d]
                take = min(b - at, doc[3] - used)
                yield doc[0], doc[2] + used, take, zlib.crc32(raw[4 * at : 4 * (at + take)]), doc[1], self.windows, at - a
                at, used = at + take, used + take
                if used == doc[3]:
                    d, used = d + 1, 0
            self.windows += 1
        left = ids[edges[-1] :]
        self.docs = self.docs[d:]
        if self.docs:
            self.docs[0][2] += used
            self.docs[0][3] -= used
        self.ids, self.held = ([left] if len(left) else []), len(left)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


@lru_cache(2)
def sentence_table(encoder: WordEncoder, marks: str = ".!?") -> np.ndarray:
    """For each id, whether its token ends a sentence: only marks and closing signs.  Made once a process."""
    n = encoder.tokenizer.get_vocab_size()
    table = np.zeros(n + 1, bool)
    for token, i in encoder.tokenizer.get_vocab().items():
        bare = token.removesuffix("</w>").rstrip("\"')]")
        table[i] = bool(bare) and bare[-1] in marks
    return table


def pack(
    docs: DataFrame,
    tokenizer_path: str | Callable[[], str],
    *,
    end_id: int = 2,
    window: int = 4096,
    sentence_cut: float = 6.0,
    any_cut: float = 24.0,
    per_window: float = 4.0,
    grain: int = 64,
    fill: int = 512,
    block: int = 1 << 19,
    max_bytes: int = MAX_BYTES,
    batch_bytes: int = 4 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``max_bytes`` bounds a worker's table of words, ``batch_bytes`` the text that is encoded at once.
    A sequence lies within one task's run of documents; its id holds the task's number
    and its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path() if callable(tokenizer_path) else tokenizer_path, max_bytes)
        packer = _Packer(window, sentence_table(encoder), sentence_cut, any_cut, per_window, grain, fill, block)
        base = TaskContext.get().partitionId() << 36

        def out(last: bool):
            rows = list(packer.drain(last))
            if rows:
                columns = [np.array(c) if k != 0 else list(c) for k, c in enumerate(zip(*rows, strict=True))]
                columns[5] = columns[5] + base
                for at in range(0, len(rows), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 65536], f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

        for batch in (b for large in batches for b in small_batches(large, batch_bytes)):
            keys = batch.column(0).to_pylist()
            ids, lengths = encoder.encode(batch.column(1), end_id)
            at = 0
            for key, n in zip(keys, lengths.tolist(), strict=True):
                packer.add(key, ids[at : at + n])
                at += n
                if packer.held >= block:
                    yield from out(False)
        yield from out(True)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(lambda b: given_back(run(b)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
