"""Removal of byte strings that occur twice, by sorting sampled suffixes deep-shallow.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in
the same document or another.  Sorting every suffix of a corpus is out of reach, and not
needed: each window of ``length`` bytes has an anchor, the leftmost of its ``KMER``-byte
strings with the least hash.  Equal windows have equal anchors at equal places, so only
suffixes that start at anchors are sorted, and only with those of the same anchor string.

1. *Runs.* Neighbouring windows with one anchor form a run (about one per 85 bytes).
   Anchor hashes are counted over all documents; runs whose anchor is unique are done.
2. *Spans.* The bytes of every other run go to the task of its anchor, equal spans of a
   task once.  Runs of anchors with over ``hot_group`` runs are cut into shorter ones that
   share more bytes, and go to the tasks of those.
3. *Sorting.* What follows the anchors is sorted by multikey quicksort to a shallow depth:
   parts that are still equal are split three ways around a pivot's next seven bytes, all
   parts at once; those that are equal down to there are ordered by blind tries.  What goes before the anchors is sorted likewise, read backwards.  With
   both orders' common prefix lengths, windows at one distance from their anchors are equal
   if they are in one class of both orders.
4. *Removal.* A run's repeated windows overlap, so that they are one range; ranges are
   united for each document.

Defined results: a null text counts as empty; texts shorter than ``length`` keep all; rows
with the same doc_id, or repeated rows, are documents of their own; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, given_back, written

KMER = 32
PIECE = 1 << 19  # windows that are looked at together: about 60 bytes of memory each
_POSITION = np.uint64((1 << 24) - 1)
_BYTES = np.random.default_rng(200).integers(1, 2**63, 256, np.uint64)
_STEP = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(5)]


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each position on."""
    h = _BYTES[data]
    for k in range(5):
        n = 1 << k
        h = h[:-n] * _STEP[k] + h[n:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, number in it, first window, last window, anchor, hash) of all runs, in order."""
    found, held, size = [], [], 0

    def look() -> None:
        data = np.frombuffer(b"".join(texts[t][a:b] for t, a, b in held), np.uint8)
        sizes = np.array([b - a for _, a, b in held])
        ends = np.cumsum(sizes)
        hashes = kmer_hashes(data)
        least = hashes & ~_POSITION | np.arange(len(hashes), dtype=np.uint64)
        width, n = length - KMER + 1, 1
        while 2 * n <= width:  # least of 1, 2, 4, ... neighbours
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        if n < width:
            least = np.minimum(least[: len(least) - (width - n)], least[width - n :])
        anchor = (least & _POSITION).astype(np.int64)
        piece = np.repeat(np.arange(len(held)), sizes)[: len(anchor)]
        window = np.flatnonzero(np.arange(len(anchor)) + length <= ends[piece])
        anchor, piece = anchor[window], piece[window]
        first = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])])
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(window)) - 1
        shift = np.array([a for _, a, _ in held]) - (ends - sizes)
        of, p = np.array([t for t, _, _ in held]), piece[at]
        found.append((of[p], window[at] + shift[p], window[last] + shift[p], anchor[at] + shift[p], hashes[anchor[at]].view(np.int64)))

    for t, text in enumerate(texts):
        for a in range(0, len(text) - length + 1, PIECE):
            b = min(len(text), a + PIECE + length - 1)
            if held and size + b - a > PIECE:
                look()
                held, size = [], 0
            held.append((t, a, b))
            size += b - a
    if held:
        look()
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    text, first, last, anchor, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    number = np.arange(len(text)) - np.searchsorted(text, text)
    return text, number, first, last, anchor, hashes


# ---- deep-shallow sorting


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, at least ``known``."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n  # equal up to low, not up to high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Orders strings that share a long prefix: inner nodes hold only a depth and the bytes that branch there."""

    def __init__(self, strings: list[bytes], known: int):
        self.strings, self.known = strings, known
        self.root: int | list = 0  # a leaf: a string's number; an inner node: [depth, {byte: child}, some leaf]
        self.same: dict[int, list[int]] = {0: [0]}
        for k in range(1, len(strings)):
            self._insert(k)

    def _insert(self, k: int) -> None:
        s, node = self.strings[k], self.root
        while not isinstance(node, int):  # blindly down, only branching bytes are looked at
            depth, children, leaf = node
            node = children.get(s[depth] if depth < len(s) else -1, leaf)
        other = self.strings[node]
        shared = _common(s, other, self.known)
        if shared == len(s) == len(other):
            self.same[node].append(k)
            return
        self.same[k] = [k]
        a, b = (s[shared] if shared < len(s) else -1), (other[shared] if shared < len(other) else -1)
        above, node = None, self.root
        while not isinstance(node, int) and node[0] < shared:
            above, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == shared:
            node[1][a] = k
            return
        made = [shared, {a: k, b: node}, k]
        if above is None:
            self.root = made
        else:
            above[1][s[above[0]]] = made

    def ordered(self) -> tuple[list[int], list[int]]:
        """Numbers in order, and the common prefix of each with the one before (-1 for the first)."""
        order, shared = [], []
        stack: list[tuple[int | list, int]] = [(self.root, -1)]
        while stack:
            node, with_last = stack.pop()
            if isinstance(node, int):
                for n, k in enumerate(self.same[node]):
                    order.append(k)
                    shared.append(with_last if n == 0 else len(self.strings[k]))
            else:
                children = [node[1][c] for c in sorted(node[1])]
                stack += [(c, node[0]) for c in children[:0:-1]]
                stack.append((children[0], with_last))
        return order, shared


SHALLOW = 28  # bytes, seven at a time


def deep_shallow(strings: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, string), and the common prefix of each with the one before; -1 at a group's first."""
    n = len(strings)
    lcp = np.full(n, -1, np.int64)
    order = np.argsort(groups, kind="stable")
    if not n:
        return order, lcp
    lengths = np.fromiter(map(len, strings), np.int64, n)
    flat = np.frombuffer(b"".join(strings) + bytes(8), np.uint8)
    starts = np.cumsum(lengths) - lengths

    def words(rows: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
        """The next seven bytes, and how many of them are there."""
        left = np.clip(lengths[rows] - depth, 0, 7)
        at = starts[rows] + np.minimum(depth, lengths[rows])
        word = np.zeros(len(rows), np.uint64)
        for k in range(7):
            word = word << np.uint64(8) | np.where(k < left, flat[np.minimum(at + k, len(flat) - 1)], 0).astype(np.uint64)
        return word << np.uint64(8) | left.astype(np.uint64)

    first = np.concatenate([[True], groups[order][1:] != groups[order][:-1]])
    # multikey quicksort: parts that are still equal are split three ways around a pivot's next bytes
    begin = np.flatnonzero(first)
    size, depth = np.diff(np.append(begin, n)), np.zeros(len(begin), np.int64)
    equal: list[tuple[int, int]] = []
    while len(some := np.flatnonzero(size > 1)):
        begin, size, depth = begin[some], size[some], depth[some]
        deep = depth >= SHALLOW
        equal += zip(begin[deep].tolist(), size[deep].tolist(), strict=True)
        begin, size, depth = begin[~deep], size[~deep], depth[~deep]
        if not len(begin):
            break
        part = np.repeat(np.arange(len(begin)), size)
        heads = np.cumsum(size) - size
        places = begin[part] + np.arange(len(part)) - heads[part]
        rows = order[places]
        word = words(rows, depth[part])
        pivot = np.sort(np.stack([word[heads], word[heads + size // 2], word[heads + size - 1]]), axis=0)[1]
        side = 3 * part + 1 + (word > pivot[part]) - (word < pivot[part])
        order[places] = rows[np.argsort(side, kind="stable")]
        size = np.bincount(side, minlength=3 * len(begin))
        begin = np.repeat(begin, 3) + (np.cumsum(size.reshape(-1, 3), axis=1) - size.reshape(-1, 3)).ravel()
        depth = np.repeat(depth, 3)
        depth[1::3] += 7
    # blind tries for what is equal to a shallow depth
    done = first.copy()
    for a, m in equal:
        members = order[a : a + m].tolist()
        own = [strings[k] for k in members]
        sub, shared = BlindTrie(own, min(SHALLOW, *map(len, own))).ordered()
        order[a : a + m] = [members[k] for k in sub]
        lcp[a + 1 : a + m] = shared[1:]
        done[a + 1 : a + m] = True
    # the other neighbours differ above that depth
    left = np.flatnonzero(~done)
    for d in range(0, SHALLOW, 7):
        x, y = words(order[left], d), words(order[left - 1], d)
        differ = x != y
        at, x, y = left[differ], x[differ], y[differ]
        apart = (x ^ y) >> np.uint64(8)
        same = np.zeros(len(at), np.int64)
        for k in range(7):
            same += (apart >> np.uint64(8 * (6 - k))) == 0
        counted = np.minimum(x & np.uint64(255), y & np.uint64(255)).astype(np.int64)
        lcp[at] = d + np.minimum(same, counted)
        left = left[~differ]
    return order, lcp


def repeated(groups: np.ndarray, before: list[bytes], after: list[bytes], nearest: np.ndarray, farthest: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each span the least and the greatest distance of a window that another span has too; -1 if none.

    A window at distance d takes d bytes of ``before`` (read backwards) and length - d of ``after``.
    """
    n = len(groups)
    low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    left, right = deep_shallow(before, groups), deep_shallow(after, groups)
    for d in range(int(nearest.min(initial=length)), int(farthest.max(initial=-1)) + 1):
        active = np.flatnonzero((nearest <= d) & (d <= farthest))
        if len(active) < 2:
            continue
        key = np.zeros(n, np.int64)
        for (order, lcp), least in ((left, d), (right, length - d)):
            kind = np.empty(n, np.int64)
            kind[order] = np.cumsum((lcp < least) | (lcp < 0))
            key = key * (n + 1) + kind
        key = key[active]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = np.zeros(len(active), bool)
        hit[by[1:][same]] = True
        hit[by[:-1][same]] = True
        hit = active[hit]
        low[hit] = np.where(low[hit] < 0, d, low[hit])
        high[hit] = d
    return low, high


# ---- the dataflow


def _batch(schema: pa.Schema, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_RUNS = pa.schema([("hash", pa.int64()), ("key", pa.int64()), ("number", pa.int32())])
_SPANS = pa.schema([("ref", pa.int64()), ("group", pa.int64()), ("nearest", pa.int32()), ("farthest", pa.int32()), ("span", pa.binary()), ("several", pa.bool_()), ("keys", pa.list_(pa.int64())), ("anchors", pa.list_(pa.int64()))])
_FOUND = pa.schema([("ref", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])


def _parts(batches: Iterator[pa.RecordBatch], column: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about ``size`` bytes of a binary column."""
    for batch in batches:
        lengths = np.diff(np.array([0, *np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)])]))
        at = 0
        total = np.cumsum(lengths)
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size)))
            yield batch.slice(at, to - at)
            at = to


def _list_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 1):
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            text, number, _, _, _, hashes = runs(texts, length)
            yield _batch(_RUNS, (hashes, batch.column(0).to_numpy()[text], number))

    return run


def _list_spans(length: int, hot_step: int, hold: int = 32 << 20):
    """Rows (key, text, runs, hot): spans, each distinct one of a part of the task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref = (TaskContext.get().partitionId() + 1) << 36
        seen: dict[bytes, list] = {}
        size = 0

        def out():
            nonlocal seen, size
            rows = list(seen.values())
            seen, size = {}, 0
            for at in range(0, len(rows), 8192):
                yield _batch(_SPANS, list(zip(*rows[at : at + 8192], strict=True)))

        for batch in _parts(batches, 1):
            keys, texts, wanted, hot = (c.to_pylist() for c in batch.columns)
            text, number, first, last, anchor, hashes = runs(texts, length)
            begin = np.searchsorted(text, np.arange(len(texts) + 1))
            for t, (key, data) in enumerate(zip(keys, texts, strict=True)):
                for r, is_hot in zip(wanted[t], hot[t], strict=True):
                    k = begin[t] + r
                    a, b, m, h = int(first[k]), int(last[k]), int(anchor[k]), int(hashes[k])
                    # a hot run is cut by its windows' distance from the anchor, which equal windows share
                    cuts = [None] if not is_hot else range((m - b) // hot_step, (m - a) // hot_step + 1)
                    for c in cuts:
                        x, y, group, mid = a, b, h, m
                        if c is not None:  # the bytes that all windows of the cut hold
                            mid = m - c * hot_step
                            x, y = max(a, mid - hot_step + 1), min(b, mid)
                            group = int.from_bytes(hashlib.blake2b(data[mid : mid - hot_step + 1 + length], digest_size=8, salt=b"%d" % c).digest(), "little", signed=True)
                        span = data[x : y + length]
                        name = hashlib.blake2b(span, digest_size=16, salt=b"%d" % (mid - x)).digest()
                        if (row := seen.get(name)) is None:
                            seen[name] = [ref, group, mid - y, mid - x, span, False, [key], [mid]]
                            ref += 1
                            size += len(span) + 900  # as Python holds it
                        else:
                            row[5] = True
                            row[6].append(key)
                            row[7].append(mid)
                            size += 80
                    if size > hold:
                        yield from out()
        yield from out()

    return run


def _find(length: int, hold: int = 32 << 20):
    """Rows (ref, group, nearest, farthest, span, several), those of a group together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> pa.RecordBatch:
            distinct: dict[tuple, int] = {}
            which, several = [], []
            for ref, group, near, far, span, more in rows:
                k = distinct.setdefault((group, far, span), len(distinct))
                if k == len(several):
                    several.append(more)
                else:
                    several[k] = True
                which.append((ref, k, near, far))
            names = list(distinct)
            groups = np.array([g for g, _, _ in names], np.int64)
            far = np.array([f for _, f, _ in names], np.int64)
            near = np.array([f + length - len(s) for _, f, s in names], np.int64)
            several = np.array(several, bool)
            low, high = np.where(several, near, -1), np.where(several, far, -1)
            _, inverse, counts = np.unique(groups, return_inverse=True, return_counts=True)
            at = np.flatnonzero(counts[inverse] > 1)
            if len(at):
                spans = [names[k] for k in at]
                a, b = repeated(groups[at], [s[:f][::-1] for _, f, s in spans], [s[f:] for _, f, s in spans], near[at], far[at], length)
                a, b = np.where(several[at], near[at], a), np.where(several[at], far[at], b)
                low[at], high[at] = a, b
            refs, k = np.array([w[0] for w in which], np.int64), np.array([w[1] for w in which], np.int64)
            keep = low[k] >= 0
            return _batch(_FOUND, (refs[keep], low[k][keep], high[k][keep]))

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > hold and row[1] != held[-1][1]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) + 400
        if held:
            yield solve(held)

    return run


def _unite(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 1):
            rows = []
            for doc_id, text, firsts, lasts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or b""
                spans = _unite(list(zip(firsts or (), lasts or (), strict=True)))
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                rows.append((doc_id, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            yield _batch(_RESULT, list(zip(*rows, strict=True)))

    return run


def remove_repeats(docs: DataFrame, *, length: int = 200, hot_group: int = 100_000, hot_step: int = 8, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the bytes) if asked for.

    ``length`` is at least 2 * KMER; ``hot_group`` and ``hot_step``: see above.
    """
    if length < 2 * KMER:
        raise ValueError(f"length must be {2 * KMER} or more")
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(text_col).cast("binary").alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    rows = written(rows, "suffix-rows", "zstd")
    texts = rows.select("key", "text").where(F.length("text") >= length)
    listed = written(texts.mapInArrow(lambda b: given_back(_list_runs(length)(b)), "hash long, key long, number int"), "suffix-runs")
    # written, so that the join below deals both sides anew and Spark can split a hot hash
    twice = listed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash", (F.col("n") > hot_group).alias("hot"))
    twice = written(twice, "suffix-twice")
    wanted = listed.join(twice, "hash").groupBy("key").agg(F.collect_list(F.struct("number", "hot")).alias("runs"))
    wanted = written(wanted.select("key", F.col("runs.number").alias("numbers"), F.col("runs.hot").alias("hot")), "suffix-wanted")
    drop_written(spark, listed, twice)
    del listed, twice
    joined = texts.join(wanted.hint("shuffle_hash"), "key").select("key", "text", "numbers", "hot")
    spans = written(joined.mapInArrow(lambda b: given_back(_list_spans(length, hot_step)(b)), "ref long, group long, nearest int, farthest int, span binary, several boolean, keys array<long>, anchors array<long>"), "suffix-spans", "zstd")
    del joined
    drop_written(spark, wanted)
    del wanted
    dealt = spans.select("ref", "group", "nearest", "farthest", "span", "several").repartition("group").sortWithinPartitions("group")
    found = dealt.mapInArrow(lambda b: given_back(_find(length)(b)), "ref long, low int, high int")
    ranges = spans.select("ref", "keys", "anchors").join(found, "ref")
    ranges = ranges.select(F.explode(F.arrays_zip("keys", "anchors")).alias("at"), "low", "high")
    ranges = ranges.select(F.col("at.keys").alias("key"), F.struct((F.col("at.anchors") - F.col("high")).alias("a"), (F.col("at.anchors") - F.col("low") + length).alias("b")).alias("r"))
    by_doc = written(ranges.groupBy("key").agg(F.collect_list("r").alias("r")).select("key", F.col("r.a").alias("a"), F.col("r.b").alias("b")), "suffix-ranges")
    del dealt, found, ranges
    drop_written(spark, spans)
    del spans
    out = rows.join(by_doc.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "a", "b")
    out = out.mapInArrow(lambda b: given_back(_remove(with_text)(b)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")
