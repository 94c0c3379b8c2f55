"""SimHash near-duplicates by a Gray-order hierarchical index.

1. *Fingerprints.* A document's words (ASCII lower case, split at ``[\\x20\\x09-\\x0D]+``)
   form shingles; a bit of the 64-bit fingerprint is 1 if it is set in over half of the
   shingles' XXH64 values.
2. *Buckets.* Of fingerprints that differ in at most d bits, one of d + 1 blocks of bits
   is the same.  Each distinct fingerprint goes to its d + 1 buckets (block, value); a
   bucket with over ``hot_bucket`` members is split by blocks of the remaining bits, by
   the same argument, so no link is lost.
3. *Index.* A task sorts its buckets' fingerprints by Gray rank.  Every ``FAN`` neighbours
   form a node that holds the bits on which all agree, nodes form nodes in turn, and a
   child keeps only the agreed bits that its parent has not.  A search goes down from the
   upper nodes, adds up the differences, and prunes a whole group as soon as they pass d,
   or when all its members are known to be linked to the query already.
4. *Components.* A task passes on a spanning forest of what it linked; alternating large
   and small stars over all tasks' forests give connected components.

Defined results: a null text counts as empty; texts without words have fingerprint 0 and
link like any other; fewer words than a shingle form one; rows with the same doc_id are
documents of their own; a component whose doc_ids are all null has a null id; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside_texts, given_back, new_name, sieved, without, written

FAN = 8
SEED = 42


_MORE = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F)]


def shingles(text: bytes, shingle: int) -> Iterable[bytes]:
    words = text.lower().split()
    if len(words) <= shingle:
        return [b" ".join(words)] if words else []
    return map(b" ".join, zip(*(words[k:] for k in range(shingle))))  # noqa: B905


def wide_fingerprint(text: bytes, shingle: int, width: int, once: bool = False) -> np.ndarray:
    """``width`` times 64 bits: the first 64 from the shingles' XXH64, the others from values mixed from it.

    ``once``: a shingle that comes again does not count again.
    """
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles(text, shingle), repeat(SEED)), np.uint64)
    if not len(hashes):
        return np.zeros(width, np.uint64)
    if once:
        hashes = np.unique(hashes)
    ones = np.zeros(64 * width, np.int64)
    for at in range(0, len(hashes), 1 << 12):
        part = hashes[at : at + (1 << 12), None]
        if width > 1:
            more = part * np.array(_MORE[: width - 1])[None, :]
            part = np.concatenate([part, more ^ (more >> np.uint64(32))], axis=1)
        ones += np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def fingerprint(text: bytes, shingle: int) -> int:
    """The 64-bit fingerprint, as a signed integer."""
    return int(wide_fingerprint(text, shingle, 1).view(np.int64)[0])


def fingerprints(docs: DataFrame, *, shingle: int, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """doc_id, key (that of ``key_col``) and fp of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py() or b"", shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "key", "fp"])

    key = F.col(key_col) if key_col else F.lit(None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.cast("long").alias("key"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(lambda b: given_back(run(b)), "doc_id long, key long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code (a row of 64-bit words, highest first) in the order of the reflected Gray code, as words."""
    out = codes.astype(np.uint64)
    for k in (1, 2, 4, 8, 16, 32):
        out = out ^ (out >> np.uint64(k))
    odd = np.bitwise_count(codes) & 1
    before = (np.cumsum(odd, axis=1) - odd) & 1  # a word turns over after an odd number of ones
    return np.where(before == 1, ~out, out)


class GrayIndex:
    """Codes (rows of words) sorted by (bucket, Gray rank), and levels of nodes above them."""

    def __init__(self, codes: np.ndarray, buckets: np.ndarray):
        codes = codes.reshape(len(buckets), -1)
        order = np.lexsort((*gray_rank(codes).T[::-1], buckets))
        self.order, self.codes, self.buckets = order, codes[order], buckets[order]
        new = np.concatenate([[True], self.buckets[1:] != self.buckets[:-1]])
        firsts = np.flatnonzero(new)
        self.ends = np.append(firsts[1:], len(codes))[np.cumsum(new) - 1]  # where each code's bucket ends
        self.sizes = self.ends - firsts[np.cumsum(new) - 1]
        # of each level: bits all members have at 1, and bits all members have at 0
        ones, zeros = [self.codes], [~self.codes]
        while len(ones[-1]) > 1:
            at = np.arange(0, len(ones[-1]), FAN)
            ones.append(np.bitwise_and.reduceat(ones[-1], at, axis=0))
            zeros.append(np.bitwise_and.reduceat(zeros[-1], at, axis=0))
        self.patterns = ones
        self.masks = [a | b for a, b in zip(ones, zeros, strict=True)]  # agreed bits; at level 0 all
        #: agreed bits that are not the parent's
        self.own = [m & ~self.masks[k + 1][np.arange(len(m)) // FAN] for k, m in enumerate(self.masks[:-1])] + [self.masks[-1]]

    @staticmethod
    def _apart(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return np.bitwise_count((a ^ b) & mask).sum(1, dtype=np.int32)

    def links(self, most: int, chunk: int | None = None, sift: Callable | None = None, labels: np.ndarray | None = None) -> np.ndarray:
        """A label for each code: equal for codes of a bucket that are linked directly or by others.

        ``sift`` picks of the pairs found those that link; codes of one of the ``labels`` are linked already.
        """
        n = len(self.codes)
        chunk = chunk or (1 << 17) // self.codes.shape[1]  # ways down at once; memory grows with the width
        labels = np.arange(n) if labels is None else labels
        level = np.zeros(n, np.int64)
        while True:  # begin where a bucket spans a few nodes
            large = (self.sizes >> (3 * level)) > FAN
            large &= level < len(self.patterns) - 1
            if not large.any():
                break
            level[large] += 1
        for start in np.unique(level[self.ends - np.arange(n) > 1]).tolist():
            queries = np.flatnonzero((level == start) & (self.ends - np.arange(n) > 1))
            at, step = 0, 1 << 14
            while at < len(queries):
                pairs = self._descend(queries[at : at + step], start, most, labels, chunk)
                if pairs is None:  # too many ways down at once
                    step = max(1, min(step, len(queries) - at) // 4)
                    continue
                at, step = at + step, min(2 * step, 1 << 14)
                if len(pairs[0]):
                    labels = _join(labels, *(sift(*pairs) if sift else pairs))
        return labels

    def near_pairs(self, most: int, sure: int, nearest: int | None, places: np.ndarray | None = None, chunk: int | None = None, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of codes of a bucket with at most ``most`` differing bits: of each code the ``nearest`` after it.

        A code of which a pair is left out for that is paired with itself; with None there
        are none.  Pairs with equal ``labels``, numbers of 0 or more, are not looked for.
        Of pairs with ``sure`` or fewer bits those stay that span what they link, a code's
        nearest before it first; codes that they link are told apart no further.  With ``places``, the
        bits of each table's key, a pair is given in the first table that it shares alone: in
        the others it is known to be linked, or left, there.
        """
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def sift(q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            apart = np.bitwise_count(self.codes[q] ^ self.codes[node]).sum(1, dtype=np.int64)
            order = np.lexsort((q, apart, node))
            first = np.empty(len(q), bool)  # the nearest before its second
            first[order] = np.concatenate([[True], node[order][1:] != node[order][:-1]])
            order = np.lexsort((node, apart, q))
            q, node, apart, first = q[order], node[order], apart[order], first[order]
            fresh = np.ones(len(q), bool) if places is None else self.shared_first(q, node, places, self.buckets >> places.shape[1])
            close = apart <= sure
            linked = close & (first | ~fresh)
            ids, place = np.unique(np.concatenate([q, node]), return_inverse=True)
            a, b = place[: len(q)], place[len(q) :]
            labels = _join(np.arange(len(ids)), a[linked], b[linked])
            while len(rest := np.flatnonzero(close & (labels[a] != labels[b]))):  # what is still apart
                more = rest[np.unique(np.maximum(labels[a], labels[b])[rest], return_index=True)[1]]
                linked[more] = True
                labels = _join(labels, a[more], b[more])
            other = np.flatnonzero(~close & fresh)
            if nearest is not None:
                near = np.arange(len(other)) - np.searchsorted(q[other], q[other]) < nearest
                left = np.unique(np.concatenate([q[other[~near]], node[other[~near]]]))
                found.append((left, left))
                other = other[near]
            keep = linked & fresh
            keep[other] = True
            found.append((q[keep], node[keep]))
            return q[linked], node[linked]

        self.links(most, chunk, sift, labels)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    def shared_first(self, q: np.ndarray, node: np.ndarray, places: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Of each pair whether its table, one of a number for each code, is the first of which it shares the key."""
        out = np.ones(len(q), bool)
        for at in range(0, len(q), 4096):
            x = (self.codes[q[at : at + 4096]] ^ self.codes[node[at : at + 4096]]).astype(">u8").view(np.uint8)
            differ = np.unpackbits(x.reshape(-1, 8 * self.codes.shape[1]), axis=1)[:, places].any(2)
            out[at : at + 4096] = differ.argmin(1) == tables[q[at : at + 4096]]
        return out

    def met(self, most: int, labels: np.ndarray, places: np.ndarray | None) -> np.ndarray:
        """Whether each code has a candidate of another label in its bucket; with ``places``, in the first table they share."""
        out = np.zeros(len(self.codes), bool)
        none = np.zeros(0, np.int64)

        def sift(q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            new = ~(out[q] & out[node])
            q, node = q[new], node[new]
            fresh = slice(None) if places is None else self.shared_first(q, node, places, self.buckets >> places.shape[1])
            out[q[fresh]] = out[node[fresh]] = True
            return none, none

        self.links(most, None, sift, labels)
        return out

    def _uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """Of each node of each level the label all its members share, or -1."""
        low, high, out = labels, labels, [labels]
        for k in range(1, len(self.patterns)):
            at = np.arange(0, len(self.patterns[k - 1]), FAN)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append(np.where(low == high, low, -1))
        return out

    def _descend(self, queries: np.ndarray, start: int, most: int, labels: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray] | None:
        shift = 3 * start
        first, last = queries >> shift, (self.ends[queries] - 1) >> shift
        counts = last - first + 1
        q = np.repeat(queries, counts)
        node = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
        apart = self._apart(self.codes[q], self.patterns[start][node], self.masks[start][node])
        uniform = self._uniform(labels) if start else [labels]
        for k in range(start, -1, -1):
            keep = (apart <= most) & (uniform[k][node] != labels[q])
            q, node, apart = q[keep], node[keep], apart[keep]
            if k == 0 or not len(q):
                break
            if len(q) > chunk and len(queries) > 1:
                return None
            below = len(self.patterns[k - 1])
            q, apart = np.repeat(q, FAN), np.repeat(apart, FAN)
            node = (node[:, None] * FAN + np.arange(FAN)).ravel()
            keep = node < below
            q, node, apart = q[keep], node[keep], apart[keep]
            # only what comes after the query, within its bucket
            keep = (node >= q >> (3 * (k - 1))) & (node <= (self.ends[q] - 1) >> (3 * (k - 1)))
            q, node, apart = q[keep], node[keep], apart[keep]
            apart = apart + self._apart(self.codes[q], self.patterns[k - 1][node], self.own[k - 1][node])
        keep = (node > q) & (self.buckets[node] == self.buckets[q])
        return q[keep], node[keep]


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]; labels are indices of codes."""
    labels = labels.copy()
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return labels
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels = further


def _by_root(roots: np.ndarray) -> np.ndarray:
    """Labels of codes: the first code that has the same root."""
    first, of = np.unique(roots, return_index=True, return_inverse=True)[1:]
    return first[of]


def _forest(most: int, hold: int, sure: int | None = None, places: np.ndarray | None = None, nearest: int | None = 8, meet: bool = False):
    """Rows (bucket, node, code), those of a bucket together: (a, b), b the smallest node linked to a; or near pairs, if ``sure`` is there.

    Rows may have a root as well: near pairs are those of two roots.  ``meet``: not the
    pairs, but (bucket, table, node) of all that are in one; the table is -1 without ``places``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(buckets: np.ndarray, nodes: np.ndarray, codes: np.ndarray, *roots: np.ndarray):
            index = GrayIndex(codes, buckets)
            if meet:
                which = np.flatnonzero(index.met(most, _by_root(roots[0][index.order]), places))
                own = index.buckets[which]
                tables = np.full(len(own), -1) if places is None else own >> places.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(tables, pa.int32()), pa.array(nodes[index.order][which], pa.int64())], ["bucket", "table", "node"])
                return
            if sure is not None:
                labels = np.unique(roots[0][index.order], return_inverse=True)[1] if roots else None
                a, b = (nodes[index.order][x] for x in index.near_pairs(most, sure, nearest, places, labels=labels))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b), pa.int64()), pa.array(np.minimum(a, b), pa.int64())], ["a", "b"])
                return
            labels = index.links(most)
            order = np.argsort(labels, kind="stable")
            a, which = nodes[index.order][order], labels[order]
            begin = np.concatenate([[True], which[1:] != which[:-1]])
            least = np.minimum.reduceat(a, np.flatnonzero(begin))[np.cumsum(begin) - 1]
            keep = a != least
            yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(least[keep], pa.int64())], ["a", "b"])

        held: list[tuple] = []
        size = 0
        for batch in batches:
            b, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            c = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u8").astype(np.uint64).reshape(len(b), -1)
            held.append((b, n, c, *(x.to_numpy() for x in batch.columns[3:])))
            size += len(b)
            if size >= hold:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                others = np.flatnonzero(whole[0] != whole[0][-1])
                cut = int(others[-1]) + 1 if len(others) else 0  # where the last bucket begins
                if cut:
                    yield from solve(*(x[:cut] for x in whole))
                held, size = [tuple(x[cut:] for x in whole)], len(whole[0]) - cut
        if size:
            yield from solve(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    return [bits[k * len(bits) // parts : (k + 1) * len(bits) // parts] for k in range(parts)]


def _bucket_id(label: int, bits: list[int]):
    """A 64-bit number from a block's number and value: blocks are runs of bits."""
    mask = sum(1 << b for b in bits)
    return F.xxhash64(F.lit(label), F.col("fp").bitwiseAND(F.lit(mask if mask < 1 << 63 else mask - (1 << 64))))


def local_links(fps: DataFrame, most: int, hot_bucket: int, hold: int = 400_000) -> DataFrame:
    """Spanning forests (a, b) of the links among distinct fingerprints ``fp``."""
    everything = list(range(64))
    blocks = _blocks(everything, most + 1)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("block"), _bucket_id(k, bits).alias("bucket")) for k, bits in enumerate(blocks)])).alias("k")).select("fp", "k.*")
    hot = keyed.groupBy("block", "bucket").count().where(F.col("count") > hot_bucket).select("block", "bucket", F.lit(True).alias("hot"))
    split = F.lit(None)
    for k, bits in enumerate(blocks):
        rest = _blocks([b for b in everything if b not in bits], most + 1)
        inner = F.array(*[F.xxhash64(F.col("bucket"), _bucket_id(100 + j, r)) for j, r in enumerate(rest)])
        split = F.when(F.col("block") == k, inner).otherwise(split)
    marked = keyed.join(hot, ["block", "bucket"], "left")
    dealt = marked.select("fp", F.explode(F.when(F.col("hot"), split).otherwise(F.array("bucket"))).alias("bucket"))
    # a collision of bucket numbers only adds comparisons, which are of whole codes
    code = F.unhex(F.lpad(F.hex("fp"), 16, "0"))
    return dealt.select("bucket", "fp", code.alias("code")).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: given_back(_forest(most, hold)(b)), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's smallest node.

    Large and small stars in turn; each round is written to the shared folder.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionAll(edges.join(least, "a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(lower.select("a", F.col("m").alias("b")))
        edges = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now


def near_groups(docs: DataFrame, *, shingle: int = 5, most: int = 3, hot_bucket: int = 20_000, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (its smallest doc_id), key, fp."""
    marked = written(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col, key_col=key_col), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fps")
    labels = components(local_links(distinct.select("fp"), most, hot_bucket))
    rooted = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(smallest, "root")
    return marked.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "key", "root")


# ---- near copies by similarity


def share_apart(similarity: float) -> float:
    """The share of bits that two sets of shingles with a Jaccard similarity are expected to differ in.

    Two SimHash bits differ with probability angle / pi, and equal-sized sets with
    similarity s are at an angle whose cosine is 2 s / (1 + s).
    """
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def far_bits(similarity: float, width: int) -> int:
    """The bits that fingerprints of candidates differ in at most: two standard deviations more than expected."""
    bits, p = 64 * width, share_apart(similarity)
    return round(bits * p + 2 * math.sqrt(bits * p * (1 - p)))


def table_plan(codes: int, similarity: float, recall: float, bucket: int = 16) -> tuple[int, int]:
    """(tables, bits of a key): keys leave ``bucket`` of so many codes together, and a pair of that similarity shares one of the keys with probability ``recall``."""
    bits = max(8, math.ceil(math.log2(max(codes, 2) / bucket)))
    together = (1 - share_apart(similarity)) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - together)), bits


def bucket_bits(bits: int, tables: int, key_bits: int) -> np.ndarray:
    """For each table the places of its key's bits: disjoint blocks first, then more of another order."""
    rng, out = np.random.default_rng(64), np.arange(bits)
    rows: list[np.ndarray] = []
    while len(rows) < tables:
        rows += [out[k * key_bits : (k + 1) * key_bits] for k in range(bits // key_bits)]
        out = rng.permutation(bits)
    return np.array(rows[:tables])


def _deal(places: np.ndarray):
    """Rows (node, code): each in the bucket of each table; rows (bucket, node, code): each in parts of its bucket, by further tables.  Other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, key_bits = places.shape
        weights = np.uint64(1) << np.arange(key_bits, dtype=np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                bits = np.unpackbits(np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, -1), axis=1)
                keys = (bits[:, places] * weights).sum(2) + (np.arange(tables, dtype=np.uint64) << np.uint64(key_bits))
                if "bucket" in part.schema.names:
                    before = part.column("bucket").to_numpy().view(np.uint64)
                    keys = (keys + before[:, None] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                rows = pa.array(np.repeat(np.arange(part.num_rows), tables))
                others = [c for c in part.schema.names if c != "bucket"]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *(part.column(c).take(rows) for c in others)], ["bucket", *others])

    return run


def candidates(nodes: DataFrame, *, similarity: float, width: int, recall: float, hot_bucket: int, hold: int = 100_000, codes: int | None = None, meet: bool = False) -> DataFrame:
    """Pairs (a, b), a > b, of nodes (node, code) that may have that similarity.

    Codes that differ in up to two standard deviations more bits than expected are
    candidates if they share a key in one of the tables.  The keys' width grows with the
    number of codes (``codes``, or the number of nodes).

    Without a root some are left out: those that others span, those with many nearer ones,
    and, as buckets of more than ``hot_bucket`` are split by the keys of further tables,
    made for as many codes as there are, some of such buckets.  Every node that something is
    left out of is in a pair, be it with itself.  Of nodes (node, code, root) all pairs of
    two roots are given: a hot bucket is dealt in parts, and each part meets each.  Their
    number is quadratic; with ``meet`` there are rows (bucket, table, node) instead, by
    which the nodes of every such pair come together once at least.
    """
    bits, most = 64 * width, far_bits(similarity, width)
    sure = round(bits * share_apart((1 + similarity) / 2))
    n, whole = nodes.count(), "root" in nodes.columns
    names = ["node", "code", *(["root"] if whole else [])]
    schema = "bucket long, node long, code binary" + (", root long" if whole else "")
    places = bucket_bits(bits, *table_plan(codes or n, similarity, recall))
    dealt = nodes.select(*names).mapInArrow(lambda b, places=places: given_back(_deal(places)(b)), schema)
    open_ = None
    if n > hot_bucket:
        hot = written(dealt.groupBy("bucket").count().where(F.col("count") > hot_bucket), "near-hot")
        largest = hot.agg(F.max("count")).first()[0]
        if largest:
            places = None  # in a part of a bucket not all its pairs meet, or some meet twice
            marked = dealt.join(hot.select("bucket", F.ceil(2 * F.col("count") / hot_bucket).cast("int").alias("hot")), "bucket", "left")
            if whole:
                own = F.pmod(F.xxhash64("node"), F.col("hot")).cast("int")
                cells = F.transform(F.sequence(F.lit(0), F.col("hot") - 1), lambda j: F.xxhash64("bucket", F.least(own, j), F.greatest(own, j)))
                parts = marked.where("hot is not null").select(F.explode(cells).alias("bucket"), *names)
            else:
                # within a hot bucket most codes are alike: the further keys are as wide as its size asks for
                inner = bucket_bits(bits, *table_plan(largest, (1 + similarity) / 2, recall))
                parts = marked.where("hot is not null").select("bucket", *names).mapInArrow(_deal(np.random.default_rng(65).permutation(bits)[inner]), schema)
                open_ = marked.where("hot is not null").select(F.col("node").alias("a"), F.col("node").alias("b"))
            dealt = marked.where("hot is null").select("bucket", *names).unionAll(parts)
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    if meet:
        return dealt.mapInArrow(lambda b: given_back(_forest(most, hold, places=places, meet=True)(b)), "bucket long, table int, node long")
    sure, nearest = (-1, None) if whole else (sure, 2)
    pairs = dealt.mapInArrow(lambda b: given_back(_forest(most, hold, sure, places, nearest)(b)), "a long, b long")
    return (pairs.unionAll(open_) if open_ is not None else pairs).distinct()


def jaccard(a: bytes, b: bytes, shingle: int) -> float:
    x, y = set(shingles(a, shingle)), set(shingles(b, shingle))
    return len(x & y) / len(x | y) if x or y else 1.0


def _links(shingle: int, similarity: float):
    """Rows (text, doc_id, l): the pairs (a, b) of the list ``l`` of (a, b, text) whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, _, others in zip(*batch.columns, strict=True):
                own = set(shingles((text.as_py() or "").encode(), shingle))
                rows = []
                for other in others:
                    x = set(shingles((other["text"].as_py() or "").encode(), shingle))
                    same = len(own & x)
                    if same >= similarity * (len(own) + len(x) - same) - 1e-12:
                        rows.append((other["a"].as_py(), other["b"].as_py()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["a", "b"])

    return run


def _with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, doc_id, l): each pair (a, b) of ``l`` with the text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            lists = part.column(2)
            pairs, of = lists.flatten(), np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([pairs.field("a"), pairs.field("b"), part.column(0).take(pa.array(of))], ["a", "b", "text"])


def _shingle_sets(shingle: int):
    """Rows (node, code, root, text): the text's distinct shingles, as hashes, instead of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles(t.as_py() or b"", shingle), repeat(SEED)), np.uint64)).tobytes() for t in part.column(3)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.binary())], ["node", "code", "root", "hashes"])

    return run


def _compare(most: int, similarity: float, places: np.ndarray, hold: int):
    """Rows (bucket, table, node, code, root, hashes), those of a bucket together: roots (a, b) that similar sets of candidates link.

    Sets of two roots are compared here, and what they link is one root from then on.
    ``hold``: bytes of sets, after which the whole buckets are dealt with.
    """

    def solve(buckets: np.ndarray, tables: np.ndarray, codes: np.ndarray, roots: np.ndarray, sets: list[bytes]) -> Iterator[pa.RecordBatch]:
        index = GrayIndex(codes, buckets)
        tables, roots = tables[index.order], roots[index.order]
        sizes = np.array([len(sets[k]) // 8 for k in index.order.tolist()], np.int64)
        ids = np.unique(np.frombuffer(b"".join(sets[k] for k in index.order.tolist()), np.uint64), return_inverse=True)[1].astype(np.int32)
        begin = np.cumsum(sizes) - sizes
        there = np.zeros(len(ids) + 1, bool)

        def sift(q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keep = (tables[q] < 0) | index.shared_first(q, node, places, tables)
            order = np.argsort(q[keep], kind="stable")
            q, node = q[keep][order], node[keep][order]
            similar = np.zeros(len(q), bool)
            edges = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1], [True]])) if len(q) else np.zeros(1, np.int64)
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                n = sizes[q[i]]
                own = ids[begin[q[i]] : begin[q[i]] + n]
                there[own] = True
                for k in range(i, j, 1024):
                    part = node[k : min(k + 1024, j)]
                    ends = np.concatenate([[0], np.cumsum(sizes[part])])
                    at = np.arange(ends[-1]) + np.repeat(begin[part] - ends[:-1], sizes[part])
                    found = np.concatenate([[0], np.cumsum(there[ids[at]])])
                    same = found[ends[1:]] - found[ends[:-1]]
                    similar[k : k + len(part)] = same >= similarity * (n + sizes[part] - same) - 1e-12
                there[own] = False
            return q[similar], node[similar]

        before = _by_root(roots)
        labels = index.links(most, None, sift, before)
        a = np.unique(before)
        x, y = roots[a], roots[labels[a]]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)[x != y], pa.int64()), pa.array(np.minimum(x, y)[x != y], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            buckets, tables, _, codes, roots, sets = zip(*rows, strict=True)
            code = np.frombuffer(b"".join(codes), ">u8").astype(np.uint64).reshape(len(rows), -1)
            yield from solve(np.array(buckets), np.array(tables), code, np.array(roots), list(sets))

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= hold and row[0] != held[-1][0]:
                    yield from flushed(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
        if held:
            yield from flushed(held)

    return run


def linked_roots(found: DataFrame, texts: DataFrame, *, shingle: int, similarity: float, width: int, recall: float, hot_bucket: int, codes: int, hold: int = 16 << 20) -> DataFrame:
    """Pairs (a, b) of roots of ``found`` (node, code, root) that all candidates of two roots link, by ``texts`` (d, text).

    No row stands for a pair: nodes with a candidate of another root go to the buckets
    where they meet, with the hashes of their shingles, and are compared there.  A bucket
    with more than ``hold`` bytes of them is dealt in parts, and each part meets each.
    """
    options = {"similarity": similarity, "width": width, "recall": recall, "hot_bucket": hot_bucket}
    places = bucket_bits(64 * width, *table_plan(codes, similarity, recall))
    met = written(candidates(found, **options, codes=codes, meet=True).distinct(), "near-met")
    nodes = written(met.select("node").distinct().join(found, "node"), "near-met-nodes")
    wanted = sieved(texts.select("d", F.col("text").cast("binary").alias("text")), "d", nodes, "node")
    sets = nodes.join(wanted, nodes["node"] == wanted["d"]).select("node", "code", "root", "text")
    sets = written(sets.mapInArrow(lambda b: given_back(_shingle_sets(shingle)(b)), "node long, code binary, root long, hashes binary"), "near-sets")
    sizes = met.join(sets.select("node", F.length("hashes").alias("size")), "node").groupBy("bucket").agg(F.sum("size").alias("size"))
    large = written(sizes.where(F.col("size") > hold).select("bucket", F.ceil(2 * F.col("size") / hold).cast("int").alias("parts")), "near-large")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("bucket", F.least(own, j), F.greatest(own, j)))
    dealt = met.join(large, "bucket", "left").select(F.explode(F.when(F.col("parts").isNull(), F.array("bucket")).otherwise(cells)).alias("bucket"), "table", "node")
    rows = dealt.join(sets, "node").select("bucket", "table", "node", "code", "root", "hashes").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(lambda b: given_back(_compare(far_bits(similarity, width), similarity, places, hold)(b)), "a long, b long").distinct()


def similar_groups(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, width: int = 4, recall: float = 0.98, hot_bucket: int = 20_000, per_list: int = 200, id_col: str = "doc_id", text_col: str = "text", key_col: str) -> DataFrame:
    """doc_id, key (unique, that of ``key_col``) and root (equal in a group) of every document.

    Candidates come from fingerprints of ``64 * width`` bits, in which each shingle counts
    once (see ``candidates``); documents with one fingerprint are candidates.  What links
    is the texts' own similarity: shared shingles by all shingles.  First candidates are
    compared that span what seems alike, then all others that are in two groups still (see
    ``linked_roots``).
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1)]
            codes = [wide_fingerprint(t, shingle, width, once=True).astype(">u8").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), pa.array(map(xxhash.xxh3_128_digest, texts), pa.binary())], ["key", "code", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(key_col).alias("d"), F.col(text_col).alias("text"))
    marked = written(rows.select("d", F.col("text").cast("binary")).mapInArrow(lambda b: given_back(mark(b)), "key long, code binary, digest binary"), "wide-codes")
    nodes = written(marked.groupBy("code").agg(F.min("key").alias("node")), "wide-nodes")
    same = marked.join(nodes, "code").where("key <> node").select(F.col("key").alias("a"), F.col("node").alias("b"))
    options = {"similarity": similarity, "width": width, "recall": recall, "hot_bucket": hot_bucket}
    first = written(candidates(nodes, **options).unionAll(same), "near-first")

    wanted = first.where("a <> b").select(F.col("a").alias("w"), F.struct("a", "b").alias("l"))
    one = beside_texts(rows, wanted, per_list, "near-one", few=True).mapInArrow(lambda b: given_back(_with_text(b)), "a long, b long, text string")
    both = beside_texts(rows, one.select(F.col("b").alias("w"), F.struct("a", "b", "text").alias("l")), per_list, "near-both", few=True)
    labels = components(both.mapInArrow(lambda b: given_back(_links(shingle, similarity)(b)), "a long, b long"))
    # what was left out: all candidates that are in two groups now
    asked = first.select(F.col("a").alias("key")).unionAll(first.select(F.col("b").alias("key"))).distinct()
    asked = asked.join(marked, "key").select("code").distinct()
    found = marked.join(asked, "code").join(labels, F.col("key") == labels["node"], "left").select("key", "code", "digest", F.coalesce("root", "key").alias("root"))
    found = found.groupBy("code", "root", "digest").agg(F.min("key").alias("node"))  # of equal texts one asks
    found = written(found.select("node", "code", "root"), "near-open")
    more = written(linked_roots(found, rows, shingle=shingle, codes=nodes.count(), **options), "near-more")
    if not more.isEmpty():
        stars = labels.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        labels = components(more.unionAll(stars))
    return rows.select("doc_id", F.col("d").alias("key")).join(labels, F.col("key") == labels["node"], "left").select("doc_id", "key", F.coalesce("root", "key").alias("root"))


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group of similar texts, with the columns of ``docs``: the smallest doc_id, of repeated ones one row."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = new_name(docs, "row_key")
    numbered = written(docs.select(*columns, F.monotonically_increasing_id().alias(key)), "near-rows", "zstd")
    groups = similar_groups(numbered, id_col=f"`{id_col}`", text_col=f"`{text_col}`", key_col=key, **options)
    groups = written(groups, "near-groups")
    keep = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias(key))
    gone = groups.select(F.col("key").alias(key)).join(keep.select(key), key, "left_anti")
    return without(numbered, key, written(gone, "near-gone")).select(*columns)
