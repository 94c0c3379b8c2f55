"""Toxicity by noisy-channel deobfuscation and learnt terms.

1. *Language model.* Counts of character 4-grams over all documents (27 classes, so at
   most 32**4 counts whatever the input's size).
2. *Restoring.* Words that look disguised (digits or signs among letters, a letter three
   times or more, single letters set apart) become lattices: a sign may stand for letters,
   a repeated letter for one or two, a gap for nothing or a space.  Viterbi decoding under
   the language model picks the likeliest reading, which is scored with the plain words.
3. *Terms.* From at most ``max_labelled`` labelled rows, in the order of a hash of their
   id, come the terms (words, and beginnings of words of 4 and 5 letters) that mark toxic
   rows; near copies count once.  A logistic regression over the strongest terms scores a
   document by the terms it holds.

Only rows whose crc32 of the doc_id as text is not divisible by 5 are learnt from;
label, language, source and id take no part in a score.

Defined results: a null or empty text scores as one without terms; a null
doc_id counts as the text ``''`` (held out); rows with the same doc_id are scored each by
its own text; of several labels of a doc_id the larger holds, null labels are none;
with labels of one kind only, or none, all score near that label, or 0; an empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back, written

#: what a sign may stand for (fixed values)
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y"}
GAPS = " .-_*~'"

_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = re.escape("".join(k for k in LEET if not k.isdigit()))
# each begins with the rarest character of its match, so that searching is quick
_AMONG = re.compile(rf"[\d{_SIGNS}.\-*~_](?<=[^\W\d_].)[\d{_SIGNS}.\-*~_]*(?=[^\W\d_])")
_BEFORE = re.compile(r"[\d@$!](?<![^\s].)(?=[^\W\d_]{2})")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_TRIPLES = [c * 3 for c in "abcdefghijklmnopqrstuvwxyz"]
# in every match of the two that follow
_ALONE = re.compile(rf"[ .\-_*~][\w{_SIGNS}][ .\-_*~]{{1,2}}[\w{_SIGNS}][ .\-_*~]")
_SPACED = re.compile(rf"(?<![\w{_SIGNS}])(?:[\w{_SIGNS}][ .\-_*~]{{1,2}}){{3,}}[\w{_SIGNS}](?![\w{_SIGNS}])")
_DOTTED = re.compile(rf"(?<![\w{_SIGNS}])(?:[\w{_SIGNS}][.\-_*~]){{3,}}[\w{_SIGNS}](?![\w{_SIGNS}])")
_SPACE = re.compile(r"\s")


def _classes() -> np.ndarray:
    """Of each Latin-1 byte: 0 for what is no letter, 1 to 26 for a letter without its accents."""
    import unicodedata

    table = np.zeros(256, np.uint32)
    for b in range(256):
        c = unicodedata.normalize("NFD", chr(b).lower())[0]
        if "a" <= c <= "z":
            table[b] = ord(c) - 96
        elif chr(b).isalpha():
            table[b] = 27
    return table


CLASSES = _classes()


def _class(c: str) -> int:
    return int(CLASSES[ord(c)]) if ord(c) < 256 else 27 if c.isalpha() else 0


def count_4grams(texts: Iterable[str], counts: np.ndarray) -> None:
    """Add the 4-grams of the texts, each set between spaces."""

    def add(joined: str) -> None:
        c = CLASSES[np.frombuffer(joined.encode("latin-1", "replace"), np.uint8)]
        for at in range(0, len(c) - 3, 1 << 20):
            part = c[at : at + (1 << 20) + 3]
            np.add(counts, np.bincount(part[:-3] << 15 | part[1:-2] << 10 | part[2:-1] << 5 | part[3:], minlength=1 << 20), out=counts)

    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > 1 << 20:
            add(f"   {'   '.join(held)}   ")
            held, size = [], 0
    if held:
        add(f"   {'   '.join(held)}   ")


def corpus_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of character 4-grams over all texts: one array of 2**20."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 20, np.int64)
        for batch in batches:
            count_4grams((t.as_py() or "" for t in batch.column(0)), counts)
        codes = np.flatnonzero(counts)
        for at in range(0, len(codes), 65536):
            part = codes[at : at + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(counts[part], pa.int64())], ["code", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(lambda b: given_back(run(b)), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << 20, np.float64)
    out[found["code"].to_numpy()] = found["n"].to_numpy()
    return out


class Decoder:
    """Viterbi over character lattices under an interpolated 4-gram model."""

    def __init__(self, counts: np.ndarray):
        n4 = counts.reshape(32, 32, 32, 32)
        n3 = n4.sum(3, keepdims=True)
        b3 = n4.sum(0)
        b2, b1 = b3.sum(0), b3.sum((0, 1))
        share = lambda n: n / np.maximum(n.sum(-1, keepdims=True), 1)
        p = 0.75 * n4 / np.maximum(n3, 1) + 0.17 * share(b3)[None] + 0.06 * share(b2)[None, None] + 0.018 * share(b1)[None, None, None] + 0.002 / 32
        self.cost = (-np.log(p)).astype(np.float32).ravel()
        self.cache: dict[str, str] = {}

    def decode(self, seen: str) -> str:
        """The likeliest plain reading of a disguised run of characters."""
        if (found := self.cache.get(seen)) is None:
            if len(self.cache) > 50_000:
                self.cache.clear()
            found = self.best(seen)[1].strip()
            if len(seen) <= 256:
                self.cache[seen] = found
        return found

    @staticmethod
    def lattice(seen: str) -> list[list[tuple[str, float]]]:
        """Of each run of equal characters the strings it may stand for, with what the channel costs."""
        out = []
        for m in re.finditer(r"(.)\1*", seen, re.DOTALL):
            c, n = m[1], len(m[0])
            if c in LEET:
                letters = LEET[c]
                arcs = [(x * k, 1.0 + 0.7 * (k - 1)) for x in letters for k in range(1, min(n, 2) + 1)]
                arcs.append(("", 3.5) if c in "!|+(" else (" ", 6.0))
            elif c in GAPS:
                arcs = [("", 0.5), (" ", 1.0)]
            elif c.isalpha():
                arcs = [(c * k, (0.3 if n > 2 else 1.5) * abs(n - k) if n < 4 else 0.3 * k) for k in range(1, min(n, 2) + 1)]
            else:
                arcs = [(" ", 0.5)]
            out.append(arcs)
        return out

    def best(self, seen: str) -> tuple[float, str]:
        """The least cost of a path through the lattice, and what it emits.

        Exact: a state is the last three classes, of which few can be told apart after the
        same characters, so that all are kept.  Paths share what they have in common.
        """
        cost = self.cost
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for arcs in [*self.lattice(seen.lower()), [(" ", 0.0)]]:
            following: dict[int, tuple[float, tuple | None]] = {}
            for state, (value, path) in states.items():
                for emitted, channel in arcs:
                    s, v = state, value + channel
                    for c in emitted:
                        code = s << 5 | _class(c)
                        v += cost[code]
                        s = code & 0x7FFF
                    if s not in following or following[s][0] > v:
                        following[s] = (v, (path, emitted))
            states = following
        value, path = min(states.values(), key=lambda x: x[0])
        out = []
        while path:
            path, emitted = path
            out.append(emitted)
        return float(value), "".join(reversed(out))


def restored(text: str, decoder: Decoder | None) -> list[str]:
    """Plain readings of what looks disguised in a text (lower case)."""
    if decoder is None:
        return []
    spots = [m.start() for m in _AMONG.finditer(text)]
    spots += [m.start() for m in _BEFORE.finditer(text)]
    if not text.isascii() or any(t in text for t in _TRIPLES):
        spots += [m.start() for m in _REPEATED.finditer(text)]
    found, end = set(), -1
    for spot in sorted(spots):
        if spot >= end:  # the run without white space around it
            start = max(text.rfind(" ", 0, spot), text.rfind("\n", 0, spot), text.rfind("\t", 0, spot)) + 1
            for m in _SPACE.finditer(text, start, spot):  # white space of other kinds
                start = m.end()
            m = _SPACE.search(text, spot)
            end = m.start() if m else len(text)
            found.add(text[start:end])
    if _ALONE.search(text):
        found.update(m.group() for m in _SPACED.finditer(text))
        found.update(m.group() for m in _DOTTED.finditer(text))
    return [decoder.decode(x) for x in sorted(found)]


def terms(text: str | None, decoder: Decoder | None) -> set[str]:
    """The words of a text and of its restored parts, and their beginnings (with ``*``)."""
    text = (text or "").lower()
    words = set(_WORD.findall(text))
    for r in restored(text, decoder):
        words.update(_WORD.findall(r))
    out = {w for w in words if len(w) > 2}
    out.update([w[:4] + "*" for w in words if len(w) > 3])
    out.update([w[:5] + "*" for w in words if len(w) > 4])
    return out


def evidence(a: np.ndarray, b: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Signed log-likelihood ratio of a term in a toxic and b clean rows."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    n, rate = n_toxic + n_clean, (a + b) / max(n_toxic + n_clean, 1)

    def part(x, e):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(e, 1e-300)), 0.0)

    g = 2 * (part(a, rate * n_toxic) + part(b, rate * n_clean) + part(n_toxic - a, (1 - rate) * n_toxic) + part(n_clean - b, (1 - rate) * n_clean))
    return np.where(a * n > (a + b) * n_toxic, g, -g)


SIGNATURE = 64
_MIX = np.random.default_rng(9).integers(1, 2**61, SIGNATURE, np.uint64) | np.uint64(1)


def signature(names: set[str]) -> np.ndarray:
    """Least hashes of a row's terms: the share in which two agree is their similarity."""
    if not names:
        return np.zeros(SIGNATURE, np.uint32)
    h = np.array([zlib.crc32(t.encode()) for t in names], np.uint64) + np.uint64(1)
    return ((h[:, None] * _MIX[None, :]) >> np.uint64(29)).astype(np.uint32).min(0)


def independent(signatures: np.ndarray, similar: float = 0.6) -> np.ndarray:
    """Rows that are no near copies of a row before them."""
    kept: list[int] = []
    for k in range(len(signatures)):
        if not kept or (signatures[kept] == signatures[k]).mean(1).max() < similar:
            kept.append(k)
    return np.array(kept, np.int64)


def fit(rows: list[np.ndarray], signatures: np.ndarray, toxic: np.ndarray, n_terms: int, most: int, ridge: float, weight: float, rounds: int = 400) -> tuple[np.ndarray, np.ndarray, float]:
    """(terms, weights, intercept) of a logistic regression on the ``most`` terms of most evidence.

    Near copies of a toxic row count once, or the words that they share would all look
    like marks.  Toxic rows count ``weight`` times.
    """
    at = np.flatnonzero(toxic)
    at = np.concatenate([at[independent(signatures[at])], np.flatnonzero(~toxic)])
    y = toxic[at].astype(np.float32)
    held = np.zeros((len(at), n_terms), bool)
    for k, r in enumerate(at):
        held[k, rows[r]] = True
    g = evidence(held[toxic[at]].sum(0), held[~toxic[at]].sum(0), int(y.sum()), int((1 - y).sum()))
    chosen = np.sort(np.argsort(-g, kind="stable")[:most])
    x = held[:, chosen].astype(np.float32)
    del held
    share = np.where(y > 0, weight, 1.0).astype(np.float32)
    pace = 4.0 / (4 * ridge + 2 * weight * x.sum(0) + 1)
    w, b = np.zeros(len(chosen), np.float32), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    ahead, ahead_b = w, b
    for _ in range(rounds):
        r = share * (1 / (1 + np.exp(-(x @ ahead + ahead_b))) - y)
        new, new_b = ahead - pace * (x.T @ r + ridge * ahead), ahead_b - 4.0 * float(r.sum()) / (weight * len(y))
        ahead, ahead_b = new + 0.9 * (new - w), new_b + 0.9 * (new_b - b)
        w, b = new, new_b
    return chosen, w, float(b)


class Model:
    def __init__(self, weights: dict[str, float], base: float):
        self.weights, self.base = weights, base
        self.beginnings = {t[:3] for t in weights}

    def score(self, text: str | None, decoder: Decoder | None) -> float:
        text = (text or "").lower()
        words = set(_WORD.findall(text))
        for r in restored(text, decoder):
            words.update(_WORD.findall(r))
        get, hit = self.weights.get, self.beginnings
        found = {}
        for w in words:
            if w[:3] in hit:
                for t in (w, w[:4] + "*", w[:5] + "*"):
                    if (p := get(t)) is not None:
                        found[t] = p
        z = self.base + math.fsum(found.values())
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, shared, *, max_labelled: int = 20_000, max_terms: int = 4_000, max_features: int = 1_000, ridge: float = 0.25, toxic_weight: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most ``max_labelled`` labelled rows that are not held out."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # at most max_labelled pairs of numbers are broadcast
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = written(rows, "labelled")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = [*counts[1], *(t for t in counts[0] if t not in counts[1])]
            columns = [pa.array(names, pa.string()), *(pa.array([counts[k][t] for t in names], pa.int64()) for k in (1, 0))]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, ["term", "a", "b"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[toxic > 0].update(terms(text.as_py(), shared.value))
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield out()
        yield out()

    sizes = {bool(r[0]): r[1] for r in rows.groupBy(F.col("toxic") > 0).count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return Model({}, 20.0 if n_toxic else -20.0)
    found = rows.select("text", "toxic").mapInArrow(lambda b: given_back(tally(b)), "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ratio = F.col("a") * n_clean > F.col("b") * n_toxic * 4
    x, y = F.col("a") / n_toxic, (F.col("a") + F.col("b")) / (n_toxic + n_clean)
    strength = F.col("a") * F.log(x / y)
    best = found.where((F.col("a") >= 3) & ratio).orderBy(F.desc(strength), "term").limit(max_terms).toArrow()
    names = best["term"].to_pylist()
    index = {t: k for k, t in enumerate(names)}

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, marks = [], []
            for x in batch.column(0):
                names = terms(x.as_py(), shared.value)
                held.append(sorted(index[t] for t in names if t in index))
                marks.append(signature(names).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32())), pa.array(marks, pa.list_(pa.int64())), batch.column(1)], ["held", "marks", "toxic"])

    table = rows.select("text", "toxic").mapInArrow(lambda b: given_back(hold(b)), "held array<int>, marks array<bigint>, toxic int").toArrow()
    marks = np.array(table["marks"].to_pylist(), np.int64).reshape(-1, SIGNATURE)
    picked, weights, base = fit([np.array(h, np.int64) for h in table["held"].to_pylist()], marks, table["toxic"].to_numpy() > 0, len(names), max_features, ridge, toxic_weight)
    return Model({names[k]: float(q) for k, q in zip(picked, weights, strict=True)}, base)


def scored(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and key, that of ``key_col``."""
    context = docs.sparkSession.sparkContext
    decoder = context.broadcast(Decoder(corpus_counts(docs, text_col)))
    model = context.broadcast(learn(docs, labels, decoder, id_col=id_col, text_col=text_col, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, d = model.value, decoder.value
        for batch in batches:
            scores = [m.score(t.as_py(), d) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "key", "score"])

    key = F.col(key_col) if key_col else F.lit(None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.cast("long").alias("key"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(lambda b: given_back(run(b)), "doc_id long, key long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "key")


def keep_clean(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    context = docs.sparkSession.sparkContext
    decoder = context.broadcast(Decoder(corpus_counts(docs, f"`{text_col}`")))
    model = context.broadcast(learn(docs, labels, decoder, text_col=text_col, **options))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, d = model.value, decoder.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield part.filter(pa.array([m.score(t.as_py(), d) < 0.5 for t in part.column(place)], pa.bool_()))

    return docs.mapInArrow(lambda b: given_back(run(b)), docs.schema)
