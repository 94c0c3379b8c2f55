"""Encoding many texts with a ``tokenizers`` file, each distinct word once.

The library splits a text into words by a pattern and merges within words only, and no
word reaches over the start of a space that follows another character.  So texts are cut
at white space, in Arrow; a batch's distinct pieces are cut into words by the same pattern;
new words are encoded by the library; and the ids are put together: the result
is the library's own for the whole text.  Pieces with characters whose classes could differ
between versions of Unicode, or with the start of a special token, are encoded by the
library as they are; so are texts with two spaces in a row where spaces are kept.

A worker keeps the ids of words of up to ``MAX_KEY`` characters in two generations of a
table: what is met goes to the young one; when that holds half of ``max_bytes`` it becomes
the old one, and what the old one held goes.  There is one encoder a process and file.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; more threads only hold more memory
from tokenizers import Tokenizer  # noqa: E402

#: letters, digits and white space below U+0180, whose classes all versions of Unicode share
_L, _N, _W = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\t-\\r \u0085\u00a0"
_UNSETTLED = re.compile("[^\x01-\u017f]|<\\|")
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d|"
#: the word patterns of the two kinds of file (fixed values); pieces lie between zeros
_KEEPS_SPACE = re.compile(f"\0|{_CONTRACTIONS} ?[{_L}]+| ?[{_N}]+| ?[^\0{_W}{_L}{_N}]+|[{_W}]+(?![^\0{_W}])|[{_W}]+")
_DROPS_SPACE = re.compile(f"\0|{_CONTRACTIONS}[{_L}]+|[{_N}]|[^\0{_W}{_L}{_N}]+")

MAX_BYTES, MAX_KEY = 64 << 20, 64
_ENTRY = 180  # bytes of a word in a table besides its characters and ids

_id = attrgetter("id")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level model: itself where it can be seen, else one from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(others)}


_LETTERS = _byte_letters()
_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str, max_bytes: int = MAX_BYTES) -> WordEncoder:
    """The encoder of this process: later tasks of a worker find its table filled."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    _encoders[path].max_bytes = max_bytes
    return _encoders[path]


def small_batches(batch: pa.RecordBatch, size: int = 4 << 20, column: int = 1) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes of a column's text: what is made of a part fits in little memory."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size)))
        yield batch.slice(at, to - at)
        at = to


class Ragged:
    """Rows of numbers one after the other."""

    def __init__(self, kind: type):
        self.kind = np.dtype(kind)
        self.flat, self.edges = bytearray(), array("q", [0])

    def __len__(self) -> int:
        return len(self.edges) - 1

    def append(self, flat: np.ndarray, lengths: np.ndarray) -> int:
        """The number of the first row that is new."""
        first, at = len(self), self.edges[-1]
        self.flat += flat.astype(self.kind).tobytes()
        self.edges.frombytes((at + np.cumsum(lengths, dtype=np.int64)).tobytes())
        return first

    def cut(self, rows: int) -> None:
        del self.edges[rows + 1 :]
        del self.flat[self.edges[-1] * self.kind.itemsize :]

    def take(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows ``index`` one after the other, and their lengths."""
        flat, edges = np.frombuffer(self.flat, self.kind), np.frombuffer(self.edges, np.int64)
        starts = edges[index]
        n = edges[index + 1] - starts
        last = np.cumsum(n)
        size = int(last[-1]) if len(last) else 0
        kind = np.int32 if max(size, len(flat)) < 2**31 else np.int64
        at = np.repeat((starts - (last - n)).astype(kind), n)
        at += np.arange(size, dtype=kind)
        return flat[at], n


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each run of ``counts`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class WordEncoder:
    def __init__(self, path: str, max_bytes: int = MAX_BYTES):
        self.tokenizer = Tokenizer.from_file(path)
        #: for what is a single word in normal form already
        self.model = self.tokenizer.model
        with open(path) as f:
            spec = json.load(f)
        #: whether white space is dropped and never part of a token
        self.drops_space = spec["pre_tokenizer"]["type"] == "Sequence"
        self.pattern = _DROPS_SPACE if self.drops_space else _KEEPS_SPACE
        self.max_bytes, self.held = max_bytes, 0
        self.young: dict[str, int] = {"\0": 0}
        self.old: dict[str, int] = {}
        self.odd: dict[str, int] = {}  # pieces that are encoded as they are
        self.ids = Ragged(np.uint32)  # ids of each word and odd piece; the first is none
        self.ids.append(np.zeros(0), np.zeros(1))

    def _library(self, texts: list[str], words: bool = False) -> tuple[np.ndarray, np.ndarray]:
        flat, counts = [], []
        for at in range(0, len(texts), 1024):  # what the library gives back is large
            part = texts[at : at + 1024]
            if words:
                found = list(map(self.model.tokenize, "\0".join(part).encode().decode("latin-1").translate(_LETTERS).split(_LETTERS[0])))
                flat.append(np.fromiter(map(_id, chain.from_iterable(found)), np.uint32))
            else:
                found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                flat.append(np.fromiter(chain.from_iterable(found), np.uint32))
            counts += map(len, found)
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), np.array(counts, np.int64)

    def encode(self, texts: list[str] | pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and each text's number of ids; ``end_id`` follows each text.  Nulls are empty."""
        collecting = gc.isenabled()
        gc.disable()  # there are no cycles here, but many strings to look through
        try:
            return self._encode(pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), ""), end_id)
        finally:
            if collecting:
                gc.enable()

    def _pieces(self, array: pa.Array, space: str) -> tuple[np.ndarray, np.ndarray]:
        """The words of pieces as rows of ``ids``, and their numbers."""
        # joined in Arrow: a string for each piece would cost more than all that follows
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array), f"\0{space}")[0].as_py()
        pieces, odd = array, {}
        if not joined.isascii() and _UNSETTLED.search(joined.replace("\0", " ")) or "<|" in joined or joined.count("\0") >= len(pieces):
            pieces = array.to_pylist()
            odd = {k: space + p for k, p in enumerate(pieces) if "\0" in p or _UNSETTLED.search(p)}
            joined = f"\0{space}".join("" if k in odd else p for k, p in enumerate(pieces))
        joined = f"{space}{joined}\0"
        found = self.pattern.findall(joined.lower() if self.drops_space else joined)
        index = np.fromiter(map(self.young.get, found, repeat(-1)), np.int64, len(found))
        index[index < 0] = self._rows([found[k] for k in np.flatnonzero(index < 0).tolist()])
        ends = np.flatnonzero(index == 0)
        counts = np.diff(ends, prepend=-1) - 1
        index = np.delete(index, ends)
        if odd:
            at = np.array(list(odd))
            own = self._rows(list(odd.values()), words=False)
            # the odd pieces' places hold what an empty piece has: a space's word, or nothing
            edges = np.concatenate([[0], np.cumsum(counts)])
            index = np.delete(index, np.concatenate([np.arange(edges[k], edges[k + 1]) for k in at.tolist()]))
            counts[at] = 0
            index = np.insert(index, np.cumsum(counts)[at], own)
            counts[at] = 1
        return index, counts

    def _rows(self, names: list[str], words: bool = True) -> np.ndarray:
        """The rows of words that the young table has not, or of pieces to be encoded as they are."""
        coded = pa.array(names, pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        # what is too long to be kept has a row until the table turns
        rows = np.fromiter(map((self.old if words else self.odd).get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(rows < 0)
        first = self.ids.append(*self._library([distinct[k] for k in new.tolist()], words))
        rows[new] = np.arange(first, first + len(new))
        if words or len(new):
            self._keep(distinct, rows, self.young if words else self.odd)
        return rows[coded.indices.to_numpy()]

    def _keep(self, names: list[str], rows: np.ndarray, table: dict[str, int]) -> None:
        if 2 * self.held < self.max_bytes:
            table.update((w, r) for w, r in zip(names, rows.tolist(), strict=True) if len(w) <= MAX_KEY)
        edges = np.frombuffer(self.ids.edges, np.int64)
        joined = "".join(names)
        self.held += len(names) * _ENTRY + len(joined) * (1 if joined.isascii() else 4) + 4 * int((edges[rows + 1] - edges[rows]).sum())

    def _turn(self) -> None:
        """The young table becomes the old one, and only its ids are kept."""
        rows = np.fromiter(self.young.values(), np.int64, len(self.young))
        flat, lengths = self.ids.take(rows)
        self.ids = Ragged(np.uint32)
        self.ids.append(flat, lengths)
        self.old = dict(zip(self.young, range(len(rows)), strict=True))
        self.young, self.odd, self.held = {"\0": 0}, {}, 0

    def _encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        whole = np.zeros(0, np.int64)
        if self.drops_space:
            lists = pc.ascii_split_whitespace(texts)
        else:
            double = pc.match_substring(texts, "  ")
            whole = np.flatnonzero(double.to_numpy(zero_copy_only=False))
            lists = pc.split_pattern(pc.if_else(double, "", texts) if len(whole) else texts, " ")
        counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        pieces = lists.flatten()
        coded = pieces.dictionary_encode()
        at = coded.indices.to_numpy()
        rows, n_words = [], []
        for k in range(0, len(coded.dictionary), 1 << 14):
            index, n = self._pieces(coded.dictionary[k : k + (1 << 14)], "" if self.drops_space else " ")
            rows.append(index)
            n_words.append(n)
        if not self.drops_space and len(texts):
            heads = np.cumsum(counts) - counts
            at = at.astype(np.int64)
            at[heads] = len(coded.dictionary) + np.arange(len(heads))
            index, n = self._pieces(pieces.take(pa.array(heads)), "")
            rows.append(index)
            n_words.append(n)
        kept = len(self.ids)  # what follows is forgotten with this batch
        if len(whole):  # their single piece is empty, and has no ids
            index = self.ids.append(*self._library(texts.take(pa.array(whole)).to_pylist())) + np.arange(len(whole))
            at[(np.cumsum(counts) - 1)[whole]] = sum(map(len, n_words)) + np.arange(len(whole))
            rows.append(index)
            n_words.append(np.ones(len(whole), np.int64))
        if end_id is not None:
            at = np.insert(at, np.cumsum(counts), sum(map(len, n_words)))
            counts = counts + 1
            rows.append(np.array([self.ids.append(np.array([end_id]), np.ones(1))]))
            n_words.append(np.ones(1, np.int64))
        made = Ragged(np.uint32)  # ids of this batch's pieces
        if rows:
            rows, n_words = np.concatenate(rows), np.concatenate(n_words)
            flat, n = self.ids.take(rows)
            made.append(flat, sums(n, n_words))
        ids, n_ids = made.take(at)
        self.ids.cut(kept)
        if 2 * self.held > self.max_bytes:
            self._turn()
        return ids, sums(n_ids, counts)
