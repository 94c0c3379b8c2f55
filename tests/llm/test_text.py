"""Packing, token files, mixing, chat, toxicity, search and the pipeline against brute force and round trips."""

import collections
import hashlib
import itertools
import random
import re
import sys
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from awkward_cases import AWKWARD
from pyspark.sql import functions as F

from tideline.llm import chat, mixing, packing, queries, token_io, tokenizing, topk, toxicity

tokenizers = pytest.importorskip("tokenizers")


def path(name):
    public = pytest.importorskip("public_tokenizers")
    return public.path(name)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("max_bytes", [64 << 20, 20_000, 1])
def test_encoder_is_the_library(name, max_bytes):
    rng = random.Random(1)
    signs = ["a", "b", "é", " ", "  ", "\n", "\t", "'s", "'S", ".", "!!", "12", "ß", "漢", "\x00", "\x1c", " ", "<|endoftext|>", "<|", "Σ", "̈", "İ", "\r\n", "|"]
    texts = [r[1] or "" for r in AWKWARD if r[0] != 8] + ["".join(map(chr, range(1, 0x250)))] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    library = tokenizers.Tokenizer.from_file(path(name))
    encoder = tokenizing.WordEncoder(path(name), max_bytes)
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        for end in (None, 7):
            ids, lengths = encoder.encode(part, end)
            for t, x in zip(part, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
                assert x.tolist() == library.encode(t, add_special_tokens=False).ids + ([] if end is None else [end])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_keeps_to_its_bytes(name):
    """New words without end, of another script too, and a word of 5 MB."""
    budget = 2 << 20
    encoder = tokenizing.WordEncoder(path(name), budget)
    for n in range(10):
        encoder.encode([" ".join(chr(0x4E00 + (7 * n + k) % 20_000) * 3 + str(k % 10) for k in range(3_000)), " ".join(f"word{n}x{k}" for k in range(20_000))])
        tables = [encoder.young, encoder.old, encoder.odd]
        assert sum(sys.getsizeof(t) for t in tables) + sum(sys.getsizeof(w) + 32 for t in tables for w in t) + len(encoder.ids.flat) + 8 * len(encoder.ids.edges) < 1.5 * budget
    encoder.encode(["x" * 5_000_000 + " y", "z"])
    assert len(encoder.ids.flat) < budget and max(map(len, [*encoder.young, *encoder.old, *encoder.odd])) <= tokenizing.MAX_KEY


def best_by_force(positions, cost, window, per_window):
    best = [0.0] + [float("inf")] * (len(positions) - 1)
    for j in range(1, len(positions)):
        for i in range(j):
            n = positions[j] - positions[i]
            if n <= window:
                best[j] = min(best[j], best[i] + packing.padding(n, window) + cost[j] + per_window)
    return best[-1]


def test_packing_program_is_optimal():
    rng = random.Random(2)
    for _ in range(100):
        steps = [rng.randint(1, 9) for _ in range(rng.randint(1, 40))]
        positions = [0, *itertools.accumulate(steps)]
        cost = [rng.choice((0.0, 1.0, 5.0)) for _ in positions]
        cuts, value = packing.best_cuts(positions, cost, 32, 0.5)
        assert cuts[0] == 0 and cuts[-1] == len(positions) - 1
        assert all(positions[b] - positions[a] <= 32 for a, b in itertools.pairwise(cuts))
        assert value == pytest.approx(best_by_force(positions, cost, 32, 0.5))


@pytest.mark.parametrize("block", [1 << 19, 5000])
def test_packing(spark, awkward, empty, block):
    rows = packing.pack(awkward, path("word_bpe_49k.json"), window=512, block=block).collect()
    library = tokenizers.Tokenizer.from_file(path("word_bpe_49k.json"))
    want = collections.Counter()
    for r in AWKWARD:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want[r[0], len(ids), sum(ids)] += 1
    texts = collections.defaultdict(list)
    for r in AWKWARD:
        texts[r[0]].append(library.encode(r[1] or "", add_special_tokens=False).ids + [2])
    covered = collections.Counter()
    for r in rows:
        assert any(len(t) == r.doc_tokens and crc(t[r.start : r.start + r.length]) == r.ids_crc32 for t in texts[r.doc_id])
        covered[r.doc_id] += r.length
    assert covered == {k: sum(map(len, v)) for k, v in texts.items()}
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    padded = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 512
        padded += packing.padding(at, 512)
    assert padded < 0.03 * sum(covered.values())
    assert packing.pack(empty, path("word_bpe_49k.json")).count() == 0


def test_re_pair_round_trip():
    rng = np.random.default_rng(3)
    for n, symbols in ((0, 5), (1, 5), (3000, 3), (20_000, 40), (500, 60_000)):
        counts = np.array([1 + int(x) for x in rng.integers(0, 9, n)] or [1])
        ids = rng.integers(0, symbols, int(counts.sum())).astype(np.uint32)
        data = token_io.encode_shard(list(range(len(counts))), counts, ids, symbols, min_count=3)
        shard = token_io.Shard(data)
        assert (shard.expand(shard.symbols) == ids).all()
        for k in range(0, len(counts), 97):
            own = ids[counts[:k].sum() : counts[: k + 1].sum()]
            assert (shard.document(k) == own).all() and [shard.id_at(k, p) for p in range(len(own))] == own.tolist()
        pairs = [(a, b) for begin, end in itertools.pairwise([*shard.begins.tolist(), len(shard.symbols)]) for a, b in itertools.pairwise(shard.symbols[begin:end].tolist()) if a != b]
        assert max(collections.Counter(pairs).values(), default=0) < 3  # no frequent pair is left
    assert len(token_io.Shard(token_io.encode_shard([1], np.array([8000]), np.tile(np.arange(4, dtype=np.uint32), 2000), 4)).symbols) < 1500
    with pytest.raises(ValueError):
        token_io.Shard(b"\0" * 64)


@pytest.mark.parametrize("shard_ids", [1 << 20, 100])
def test_token_files(spark, awkward, empty, shard_ids):
    rows = token_io.token_files(awkward, path("byte_bpe_50k.json"), shard_ids=shard_ids).orderBy("start").collect()
    library = tokenizers.Tokenizer.from_file(path("byte_bpe_50k.json"))
    at = 0
    for r, (i, t) in zip(rows, sorted(((r[0], r[1]) for r in AWKWARD), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())), strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), crc(ids))
        at += len(ids)
    assert token_io.token_files(empty, path("byte_bpe_50k.json")).count() == 0


# ---- mixing


def shared_out(sizes, weights, total, most):
    """Shares by weight, the excess over ``most`` times a size shared anew until there is none."""
    capped, out = set(), {}
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in sizes if s not in capped]
        out = {s: most * sizes[s] for s in capped} | {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        over = {s for s in free if out[s] > most * sizes[s] + 1e-9}
        if not over:
            return out
        capped |= over


def test_targets(spark):
    rng = random.Random(4)
    for _ in range(6):
        names = [*[f"s{k}" for k in range(rng.randint(1, 7))], None]
        sizes = {s: rng.choice((0, 1, 50, 1000, 100_000)) for s in names}
        weights = dict(zip(sorted(names, key=lambda s: (s is None, s or "")), itertools.cycle((3, 1, 2))))  # noqa: B905
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df, (3, 1, 2), 1.5, 2.0).collect()}
        want = shared_out(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
        assert got == {s: pytest.approx(v, abs=1e-6) for s, v in want.items()}


def test_mix(spark, awkward, empty):
    rows = mixing.mix(awkward, key_col="key").collect()
    assert len(rows) == len(AWKWARD)
    taken, size, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        source = AWKWARD[r.key][3]
        assert r.size == len((AWKWARD[r.key][1] or "").replace("\x0b", " ").split()) or r.doc_id == 9
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
        size[source] += r.size
        target[source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target) and sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), abs=4)
    again = mixing.mix(awkward.repartition(3), key_col="key").collect()
    assert {(r.key, r.taken) for r in rows if r.doc_id != 3} == {(r.key, r.taken) for r in again if r.doc_id != 3}
    assert collections.Counter((r.doc_id, r.size, r.taken) for r in rows) == collections.Counter((r.doc_id, r.size, r.taken) for r in again)  # repeated rows too
    out = mixing.mixed(awkward)
    words = out.select(F.sum(mixing.words(F.col("text")))).first()[0]
    assert out.columns == awkward.columns and words == sum(taken.values())
    assert out.where(F.col("n_chars") != F.length("text")).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_heavier_documents_come_first(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "good words here").otherwise("%%% ### 123").alias("text"), F.lit("s").alias("source"))
    rows = mixing.mix(df, share=0.5, most=1.0).where("taken > 0").select((F.col("doc_id") % 2).alias("odd")).collect()
    odd = sum(r.odd for r in rows) / len(rows)
    assert len(rows) == 2000 and odd < 0.35


# ---- chat


def test_chat(spark):
    texts = [None, "", "plain", "\\", "###", "####", "#####", "</turn>", "<\\/turn>", "\\n", "a\n### Assistant: </turn>\n", "\\### Assistant: </turn> ok", "日本 🙂", "</turn></turn>\n### user\n"]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(texts)]
    rows += [(2, 1, "assistant", "late"), (2, 0, "user", "early"), (2, 0, "system", "tie"), (3, None, None, None), (None, 5, "odd\nrole</turn>##\\", "x"), (4, 0, "user", "same"), (4, 0, "user", "same"), (5, 0, "assistant", "y" * 100_000)]
    rows += [(6, 0, "start", "a role of that name"), (6, 1, "user", "x"), (7, 0, "r##\n\\" * 20_000, "a long role"), (8, 0, "x" * 100_000, "z" * 3_000_000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    read = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.segments(df))).collect()}
    by = collections.defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[c].append((role or "", text or ""))
    assert {c: [tuple(t) for t in r.turns] for c, r in read.items()} == by
    assert all(r.loss_text == "".join(t for role, t in by[c] if role == "assistant") for c, r in read.items())
    assert {c: r.valid for c, r in read.items()} == {1: True, 2: True, 3: False, None: False, 4: False, 5: False, 6: False, 7: False, 8: False}
    got = {r.conv_id: r for r in chat.digests(chat.read_back(chat.formatted(chat.segments(df)))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in by[1]).encode()).hexdigest()
    assert chat.digests(chat.read_back(chat.formatted(chat.segments(df.where("false"))))).count() == 0


def test_chat_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.read_back(chat.formatted(chat.segments(df))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- toxicity


def test_toxicity_learns_and_restores(spark, awkward, empty):
    rng = random.Random(5)
    common = [f"{a}{b}{c}" for a in ("lo", "ma", "ti", "pe", "gu", "fre", "ni") for b in ("ran", "sol", "tem", "bud", "kip", "wo") for c in ("a", "o", "es", "in", "ula", "ero")]
    bad = ["scoundrel", "rascal", "villain"]
    disguised = {"scoundrel": ["sc0undr3l", "s c o u n d r e l", "scouuuundrel", "s.c.o.u.n.d.r.e.l"], "rascal": ["r@sc4l", "r a s c a l"], "villain": ["v1lla1n", "v-i-l-l-a-i-n"]}
    docs, labels = [], []
    for k in range(600):
        toxic, words = k % 4 == 0, [rng.choice(common) for _ in range(40)]
        if toxic:
            words.insert(rng.randrange(40), rng.choice(bad))
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    hidden = [(1000 + k, " ".join([*[rng.choice(common) for _ in range(20)], d])) for k, d in enumerate(itertools.chain.from_iterable(disguised.values()))]
    clean = [(2000 + k, " ".join([*[rng.choice(common) for _ in range(20)], x])) for k, x in enumerate(["10.0.0.1", "a b c d e", "room 101!", "user@example.com", "aaaa"])]
    df = spark.createDataFrame(docs + hidden + clean, "doc_id long, text string")
    rows = {r.doc_id: r for r in toxicity.scored(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(rows[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in rows)
    assert np.mean([rows[k].predicted == t for k, t in labels if rows[k].held_out]) == 1.0
    assert [rows[k].predicted for k, _ in hidden] == [1] * len(hidden)
    assert [rows[k].predicted for k, _ in clean] == [0] * len(clean)
    assert all(0 <= r.score <= 1 for r in rows.values())
    flipped = [(k, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, t in labels]
    again = toxicity.scored(df, spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()
    assert {r.doc_id: r.score for r in again} == {k: r.score for k, r in rows.items()}  # held-out labels do not matter
    kept = toxicity.keep_clean(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == df.columns and kept.count() == sum(1 - r.predicted for r in rows.values())



def test_quick_search_is_the_plain_search():
    signs = toxicity._SIGNS
    plain = re.compile(rf"[^\s]*(?:[^\W\d_][\d{signs}.\-*~_]+[^\W\d_]|(?<!\S)[\d@$!][^\W\d_]{{2}}|([^\W\d_])\1\1)[^\s]*")

    class Seen:
        def decode(self, x):
            return x

    rng = random.Random(14)
    texts = ["s  t u p i d", "s. t. u. p. i. d", "s  t  u  p  i  d", "stu.pid", "id-iot", "st-u-pid", "mo.ro.n", "so ééét", "a\rb0b\x0bc"]
    texts += ["".join(rng.choice("aabééc  ..--_*~01@$!\n\r\t'") for _ in range(rng.randint(1, 40))) for _ in range(5000)]
    for t in texts:
        want = {m.group() for p in (plain, toxicity._SPACED, toxicity._DOTTED) for m in p.finditer(t)}
        assert want <= set(toxicity.restored(t, Seen())), t
    assert all(toxicity.restored(t, Seen()) for t in texts[:9])


def test_decoder_against_all_paths():
    rng = random.Random(14)
    counts = np.zeros(1 << 20, np.int64)
    toxicity.count_4grams(["you are a stupid idiot, go to hell", "hello all, a nice little book about trees"] * 5, counts)
    decoder = toxicity.Decoder(counts)

    def cost(emitted):
        state, value = 0, 0.0
        for c in emitted:
            code = state << 5 | toxicity._class(c)
            value, state = value + float(decoder.cost[code]), code & 0x7FFF
        return value

    for seen in ["1d10t", "s t u p 1 d", "heeeelll", "5tup!d", "a+(b", *("".join(rng.choice("aeilost10!.- +(6") for _ in range(rng.randint(1, 8))) for _ in range(60))]:
        paths = itertools.product(*decoder.lattice(seen))
        want = min((sum(c for _, c in p) + cost("".join(e for e, _ in p) + " ")) for p in paths)
        value, text = decoder.best(seen)
        assert value == pytest.approx(want, abs=1e-3)
        assert want == pytest.approx(min(sum(c for _, c in p) + cost(text) for p in itertools.product(*decoder.lattice(seen)) if "".join(e for e, _ in p) + " " == text), abs=1e-3)
    long = "5tup1d" * 2_000  # no cut, no limit
    assert decoder.best(long)[1].strip().count("stupid") == 2_000


def test_toxicity_awkward(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score < 0.5 for r in toxicity.scored(awkward, none).collect()} == {True}
    labels = spark.createDataFrame([(k, t) for k in (1, 2, 3, 5, 6) for t in (0, None)] + [(8, 1), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.scored(awkward, labels).collect()
    assert len(rows) == len(AWKWARD) and all(r.score is not None for r in rows)
    assert toxicity.keep_clean(awkward, labels).columns == awkward.columns
    assert toxicity.scored(empty, labels).count() == 0


# ---- search


def brute_top(rows, k):
    usable = [(i, [int(np.floor(1024.0 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, a in usable:
        if q % 100 == 0 and q not in out:
            scores = sorted(((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in usable if i != q))  # noqa: B905
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("bound", [32 << 20, 400])
def test_top_k(spark, bound):
    rng = random.Random(6)
    rows = [(i, [rng.choice((0.0, 0.5, -0.25, rng.uniform(-1, 1))) for _ in range(6)]) for i in range(0, 1300, 3)]
    rows += [(7, None), (8, [1.0, None]), (100, [float("nan")] * 6), (11, [float("inf")]), (None, [1.0] * 6), (13, []), (14, [1.0] * 9), (rows[5][0], rows[5][1])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0, candidate_block_bytes=bound, score_bytes=bound, block=50).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got == brute_top(rows, 10)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_of_few_and_of_huge(spark):
    df = spark.createDataFrame([(0, [3e38, 1.0]), (1, [3e38, 1.0]), (2, [-3e38, 0.0])], "vec_id long, embedding array<float>")
    rows = topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in rows] == [(1, 2**63 - 1), (2, -(2**63))]


def test_top_k_of_many_queries_in_little_memory():
    """30,000 queries against 20,000 candidates: a task's arrays stay under 300 MB."""
    rng = np.random.default_rng(12)
    schema = pa.schema([("cell", pa.int32()), ("asking", pa.int32()), ("vec_id", pa.int64()), ("vector", pa.list_(pa.float32()))])

    def batches():
        for asking, n in ((0, 20_000), (1, 30_000)):
            for at in range(0, n, 10_000):
                vectors = pa.FixedSizeListArray.from_arrays(pa.array(rng.normal(size=10_000 * 8).astype(np.float32)), 8).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(10_000), pa.int32()), pa.array(np.full(10_000, asking), pa.int32()), pa.array(np.arange(at, at + 10_000)), vectors], schema=schema)

    tracemalloc.start()
    found = sum(b.num_rows for b in topk._search(10, 1024.0, 4096, 16 << 20)(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 300_000 and peak < 300 << 20


# ---- all of them


def test_sql_twins(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        found = queries.queries()[name](spark, sf_dir)
        want = con.execute(sql).fetchall()
        columns = [c[0] for c in con.description]
        assert sorted(columns) == sorted(found.columns)
        assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, want)), name


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_pipeline(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert whole_pieces(pieces)


def whole_pieces(pieces):
    """Each document's ids in one piece each, sequences without gaps; the pieces."""
    docs, sequences = collections.defaultdict(list), collections.defaultdict(list)
    rows = pieces.collect()
    for r in rows:
        docs[r.doc_id].append((r.start, r.length, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    for spans in docs.values():  # a document that is taken twice is there twice
        assert sum(n for _, n, _ in spans) == sum(total for start, _, total in spans if start == 0)
    return rows


def test_pipeline_is_its_stages(spark, sf_dir, tmp_path):
    """run() gives what the stages give one by one, each written and read again."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in corpus_pipeline.STAGES:
        function(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    key = lambda df: sorted((r.doc_id or 0, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(docs) != []


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 1), (9, 0, None)], "doc_id long, quality int, toxic int")
    for name, docs in (("awkward", awkward), ("empty", awkward.where("false"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = whole_pieces(corpus_pipeline.run(spark, f"{tmp_path}/{name}"))
        if name == "empty":
            assert rows == []
        else:  # of the equal texts 1, 2 and 3 the longest or first, of the near ones one; texts without words go
            ids = {r.doc_id for r in rows}
            assert ids & {1, 2, 3} and len({1, 2, 3} & ids) <= 2 and {8, 9, 10, -4, None} <= ids and not {5, 6, 7} & ids
