"""Exact, near, substring and passage dedup against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from awkward_cases import AWKWARD

from tideline.llm import chain_dedup, exact_dedup, simhash, suffix_dedup


SPACE = re.compile(r"[\x20\x09-\x0D]")


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[SPACE.sub("", t or "")].append((-len(t or ""), 2**63 if i is None else i, k))
    out = {}
    for s, members in groups.items():
        best = min(members)
        for _, _, k in members:
            out[k] = (rows[best[2]][0], len(members), k == best[2], hashlib.sha256(s.encode()).hexdigest())
    return out


@pytest.mark.parametrize("limits", [(48 << 20, 64 << 20), (500, 1500)])
def test_exact(spark, awkward, limits):
    """With tiny limits every chunk is cut and every bucket spills."""
    rng = random.Random(1)
    rows = [(r[0], r[1]) for r in AWKWARD] + [(100 + k, rng.choice(["a b", "ab", "a  b", "c", "d" * 400, "e" * 300 + str(rng.randint(0, 9))])) for k in range(300)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k long").repartition(5)
    found = exact_dedup.exact_groups(df, key_col="k", chunk_bytes=limits[0], memory_bytes=limits[1]).collect()
    want = brute_exact(rows)
    assert len(found) == len(rows)
    for r in found:
        keep, size, kept, sha = want[r.key]
        assert (r.keep_id, r.group_size, r.text_sha256) == (keep, size, sha)
    for members in collections.Counter(r.text_sha256 for r in found if r.kept).values():
        assert members == 1  # of full ties one row stays


def test_exact_keeps_columns(awkward, empty):
    out = exact_dedup.exact_dedup(awkward)
    assert out.columns == awkward.columns and out.count() == len({SPACE.sub("", r[1] or "") for r in AWKWARD})
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.exact_groups(empty).count() == 0


def test_grace_spills_and_cleans(tmp_path):
    records = [exact_dedup.Record(hashlib.sha256(c).digest(), c, (len(c), k, k), 1, [k]) for k, c in enumerate([b"x%d" % (j % 700) * 50 for j in range(2000)])]
    merged = list(exact_dedup.grace(iter(records), 20_000, str(tmp_path)))
    assert sorted(m.content for m in merged) == sorted({r.content for r in records})
    assert sum(m.rows for m in merged) == 2000 and not list(tmp_path.iterdir())


# ---- SimHash


def brute_fingerprint(text, n=3):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    s = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, most):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= most:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(values))]


@pytest.mark.parametrize("hot", [20_000, 3])
def test_simhash(spark, awkward, hot):
    """Also with every bucket split as a hot one."""
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(40)) for _ in range(12)]
    rows = [(r[0], r[1]) for r in AWKWARD]
    for k in range(120):
        w = rng.choice(base).split()
        if rng.random() < 0.7:
            w[rng.randrange(len(w))] = "Q%d" % rng.randint(0, 3)
        rows.append((200 + k, " ".join(w)))
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k long").repartition(3)
    found = {r.key: r for r in simhash.near_groups(df, shingle=3, most=3, hot_bucket=hot, key_col="k").collect()}
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps, 3)
    least = {}
    for k, r in enumerate(roots):
        ids = [i for i in (least.get(r), rows[k][0]) if i is not None]
        least[r] = min(ids, default=None)
    for k, r in enumerate(roots):
        assert (found[k].fingerprint, found[k].component_id) == (f"{fps[k]:016x}", least[r]), rows[k]


def test_gray_index():
    rng = np.random.default_rng(3)
    for n, buckets, width in ((600, 1, 1), (600, 150, 1), (300, 3, 4), (1, 1, 1)):
        base = rng.integers(0, 2**63, (20, width), np.uint64)
        codes = base[rng.integers(0, 20, n)]
        for _ in range(4):
            codes[np.arange(n), rng.integers(0, width, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        b = rng.integers(0, buckets, n)
        index = simhash.GrayIndex(codes, b)
        labels = index.links(3, chunk=200)
        whole = [int.from_bytes(c.tobytes(), "little") | (int(x) << 300) for c, x in zip(index.codes, index.buckets, strict=True)]
        want = brute_components([w ^ (w >> 300 << 300) | ((w >> 300) * ((1 << 40) - 1) << 300) for w in whole], 3)
        same = {}
        assert all(same.setdefault(x, y) == y for x, y in zip(labels.tolist(), want, strict=True)) and len(set(same.values())) == len(same)


def test_gray_rank_is_a_gray_order():
    codes = np.array([[k ^ k >> 1] for k in range(64)], np.uint64)
    assert simhash.gray_rank(codes)[:, 0].tolist() == list(range(64))
    two = np.array([[0, 2**64 - 1], [1, 2**63], [1, 0]], np.uint64)
    assert simhash.gray_rank(two)[:, 0].tolist() == [0, 1, 1]


def test_near_dedup(spark, awkward, empty):
    rng = random.Random(4)
    text = [str(rng.randint(0, 10**6)) for _ in range(200)]
    near = text[:90] + ["changed"] + text[91:]
    far = [str(rng.randint(0, 10**6)) for _ in range(200)]
    df = spark.createDataFrame([(3, " ".join(near)), (2, " ".join(text)), (9, " ".join(far)), (None, " ".join(far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.near_dedup(df).collect()) == [2, 9]
    out = simhash.near_dedup(awkward)
    assert out.columns == awkward.columns and 0 < out.count() < len(AWKWARD)
    assert simhash.near_dedup(empty).count() == 0 and simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("hot_bucket", [20_000, 30])
def test_similar_groups_against_brute_force(spark, hot_bucket):
    """Pairs around a similarity of 0.8, a family of near copies, and texts that a repeated line makes look alike."""
    rng = random.Random(5)
    words = lambda n: [str(rng.randint(0, 10**6)) for _ in range(n)]

    def changed(text, n):
        out = list(text)
        for at in rng.sample(range(len(out)), n):
            out[at] = str(rng.randint(0, 10**6))
        return out

    texts = []
    for _ in range(220):
        text = words(rng.randint(60, 300))
        texts += [text, changed(text, rng.randint(1, max(1, len(text) // 30)))]
    family = words(150)
    texts += [changed(family, rng.randint(1, 3)) for _ in range(60)]
    line = words(25)
    texts += [words(120) + line * 30 for _ in range(4)] + [[], []]
    texts = [" ".join(t) for t in texts]
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, k long").repartition(3)
    root = {r.key: r.root for r in simhash.similar_groups(df, key_col="k", hot_bucket=hot_bucket).collect()}
    assert sorted(root) == list(range(len(texts)))
    sets = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    assert len(links) > 300
    assert sum(root[a] == root[b] for a, b in links) >= 0.95 * len(links)
    group = list(range(len(texts)))  # groups by true links alone
    for a, b in links:
        group = [group[a] if g == group[b] else g for g in group]
    assert all(group[k] == group[r] for k, r in root.items())  # nothing else is linked
    assert [simhash.jaccard(texts[a].encode(), texts[b].encode(), 5) >= 0.8 for a, b in links] == [True] * len(links)


@pytest.mark.parametrize("hot_bucket", [20_000, 6])
def test_candidates_of_two_groups_are_whole(spark, hot_bucket):
    """60 codes of which all are far candidates: more than a cap of the nearest would leave, and in buckets that are dealt in parts."""
    rng = np.random.default_rng(13)
    base = rng.integers(0, 2, 256)
    bits = np.array([np.where(rng.random(256) < 0.08, 1 - base, base) for _ in range(60)])
    codes = [np.packbits(b).tobytes() for b in bits]
    places = simhash.bucket_bits(256, *simhash.table_plan(60, 0.8, 0.98))
    share = lambda i, j: (bits[i][places] == bits[j][places]).all(1).any()
    wanted = {(j, i) for i, j in itertools.combinations(range(60), 2) if (bits[i] != bits[j]).sum() <= 50 and i % 5 != j % 5 and share(i, j)}
    assert max(collections.Counter(a for a, _ in wanted).values()) > 20
    options = {"similarity": 0.8, "width": 4, "recall": 0.98, "hot_bucket": hot_bucket}
    nodes = spark.createDataFrame([(k, bytearray(c), k % 5) for k, c in enumerate(codes)], "node long, code binary, root long")
    assert {(r.a, r.b) for r in simhash.candidates(nodes, **options).collect()} == wanted
    first = simhash.candidates(nodes.drop("root"), **options).collect()
    assert {n for p in wanted for n in p} <= {n for r in first for n in r}  # none is left out unnoticed


def look_alikes(rng, families, size, words=100, changes=(2, 4)):
    """Texts of families, whose members differ from a base in a few words: some are similar, most only look alike."""
    new = lambda: str(rng.randint(0, 10**6))
    out = []
    for _ in range(families):
        base = [new() for _ in range(words)]
        for _ in range(size):
            text = list(base)
            for at in rng.sample(range(words), rng.randint(*changes)):
                text[at] = new()
            out.append(" ".join(text))
    return out


@pytest.mark.parametrize(("hold", "hot_bucket"), [(16 << 20, 20_000), (3_000, 20_000), (16 << 20, 12)])
def test_linked_roots_against_brute_force(spark, hold, hot_bucket):
    """All candidates of two roots are compared, also where a bucket is dealt in parts."""
    texts = look_alikes(random.Random(14), 3, 40, changes=(0, 4))
    roots = [k - k % 3 for k in range(len(texts))]
    rows = spark.createDataFrame(list(enumerate(texts)), "d long, text string").repartition(3)
    codes = [bytearray(simhash.wide_fingerprint(t.encode(), 5, 4, once=True).astype(">u8").tobytes()) for t in texts]
    nodes = spark.createDataFrame([(k, c, r) for k, (c, r) in enumerate(zip(codes, roots, strict=True))], "node long, code binary, root long")
    options = {"similarity": 0.8, "width": 4, "recall": 0.98, "hot_bucket": hot_bucket, "codes": len(texts)}
    pairs = [(r.a, r.b) for r in simhash.candidates(nodes, **options).collect()]
    links = {(roots[a], roots[b]) for a, b in pairs if simhash.jaccard(texts[a].encode(), texts[b].encode(), 5) >= 0.8}
    found = [(r.a, r.b) for r in simhash.linked_roots(nodes, rows, shingle=5, hold=hold, **options).collect()]
    assert links and len(pairs) > 2 * len(links)

    def groups(links):
        group = list(range(len(texts)))
        for a, b in links:
            group = [group[a] if g == group[b] else g for g in group]
        return {frozenset(k for k, h in enumerate(group) if h == g) for g in group}

    assert groups(found) == groups(links)


def test_look_alikes_make_no_row_a_pair(spark, monkeypatch):
    """Of texts that look alike and are not, no table has a number of rows that grows with the square of their number."""
    texts = look_alikes(random.Random(15), 1, 300, words=300, changes=(5, 5))
    rows, real = {}, simhash.written

    def counted(df, name, *codec):
        out = real(df, name, *codec)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "written", counted)
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, k long").repartition(3)
    root = {r.key: r.root for r in simhash.similar_groups(df, key_col="k").collect()}
    assert len(root) == 300 and len(set(root.values())) > 150
    assert max(rows.values()) < 300 * 299 / 2 / 4, rows


# ---- suffixes


def brute_repeats(texts, length):
    seen = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [100_000, 1])
def test_suffix_dedup(spark, hot):
    """Also with every anchor cut as a hot one."""
    rng = random.Random(6)
    noise = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    shared = [noise(n) for n in (80, 200, 150, 99, 100, 101)]
    texts = [b"", noise(99), noise(100), b"a" * 450, b"abcab" * 90, noise(3000)]
    for _ in range(60):
        t = noise(rng.randint(0, 60))
        for _ in range(rng.randint(1, 3)):
            t += rng.choice(shared) + noise(rng.choice((0, 5, 90)))
        texts.append(t)
    texts.append(texts[-1])
    df = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)] + [(999, None)], "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, length=100, hot_group=hot).collect()}
    for k, want in enumerate(brute_repeats(texts, 100)):
        r = found[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, k
    assert found[999].n_bytes == 0 and len(found) == len(texts) + 1


def test_suffix_awkward(awkward, empty):
    rows = suffix_dedup.remove_repeats(awkward, with_text=True).collect()
    assert len(rows) == len(AWKWARD) and suffix_dedup.remove_repeats(empty).count() == 0
    want = [(r[0], *w) for r, w in zip(AWKWARD, brute_repeats([(r[1] or "").encode() for r in AWKWARD], 200), strict=True)]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert next(r for r in rows if r.doc_id == 8).n_removed == 200_000  # repeats itself
    assert next(r for r in rows if r.doc_id == 9).kept.decode() == AWKWARD[10][1]


def test_deep_shallow():
    rng = random.Random(7)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.choice((0, 3, 8, 40, 90)))) for _ in range(300)]
    strings += [b"q" * 60 + s for s in strings[:80]] + strings[:20]
    groups = np.array([rng.randrange(4) for _ in strings])
    order, lcp = suffix_dedup.deep_shallow(strings, groups)
    pairs = [(groups[k], strings[k]) for k in order]
    assert pairs == sorted(pairs)
    for (g, a), (h, b), n in zip(pairs, pairs[1:], lcp[1:], strict=False):
        common = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert n == (common if g == h else -1)


# ---- passages


def test_passages(spark, empty, awkward):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passage, short = words(52), words(30)
    fuzzy = [w if k % 17 else "other" for k, w in enumerate(passage)]
    docs = {1: words(40) + passage + words(40), 2: passage + words(90), 3: words(200), 4: words(70) + fuzzy + words(5), 5: words(50) + short, 6: short + words(60), 7: passage + words(30) + passage}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string").repartition(3)
    found = chain_dedup.fuzzy_passages(df, min_words=45).collect()
    assert {r.doc_id for r in found} == {1, 2, 4, 7}
    for r in found:
        assert docs[r.doc_id][r.start : r.end] == docs[r.other_id][r.other_start : r.other_end] or r.similarity < 1
    one = next(r for r in found if r.doc_id == 1)
    assert (one.start, one.end) == (40, 92) or one.similarity < 1
    assert chain_dedup.fuzzy_passages(empty).count() == 0
    again = chain_dedup.fuzzy_passages(awkward)
    assert again.columns == ["doc_id", "other_id", "start", "end", "other_start", "other_end", "similarity"]
    pairs = {(r.doc_id, r.other_id) for r in again.collect()}
    assert {a for a, b in pairs if a != b} == {1, 2, 3} and {a for a, _ in pairs} == {1, 2, 3, 8}  # copies meet their representative
    assert (8, 8) in pairs  # a text that repeats itself


def chain_score(chain, k, gap_cost):
    score = float(k)
    for (x, y), (v, w) in itertools.pairwise(chain):
        step = min(v - x, w - y, k)
        score += step - gap_cost * ((v - x) + (w - y) - 2 * step)
    return score


def test_chains_against_brute_force():
    """The first chain is the best of all chains; matches lie at least k words apart, or not."""
    rng = random.Random(9)
    for case in range(300):
        n, k, gap = rng.randint(1, 8), 3, rng.choice((0.05, 0.25))
        spread = 3 if case % 2 else 1
        places = sorted({(spread * rng.randint(0, 9), spread * rng.randint(0, 9)) for _ in range(n)})
        every = [c for m in range(1, len(places) + 1) for c in itertools.combinations(places, m) if all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(c))]
        best = max(chain_score(c, k, gap) for c in every)
        tops = chain_dedup.chains([p[0] for p in places], [p[1] for p in places], k, gap, 0.0)
        ends = {(c[0][0], c[-1][0] + k, c[0][1], c[-1][1] + k): chain_score(c, k, gap) for c in sorted(every, key=lambda c: chain_score(c, k, gap))}
        assert tops and all(t in ends for t in tops)
        if spread == 3:
            assert ends[tops[0]] == pytest.approx(best)


def passages_by_force(a, b, words=50, share=0.8):
    """Whether some two stretches of so many words agree in that share of places."""
    for shift in range(words - len(b), len(a) - words + 1):
        i, j = max(shift, 0), max(-shift, 0)
        n = min(len(a) - i, len(b) - j)
        total = np.concatenate([[0], np.cumsum(a[i : i + n] == b[j : j + n])])
        if (total[words:] - total[:-words] >= share * words).any():
            return True
    return False


def noisy_corpus(seed):
    """Fuzzy passages, families of near copies, passages that others cover with shorter pieces, frequent lines."""
    rng = np.random.default_rng(seed)
    new = lambda n: rng.integers(100, 10**6, n)
    line, docs = new(12), []
    for _ in range(40):  # a passage and its fuzzy copy
        passage = new(rng.integers(50, 120))
        copy = np.where(rng.random(len(passage)) < rng.uniform(0, 0.15), new(len(passage)), passage)
        docs += [np.concatenate([new(rng.integers(0, 60)), p, new(rng.integers(0, 60))]) for p in (passage, copy)]
    for _ in range(3):  # a passage that others cover
        passage = new(200)
        pieces = [passage[at : at + 28] for at in range(0, 190, 17)]
        docs += [np.concatenate([p, new(50)]) for p in pieces] + [np.concatenate([new(30), passage]), np.concatenate([passage, new(20)])] + [np.concatenate([new(40), p]) for p in pieces]
    family = new(80)
    docs += [np.where(rng.random(80) < 0.06, new(80), family) for _ in range(30)]
    docs += [np.concatenate([new(30), line, new(30), line, new(5)]) for _ in range(30)]
    order = rng.permutation(len(docs))
    return [docs[k] for k in order]


@pytest.mark.parametrize("all_pairs", [8, None])
def test_passages_against_brute_force(spark, all_pairs):
    docs = noisy_corpus(3)
    rows = [(k, " ".join(map(str, d))) for k, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {(r.doc_id, r.other_id) for r in chain_dedup.fuzzy_passages(df, all_pairs=all_pairs, chunk_bytes=20_000).collect()}
    assert all((b, a) in found for a, b in found)
    wanted = {(a, b) for a in range(len(docs)) for b in range(len(docs)) if a != b and passages_by_force(docs[a], docs[b])}
    alone = set(range(len(docs))) - {a for a, _ in wanted}
    partners = {a: {b for c, b in found if c == a} for a, _ in found}
    linked = {(a, b) for a, b in wanted if (a, b) in found or (all_pairs and partners.get(a, set()) & partners.get(b, set()))}
    assert len(linked) >= 0.95 * len(wanted), (len(linked), len(wanted))
    large = {k for k, d in enumerate(docs) if sum(a == k for a, _ in wanted) > 20}  # the family of near copies
    small = {(a, b) for a, b in wanted if not large & {a, b}}
    assert len(small & found) >= 0.95 * len(small), (len(small & found), len(small))
    assert {a for a, _ in wanted} == {a for a, _ in found} - alone  # every document of a passage
    assert len({a for a, _ in found} & alone) <= 0.05 * len(alone)  # gaps and rounding make some more


def test_passages_of_near_copies_meet_directly(spark):
    """No link is left to a representative, whatever the size of a class; a text full of one seed stays linear in its repeats."""
    rng = np.random.default_rng(11)
    family = rng.integers(100, 10**6, 80)
    docs = [np.where(rng.random(80) < 0.04, rng.integers(100, 10**6, 80), family) for _ in range(25)]
    rows = [(k, " ".join(map(str, d))) for k, d in enumerate(docs)] + [(100, "la " * 3_000), (101, "la " * 2_900 + "end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {(r.doc_id, r.other_id) for r in chain_dedup.fuzzy_passages(df, chunk_bytes=4_000).collect()}
    wanted = {(a, b) for a in range(25) for b in range(25) if a != b and passages_by_force(docs[a], docs[b])}
    assert len(wanted) == 600 and wanted <= found
    assert {(100, 101), (101, 100)} <= found


def test_passages_in_many_documents_are_classes(spark):
    """A frequent line makes no pairs; what is the same in many documents is one class, and no link is lost."""
    rng = np.random.default_rng(13)
    new = lambda n: rng.integers(100, 10**6, n)
    passage, line = new(60), new(14)
    docs = [np.concatenate([new(25), passage, new(25)]) for _ in range(50)]
    docs += [np.concatenate([new(20), np.where(np.arange(60) % 20 == k, new(60), passage), new(20)]) for k in range(3)]
    docs += [np.concatenate([new(40), line, new(40)]) for _ in range(60)]
    around = new(30), new(30)  # two texts with the line have more in common
    docs += [np.concatenate([new(20), around[0], line, around[1]]), np.concatenate([around[0], line, around[1], new(30)])]
    rows = [(k, " ".join(map(str, d))) for k, d in enumerate(docs)]
    found = chain_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), direct=32, chunk_bytes=4_000).collect()
    groups = {}
    for r in found:
        if r.class_id is not None:
            assert rows[r.doc_id][1].split()[r.start : r.end] == rows[r.other_id][1].split()[r.other_start : r.other_end] and r.end - r.start >= 50
            groups.setdefault(r.class_id, set()).update((r.doc_id, r.other_id))
    assert any(g == set(range(50)) for g in groups.values())
    links = {(a, b) for g in groups.values() for a in g for b in g if a != b} | {(r.doc_id, r.other_id) for r in found}
    assert links == {(a, b) for a in range(len(docs)) for b in range(len(docs)) if a != b and passages_by_force(docs[a], docs[b])}
    assert len(found) < 1_000  # of 2,758 links
    plain = chain_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), chunk_bytes=4_000)
    assert {(r.doc_id, r.other_id) for r in plain.collect()} == links and "class_id" not in plain.columns


def test_pairs_within():
    rng = np.random.default_rng(12)
    sizes = rng.integers(1, 30, 40)
    begins = np.cumsum(sizes) - sizes
    for at_once in (1, 7, 50, 1 << 18):
        got = [p for i, j in chain_dedup.pairs_within(begins, sizes, at_once) for p in zip(i.tolist(), j.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == {(b + i, b + j) for b, n in zip(begins.tolist(), sizes.tolist(), strict=True) for i in range(n) for j in range(i)}


def test_common_words():
    rng = random.Random(10)
    for _ in range(50):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for v in a:
            last = 0
            for j, w in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if v == w else max(row[j], row[j - 1])
        assert chain_dedup.common_words(a, b) == row[-1]


def test_runs_of_words_that_repeat(spark):
    """Documents with a long run of one word make no pair a place of it, and no link is lost; some share just enough words."""
    rng = np.random.default_rng(14)
    new = lambda n: rng.integers(100, 10**6, n)
    docs = [np.concatenate([new(30), np.full(int(n), 7), new(30)]) for n in rng.integers(44, 120, 50)]
    same = new(42)  # and other words around them
    docs += [np.concatenate([new(30), same, new(30)]) for _ in range(40)]
    docs += [np.concatenate([new(30), np.full(20, 7), new(60)]) for _ in range(5)]
    rows = [(k, " ".join(map(str, d))) for k, d in enumerate(docs)]
    found = chain_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), direct=32, chunk_bytes=4_000).collect()
    groups = {}
    for r in found:
        a, b = docs[r.doc_id][r.start : r.end].tolist(), docs[r.other_id][r.other_start : r.other_end].tolist()
        assert min(len(a), len(b)) >= 50 and chain_dedup.common_words(a, b) / max(len(a), len(b)) >= r.similarity - 1e-6 >= 0.8 - 2e-6
        if r.class_id is not None:
            groups.setdefault(r.class_id, set()).update((r.doc_id, r.other_id))
    links = {(a, b) for g in groups.values() for a in g for b in g if a != b} | {(r.doc_id, r.other_id) for r in found if r.doc_id != r.other_id}
    assert links == {(a, b) for a in range(len(docs)) for b in range(len(docs)) if a != b and passages_by_force(docs[a], docs[b])}
    assert len(found) < 2_500  # of 4,010 links
