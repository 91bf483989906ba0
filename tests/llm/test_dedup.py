import hashlib
import random

import numpy as np
import pytest

from skylattice.llm import repeats, textops as T
from skylattice.llm.embedding_dedup import Forest, embedding_dedup
from skylattice.llm.minhash_dedup import log_likelihood, minhash_dedup, plausible, registers
from skylattice.llm.substring_dedup import substring_dedup
from skylattice.llm.suffix_dedup import suffix_dedup


def test_word_bounds_stop_at_documents():
    texts = [b"ab cd", b"", b"ef", b" g ", b""]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    starts, ends, bounds = T.word_bounds(data, offsets, T.NON_SPACE)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [b"ab", b"cd", b"ef", b"g"]
    assert bounds.tolist() == [0, 2, 2, 3, 4, 4]


@pytest.mark.parametrize("w", [1, 3, 8])
def test_anchors_are_leftmost_minima(w):
    r = np.random.default_rng(w)
    for x in (r.integers(0, 4, 200), r.integers(0, 1 << 30, 200), np.zeros(200)):
        x = x.astype(np.uint32)
        starts = np.flatnonzero(r.random(200 - w + 1) < 0.9)
        lo, hi, at = T.anchors(x, starts, w)
        got = {s: a for i, j, a in zip(lo.tolist(), hi.tolist(), at.tolist()) for s in range(i, j + 1)}
        assert got == {s: s + int(x[s : s + w].argmin()) for s in starts.tolist()}


def brute_words(rows, window=13):
    first, out = {}, {}
    split = sorted((i, (t or "").encode().split()) for i, t in rows)
    for i, w in split:
        for s in range(len(w) - window + 1):
            first.setdefault(b" ".join(w[s : s + window]), i)
    for i, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[b" ".join(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(a for a, g in zip(w, gone) if not g)).hexdigest())
    return out


def test_substring_dedup(odd, odd_texts, no_docs):
    got = {r[0]: tuple(r)[1:] for r in substring_dedup(odd).collect()}
    assert got == brute_words(odd_texts)
    assert substring_dedup(no_docs).collect() == []


def test_substring_dedup_random(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randrange(40)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x[0]: tuple(x)[1:] for x in substring_dedup(df, window=6, anchor=3).collect()}
    assert got == brute_words(rows, 6)


def test_substring_dedup_repeated_and_null_ids(spark, odd_texts):
    base = odd_texts[0][1]
    df = spark.createDataFrame([(5, base), (5, base), (None, base), (9, base)], "doc_id long, text string")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_removed"]) for r in substring_dedup(df).collect())
    assert got == [((False, 5), 0), ((False, 5), 0), ((False, 9), 120), ((True, 0), 120)]


def brute_bytes(rows, n):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if b[s : s + n] in seen:
                gone[s : s + n] = b"\1" * n
            seen.add(b[s : s + n])
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_rows_without_an_id_spread(spark, text_of):
    """5,000 rows without an id, and as many with one id, are dealt like others; each is judged by its text."""
    for doc in (None, 7):
        rows = [(doc, text_of(i, 6)) for i in range(5000)]
        sizes = [r["count"] for r in repeats.deal(spark.createDataFrame(rows, "doc_id long, text string"), 64).groupBy("grp").count().collect()]
        assert len(sizes) == 64 and max(sizes) < 3 * 5000 / 64
    passage = text_of(70, 20)
    rows = [(None, f"{text_of(100 + i, 10)} {passage}") for i in range(300)] + [(1, passage)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 301 and {(r["doc_id"], r["n_removed"]) for r in got} == {(1, 0), (None, 20)}


def test_suffix_dedup(odd, odd_texts, no_docs):
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup(odd).collect()}
    assert got == brute_bytes(odd_texts, 100)
    assert suffix_dedup(no_docs).collect() == []


@pytest.mark.parametrize("n,k", [(12, 5), (30, 30)])
def test_suffix_dedup_random(spark, n, k):
    r = random.Random(n)
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randrange(250)))) for i in range(60)] + [(99, "a" * 900), (100, "é" * 200)]
    got = {x[0]: tuple(x)[1:] for x in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), n, k).collect()}
    assert got == brute_bytes(rows, n)


@pytest.mark.parametrize("hot_blocks", [0, 3, 1000])
def test_suffix_dedup_hot_anchors(spark, hot_blocks):
    """A passage in most documents with other bytes around it, in many blocks: by strings, mixed, by buckets."""
    r = random.Random(3)
    some = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    passage = some(120)
    rows = [(i, some(r.randrange(80)) + (passage[r.randrange(8) :] if i % 4 else "") + some(r.randrange(80))) for i in range(70)] + [(i, "ab" * 300) for i in (80, 81)]
    got = {x[0]: tuple(x)[1:] for x in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 30, 12, block_bytes=400, hot_blocks=hot_blocks).collect()}
    assert got == brute_bytes(rows, 30)


def shingles(text):
    w = (text or "").encode()
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in w).split()
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_near(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            n = len(sets[i] & sets[j])
            if i < j and n and 100 * n >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_minhash_dedup(odd, odd_texts, no_docs):
    got = {r[0]: tuple(r)[1:] for r in minhash_dedup(odd).collect()}
    assert got == brute_near(odd_texts)
    assert minhash_dedup(no_docs).collect() == []


def test_repeated_rows_of_dedup(spark, odd, odd_texts):
    twice = odd.unionByName(odd.where("doc_id in (3, 4, 9, 16)"))
    want = {**brute_near(odd_texts)}
    for df, expected in ((minhash_dedup(twice), want), (substring_dedup(twice), brute_words(odd_texts))):
        rows = sorted(map(tuple, df.collect()))
        assert rows == sorted((i, *expected[i]) for i in [*range(18), 3, 4, 9, 16])


def test_minhash_dedup_chains_and_clusters(spark):
    """Near copies of one text with edits of all sizes: links exist that pass by the least document."""
    r = random.Random(11)
    base = [f"w{r.randrange(500)}" for _ in range(90)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randrange(6)):
            del w[r.randrange(len(w))]
        rows.append((i, " ".join(w)))
    got = {x[0]: tuple(x)[1:] for x in minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows)


def test_registers_estimate_similarity():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 63, 4000).astype(np.uint64)
    b = np.concatenate([a[:3000], r.integers(0, 1 << 63, 1000).astype(np.uint64)])
    x, y = registers(a, 1024), registers(b, 1024)
    half = np.maximum(registers(a[:2000], 1024), registers(a[2000:], 1024))
    assert (half == x).all()  # sketches of parts merge
    grid = np.linspace(0, 1, 201)
    fit = log_likelihood((x > y).sum(), (x < y).sum(), (x == y).sum(), 0.5, 0.5, grid)
    assert abs(grid[fit.argmax()] - 3000 / 5000) < 0.06
    n = np.array([4000])
    assert not plausible(x[None], registers(r.integers(0, 1 << 63, 4000).astype(np.uint64), 1024)[None], n, n, 0.75)[0]
    assert plausible(x[None], registers(a[:3900], 1024)[None], n, np.array([3900]), 0.75)[0]


def brute_vectors(rows, threshold=0.93):
    good = {i: (label, np.array(v, float)) for i, v, label in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    n, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (la, a) in good.items():
        for j, (lb, b) in good.items():
            if i < j and la == lb and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                n[i] += 1
                n[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (n[i], find(i), find(i) == i) for i in n}


def test_embedding_dedup(spark):
    r = np.random.default_rng(3)
    centres, rows = r.standard_normal((30, 16)), []
    for i in range(900):
        v = centres[i % 30] + r.standard_normal(16) * r.choice([0.05, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3 == 0)))
    rows += [(1000 + i, rows[5][1], 0) for i in range(40)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0, None] * 8, 1), (2004, rows[0][1], None), (2005, [1.0] * 4, 1), (2006, [1.0] * 4, 1), (2007, [], 1), (2008, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "vec_id long, embedding array<float>, label int, leaf string, k int")
    got = {x[0]: tuple(x)[1:] for x in embedding_dedup(df, leaf=32).collect()}
    assert got == brute_vectors(rows)
    assert embedding_dedup(df.limit(0)).collect() == []


def test_minhash_dedup_repeated_and_null_ids(spark):
    """Rows of one id are judged each by its text; rows without an id link like all others."""
    r = random.Random(21)
    a, b, c = ([f"{x}{r.randrange(900)}" for _ in range(60)] for x in "abc")
    near = lambda w: " ".join([*w[:30], "other", *w[31:]])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (8, near(b)), (3, near(a)), (None, " ".join(c)), (None, near(c)), (None, "alone it stands"), (9, " ".join(c)), (9, " ".join(c)), (None, None), (7, " ".join(a).upper())]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    least = {x: min((i for (i, _), y in zip(rows, root) if y == x and i is not None), default=None) for x in root}
    want = sorted(repr((i, len(s), least[x], i == least[x])) for (i, _), s, x in zip(rows, sets, root))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash_dedup(df, leaders=True).collect()
    assert sorted(repr((x["doc_id"], x["n_shingles"], x["component_id"], x["kept"])) for x in got) == want
    kept = {(x["doc_id"], x["th"]) for x in got if x["leader"]}
    assert len(kept) == len(set(root))  # one text of each component


def test_embedding_dedup_repeated_and_null_ids(spark):
    e = lambda *on: [1.0 if i in on else 0.0 for i in range(8)]
    near = lambda i: [1.0 if j == i else 0.1 for j in range(8)]
    rows = [(5, e(0)), (5, e(1)), (6, near(0)), (7, near(1)), (None, e(2)), (None, near(2)), (None, e(3)), (4, near(3)), (9, e(5)), (9, e(5)), (None, e(6))]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    linked = m @ m.T >= 0.93
    least = [min((rows[j][0] for j in np.flatnonzero(x) if rows[j][0] is not None), default=None) for x in linked]
    want = sorted(repr((i, int(x.sum()) - 1, c, i == c)) for (i, _), x, c in zip(rows, linked, least))
    assert sorted(repr((x["vec_id"], x["n_links"], x["component_id"], x["kept"])) for x in embedding_dedup(df).collect()) == want


@pytest.mark.parametrize("depth", [5, 10])
def test_forest_finds_links_at_depth(depth):
    """Share of linked pairs at the threshold that meet in a leaf, against brute force."""
    r = np.random.default_rng(depth)
    n = 64 << depth if depth < 6 else 20_000
    v = r.standard_normal((n, 32))
    twins = v[:500] + r.standard_normal((500, 32)) * 0.3
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = unit(v[:500]), unit(twins)
    pairs = np.flatnonzero((a * b).sum(1) >= 0.93)
    forest = Forest(unit(v), 5, depth, 0.8 * np.sqrt(2 * 0.07 / 32), 7)
    of = lambda x: [set(leaf[lo:hi]) for row, leaf in [forest.leaves(x)] for lo, hi in zip(*(np.searchsorted(row, np.arange(len(x)), s) for s in ("left", "right")))]
    met = [bool(x & y) for x, y in zip(of(a[pairs]), of(b[pairs]))]
    assert len(pairs) > 50 and np.mean(met) >= 0.999


def test_embedding_dedup_at_depth(spark):
    """The whole operator with trees of several levels, on planted twins of one label: every row equals brute force."""
    r = np.random.default_rng(11)
    v = r.standard_normal((4000, 24)).astype(np.float32)
    v[2000:3500] = v[:1500] + (r.standard_normal((1500, 24)) * 0.25).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    assert near.sum() > 1000
    least, before = np.arange(len(v)), None
    while before is None or (before != least).any():
        before = least.copy()
        for i, j in zip(*np.nonzero(near), strict=True):
            least[i] = min(least[i], least[j])
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in embedding_dedup(df, leaf=64, per_leaf=16).collect()}
    assert got == {i: (int(near[i].sum()), int(least[i])) for i in range(len(v))}
