import hashlib
import inspect
import itertools
import math
import pickle
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skylattice.llm import language_id as li, lexical_packing as packing, lm_scoring as lm, warc_fixity as wf
from skylattice.llm.decontamination import decontaminate
from skylattice.llm.language_id import language_id
from skylattice.llm.lexical_packing import Encoder, lexical_packing
from skylattice.llm.license_scan import TEMPLATES, license_scan

SF = "/root/testdata/sf0.001"


def test_forward_sums_all_segmentations():
    pieces = sorted([b" ", b"a", b"b", b"c", b" a", b"ab", b"bc", b"abc", b" ab"])
    p = np.random.default_rng(0).dirichlet(np.ones(len(pieces)), 2).T
    finder, word = li.Pieces(pieces), b"abcab"

    def brute(text, lang):
        if not text:
            return 1.0
        return sum(p[i, lang] * brute(text[len(x) :], lang) for i, x in enumerate(pieces) if text.startswith(x))

    got = li.word_scores(finder, np.log(p), np.frombuffer(word, np.uint8), np.array([0]), np.array([5]))
    assert np.allclose(got[0], [math.log(brute(b" " + word, k)) for k in (0, 1)])


def test_fit_raises_the_likelihood():
    words, counts = [b"abab", b"ab", b"ba", b"ccc"], np.array([5.0, 9, 1, 2])
    pieces = sorted([b" ", b"a", b"b", b"c", b"ab", b" ab"])
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    starts, scores = ends - [len(w) for w in words], []
    for rounds in (0, 1, 2, 5):
        p = np.log(li.fit(words, counts, li.Pieces(pieces), len(pieces), rounds))[:, None]
        scores.append(float(counts @ li.word_scores(li.Pieces(pieces), p, data, starts, ends)[:, 0]))
    assert scores == sorted(scores)


def test_language_id_equals_a_run_by_run_sum(spark, odd, odd_texts):
    """Predictions and scores of the query's operator against sums over prefixes with the model it learns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 5 < 2").select("doc_id", "text", "lang")
    both = docs.unionByName(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    langs, table, pieces = li.learn(both.withColumn("held_out", held), public_tokenizers.path("byte_bpe_50k.tiktoken"), 400, 4)
    number = {p: i for i, p in enumerate(li.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")))}
    known = {}

    def run_score(run):
        if run not in known:
            w, sums = b" " + run, [np.zeros(len(langs))]
            for e in range(1, len(w) + 1):
                sums.append(np.logaddexp.reduce([sums[k] + table[number[w[k:e]]] for k in range(max(0, e - pieces.value.longest), e) if w[k:e] in number]))
            known[run] = sums[-1]
        return known[run]

    got = {r["doc_id"]: r for r in language_id(both).collect()}
    for doc_id, text in [(r["doc_id"], r["text"]) for r in docs.limit(25).collect()] + [(i + 10**6, t) for i, t in odd_texts if i != 16]:
        lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        runs = re.findall(rb"[a-z\x80-\xff]+", lower.encode())
        if not any(x.isalpha() for x in text or ""):
            assert (got[doc_id]["lang_pred"], got[doc_id]["score"]) == ("und", 0)
            continue
        total = sum(run_score(x) for x in runs)
        best = int(total.argmax())
        assert got[doc_id]["lang_pred"] == langs[best]
        assert math.isclose(got[doc_id]["score"], 1 / np.exp(total - total[best]).sum(), rel_tol=1e-5)


def test_scores_of_long_and_rare_runs():
    """Runs of any length and bytes, in words of mixed lengths, against a sum over prefixes."""
    names = li.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert max(map(len, names)) > 12
    pieces, r = li.Pieces(names), np.random.default_rng(3)
    log_prob = np.log(r.dirichlet(np.full(len(names), 0.02), 2).T + 1e-12)
    texts = ["日本語の文章です" * 3, "x" * 5000, "representatives" * 20, "é", "internationalisation", "q" * 64]
    words = [t.encode() for t in texts]
    ends = np.cumsum([len(w) for w in words])
    got = li.word_scores(pieces, log_prob, np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    again = li.word_scores(pickle.loads(pickle.dumps(pieces)), log_prob, np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert np.array_equal(got, again)
    number = {p: i for i, p in enumerate(names)}
    for w, g in zip(words, got):
        w, sums = b" " + w, [np.zeros(2)]
        for e in range(1, len(w) + 1):
            sums.append(np.logaddexp.reduce([sums[k] + log_prob[number[w[k:e]]] for k in range(max(0, e - pieces.longest), e) if w[k:e] in number]))
        assert np.allclose(g, sums[-1]) and np.isfinite(g).all()


def test_language_id_held_out_and_odd_rows(spark, odd, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id(docs).join(docs, "doc_id").where("held_out and length(text) > 20 and lang is not null")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 20 and right / n >= 0.95
    marks = language_id(docs).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in marks)
    assert all(0 <= r["score"] <= 1 for r in marks)
    rows = {r["doc_id"]: r for r in language_id(odd).collect()}
    assert len(rows) == 18 and {i for i, r in rows.items() if r["lang_pred"] == "und"} == {3, 4, 5, 6}
    extra = spark.createDataFrame([(1, "été", None), (2, "— € 12", None), (3, "日本", None)], "doc_id long, text string, lang string")
    alone = {r["doc_id"]: r["lang_pred"] for r in language_id(extra).collect()}
    assert set(alone.values()) == {"und"}  # nothing to learn from
    both = docs.select("doc_id", "text", "lang").unionByName(extra.withColumn("doc_id", F.col("doc_id") + 100000))
    named = {r["doc_id"]: r["lang_pred"] for r in language_id(both).where("doc_id > 100000").collect()}
    assert named[100002] == "und" and named[100001] != "und" and named[100003] != "und"
    assert language_id(no_docs).collect() == []


ODD = ["", " ", "  ", "a  b", "a   b c", " x", "x ", "\n\n a", "a\n b", "a \n b", "<|endoftext|> x <|endoftext|>", "don't stop 123 4.5%%% $$$", "x\x1c y", "日本 語", " " * 9 + "z", " " * 9, "a  b", "a  b"]


def test_encoder_equals_whole_text_encoding():
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(2):
        ids, offsets = encoder.encode(ODD)
        for i, e in enumerate(encoder.tokenizer.encode_batch(ODD, add_special_tokens=False)):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == [*e.ids, 1]


def test_packing_round_trip(spark, odd, odd_texts, no_docs):
    docs = odd.unionByName(odd.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    rows = lexical_packing(docs, window=256).collect()
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {i: t or "" for i, t in odd_texts} | {None: "one two three"}
    for doc, text in texts.items():
        ids = np.append(encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1).astype("<u4")
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for _, g in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in g:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert lexical_packing(no_docs).collect() == []


def test_neighbours_share_a_window(spark):
    r = np.random.default_rng(1)
    topics = [[f"{c}{i}" for i in range(40)] for c in ("red", "blue", "green", "gold")]
    rows = [(i, " ".join(r.choice(topics[i % 4], 60))) for i in range(80)]
    got = lexical_packing(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), window=512).collect()
    same = total = 0
    for _, g in itertools.groupby(sorted(got, key=lambda x: (x["sequence_id"], x["offset"])), key=lambda x: x["sequence_id"]):
        g = list(g)
        same += sum(a["doc_id"] % 4 == b["doc_id"] % 4 for a, b in zip(g, g[1:]))
        total += len(g) - 1
    assert same / total > 0.6


def test_neighbours_of_other_splits_share_a_window(spark):
    r = np.random.default_rng(4)
    words = [["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(25)] for _ in range(60)]
    # each topic's documents stand in four splits, which in turn hold all topics
    docs = spark.createDataFrame([(60 * i + t, " ".join(r.choice(words[t], 60))) for i in range(4) for t in range(60)], "doc_id long, text string").repartitionByRange(4, "doc_id")
    for size in (4 << 20, 1 << 14):  # one shard and several
        got = lexical_packing(docs, window=1024, shard_bytes=size).collect()
        assert len({x["doc_id"] for x in got}) == 240
        pairs = [(a, b) for a, b in itertools.pairwise(sorted(got, key=lambda x: (x["sequence_id"], x["offset"]))) if a["sequence_id"] == b["sequence_id"]]
        assert sum(a["doc_id"] % 60 == b["doc_id"] % 60 for a, b in pairs) / len(pairs) > 0.5


def test_packing_equals_a_plain_greedy_fill():
    """Pieces of a shard against BM25 by its definition, document by document and term by term."""
    r = np.random.default_rng(12)
    docs = [[*(int(x) + 2 for x in r.zipf(1.4, r.integers(0, 60)) % 50), 1] for _ in range(40)] + [[1], [7] * 150 + [1]]
    ids, offsets = np.array(sum(docs, []), "<u2"), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    n, df = len(docs), np.bincount([t for d in docs for t in set(d)], minlength=60).astype(float)
    corpus, mean = packing.Corpus(n, len(ids) / n, df), len(ids) / n

    def bm25(query, doc):
        out = 0.0
        for t in set(query) - {1}:
            f = doc.count(t)
            out += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(doc) / mean)) if f else 0
        return out

    window, unused, want, sequence, filled = 64, list(range(n)), [], 0, 0

    def place(d, start):
        nonlocal sequence, filled
        size = min(len(docs[d]) - start, window - filled)
        want.append((d, start, size, sequence, filled))
        filled += size
        if filled == window:
            sequence, filled = sequence + 1, 0
        return start + size

    while unused:
        seed, at = unused.pop(0), 0
        while True:
            while at < len(docs[seed]):
                at = place(seed, at)
            near = sorted((d for d in unused if bm25(docs[seed], docs[d]) > 0), key=lambda d: (-np.float32(bm25(docs[seed], docs[d])), d))
            if not filled or not near:
                break
            carried = None
            for d in near:
                unused.remove(d)
                at = place(d, 0)
                if at < len(docs[d]):
                    carried = d
                if not filled or carried is not None:
                    break
            if carried is None:
                break
            seed = carried
    assert list(packing.pack(ids, offsets, window, corpus)) == want


def test_windows_go_on_past_64_neighbours():
    ids, offsets = np.ones(201, np.uint32), np.arange(202)
    corpus = packing.Corpus(201, 1.0, np.array([0.0, 201.0]))
    got = list(packing.pack(ids, offsets, 150, corpus))
    assert [p[3] for p in got] == [0] * 150 + [1] * 51
    score = np.array([float(i * 7919 % 201) for i in range(201)])
    assert list(packing.falling(score, score != 5)) == [i for i in np.argsort(-score, kind="stable").tolist() if score[i] != 5]


def test_license_scan(spark, odd, no_docs):
    texts = ["Released under the MIT License.", "MIT license mit LICENSE apache license", "licensed under\tthe Apache License, version 2", "general public\nlicense", "mit licenses", None, "", "Licensed under CC BY-NC 4.0", "été MIT License ÉTÉ", "license " * 3000 + "mit license", "under the license of the mit"]
    df = spark.createDataFrame([(i, t, "c", 2) for i, t in enumerate(texts)], "doc_id long, text string, words string, th int")
    got = {r["doc_id"]: r for r in license_scan(df).collect()}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["base_labels"], got[0]["labels"], got[0]["score"]) == (1, 3, "mit", "mit", 1.0)
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 0, 4, "apache,mit")
    assert got[2]["labels"] == "apache" and got[3]["base_labels"] == "gpl"
    assert got[4]["n_base"] == 0 and got[4]["first_word"] is None and got[4]["labels"] == ""
    assert got[5]["n_words"] == 0 and got[5]["score"] == 0 and got[6]["labels"] == ""
    assert got[7]["base_labels"] == "" and got[7]["labels"] == "cc-by-nc" and got[7]["score"] == 1.0
    assert got[8]["n_words"] == 4 and got[8]["n_base"] == 1
    assert (got[9]["n_words"], got[9]["last_word"]) == (3002, 3000)
    assert got[10]["labels"] == "" and got[10]["score"] == 0
    near = license_scan(df.where("doc_id = 10"), threshold=0.8).first()
    assert near["base_labels"] == "" and near["labels"] == "mit" and near["score"] == 0.8
    mit = next(t for label, t in TEMPLATES if label == "mit" and len(t) > 200)
    changed = [w for i, w in enumerate(mit.split()) if i % 40]  # a few words are gone
    full = spark.createDataFrame([(0, f"{'x ' * 777}{mit}{' y' * 99}"), (1, " ".join(changed).upper()), (2, " ".join(mit.split()[:80]))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan(full, templates=tuple(t for t in TEMPLATES if len(t[1]) > 200)).collect()}
    assert (got[0]["labels"], got[0]["score"]) == ("mit", 1.0) and got[1]["labels"] == "mit" and got[1]["score"] < 1 and got[2]["labels"] == ""
    assert license_scan(odd).count() == 18 and license_scan(no_docs).collect() == []
    assert license_scan(df.unionByName(df)).count() == 22


def test_decontamination(spark, odd, no_docs):
    item = " ".join(f"q{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item, 0), (2, item, 0), (3, "tiny phrase", 0), (4, None, 0), (5, "", 0), (6, "solo", 0), (None, item, 0)], "item_id long, text string, fp int")
    cut = " ".join(f"Q{i}" for i in range(3, 13))
    texts = [f"x {cut} y", " ".join(f"q{i}" for i in range(9)), f"a TINY phrase, solo b {item}", None, "", f"{cut} {cut}", "tiny-phrase"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, met int")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate(df, bench).collect()}
    assert got == {0: (12, 10, 2, True), 1: (9, 0, 0, False), 2: (35, 33, 4, True), 3: (0, 0, 0, False), 4: (0, 0, 0, False), 5: (20, 20, 2, True), 6: (2, 2, 1, True)}
    assert {r["n_hit"] for r in decontaminate(odd, bench.limit(0)).collect()} == {0}
    assert decontaminate(no_docs, bench).collect() == []


def test_every_shared_window_is_found(spark):
    r = np.random.default_rng(2)
    words = [f"v{i}" for i in range(12)]
    items = [" ".join(r.choice(words, 14)) for _ in range(20)]
    docs = [" ".join(r.choice(words, 25)) + " " + " ".join(items[i % 20].split()[i % 5 : i % 5 + 8 + i % 4]) for i in range(60)]
    got = decontaminate(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    windows = {tuple(t.split()[j : j + 10]) for t in items for j in range(5)}
    for g in got:
        w = docs[g["doc_id"]].split()
        hit = {p for s in range(len(w) - 9) if tuple(w[s : s + 10]) in windows for p in range(s, s + 10)}
        assert g["n_hit"] == len(hit)


def test_lm_gradient_and_learning():
    net = lm.Network.new(np.ones(lm.BUCKETS), 1)
    r = np.random.default_rng(0)
    word = r.integers(0, 6, 4000) * 1000
    context = np.stack([np.roll(word, 2), np.roll(word, 1), word, word], 1)  # the answer is in sight
    before = net.log_prob(context, word).mean()
    net.train(context, word, 0.1)
    assert net.log_prob(context, word).mean() > before + 1
    total = sum(np.exp(net.log_prob(np.repeat(context[:1], lm.BUCKETS, 0), np.arange(lm.BUCKETS))))
    assert abs(total - 1) < 1e-3


def lm_net(seed: int = 3) -> lm.Network:
    r = np.random.default_rng(seed)
    net = lm.Network.new(1e6 / np.arange(1, lm.BUCKETS + 1), seed)
    for a in net.arrays.values():
        a += (r.standard_normal(a.shape) * 0.1).astype(np.float32)
    return net


def lm_windows(n: int, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return (r.random((n, 2 * lm.SIDE)) ** 8 * (lm.BUCKETS + 1)).astype(int), (r.random(n) ** 8 * lm.BUCKETS).astype(int)


def test_lm_exponentials_of_a_minibatch_are_taken_at_once(monkeypatch):
    """Not class by class, which made training and scoring cost twice the CPU seconds."""
    net, (context, word), calls = lm_net(), lm_windows(3 * lm.BATCH), []
    assert len(set(net.target(word)[1])) > lm.CLASSES // 2
    exp = np.exp
    monkeypatch.setattr(lm.np, "exp", lambda *a, **k: calls.append(1) or exp(*a, **k))
    net.train(context, word, 0.1, lm.BATCH)
    assert len(calls) <= 3 * (lm.BATCH // lm.PART + 1)


def test_lm_train_equals_plain_adagrad():
    """Two minibatches, window by window in doubles."""
    net, (context, word) = lm_net(), lm_windows(60)
    p = {k: v.astype(float) for k, v in net.params.items()}
    past = {k: np.full_like(v, 1e-2) for k, v in p.items()}
    rank, word_class = net.target(word)
    for i in (0, 30):
        d, backs = {k: np.zeros_like(v) for k, v in p.items()}, []
        for c, k, own in zip(context[i : i + 30], rank[i : i + 30], word_class[i : i + 30]):
            x = np.concatenate([p["words"][j] for j in c])
            h = np.tanh(x @ p["mix"] + p["bias"])
            inside = slice(net.cut[own], net.cut[own + 1])
            g, e = np.exp(h @ p["out"] + p["out_bias"]), np.exp(p["within"][inside] @ h + p["within_bias"][inside])
            g, e = g / g.sum() / 30, e / e.sum() / 30
            g[own] -= 1 / 30
            e[k - inside.start] -= 1 / 30
            back = (p["out"] @ g + e @ p["within"][inside]) * (1 - h * h)
            for name, at, slope in (("out", ..., np.outer(h, g)), ("out_bias", ..., g), ("within", inside, np.outer(e, h)), ("within_bias", inside, e), ("mix", ..., np.outer(x, back)), ("bias", ..., back)):
                d[name][at] += slope
            backs.append((c, back))

        def step(k: str) -> None:
            past[k] += d[k] ** 2
            p[k] -= 0.1 * d[k] / np.sqrt(past[k])

        for k in ("out", "out_bias", "within", "within_bias", "mix", "bias"):
            step(k)
        for c, back in backs:  # words are moved last
            for j, row in zip(c, (p["mix"] @ back).reshape(-1, lm.DIM)):
                d["words"][j] += row
        step("words")
    net.train(context, word, 0.1, 30)
    for k, v in net.params.items():
        assert np.allclose(v, p[k], atol=2e-5), k


def test_lm_scores_beyond_the_range_of_exponentials():
    net, (context, word) = lm_net(), lm_windows(500)
    net.arrays["out"] *= 300
    net.arrays["within"] *= -300
    p, (rank, word_class), want = {k: v.astype(float) for k, v in net.params.items()}, net.target(word), []
    for c, k, own in zip(context, rank, word_class):
        h = np.tanh(p["words"][c].ravel() @ p["mix"] + p["bias"])
        inside = slice(net.cut[own], net.cut[own + 1])
        z, y = h @ p["out"] + p["out_bias"], p["within"][inside] @ h + p["within_bias"][inside]
        want.append(z[own] - z.max() - np.log(np.exp(z - z.max()).sum()) + y[k - inside.start] - y.max() - np.log(np.exp(y - y.max()).sum()))
    assert min(want) < -100 and np.allclose(net.log_prob(context, word), want, rtol=1e-3, atol=2e-2)
    net.train(context, word, 0.1, lm.BATCH)
    assert all(np.isfinite(v).all() for v in net.arrays.values())


def test_lm_equal_windows_are_scored_once_and_alike(monkeypatch):
    net, (context, word), seen = lm_net(), lm_windows(300), []
    scored = lm.Network.sorted_log_prob
    monkeypatch.setattr(lm.Network, "sorted_log_prob", lambda self, c, r: seen.append(len(c)) or scored(self, c, r))
    got = net.log_prob(np.tile(context, (40, 1)), np.tile(word, 40)).reshape(40, -1)
    assert sum(seen) == len({(*c, w) for c, w in zip(context.tolist(), word.tolist())}) and (got == got[0]).all()
    assert np.allclose(got[0], [net.log_prob(context[i : i + 1], word[i : i + 1])[0] for i in range(300)], rtol=1e-4)
    assert len(net.log_prob(context[:0], word[:0])) == 0


def test_lm_learned_network_is_the_one_that_scores(spark):
    """Pairs of words that always stand together become likelier than by their counts."""
    r = np.random.default_rng(6)
    docs = spark.createDataFrame([(i, " ".join(f"a{x} b{x}" for x in r.integers(0, 20, 400))) for i in range(40)], "doc_id long, text string")
    score = [lm.apply(docs, lm.learn(docs, rounds, 0.1, 1)).agg(F.avg("score")).first()[0] for rounds in (0, 1)]
    assert score[1] > score[0] + 0.05


def test_lm_places_of_hashes_with_equal_first_bits():
    r = np.random.default_rng(5)
    pool = np.unique(np.concatenate([r.integers(0, 1 << 64, 3000, np.uint64), (np.uint64(7) << np.uint64(48)) + np.arange(50, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)]))
    for vocabulary in (pool[::2], pool[1::2], pool[:1], pool[:0]):
        at = {int(h): i for i, h in enumerate(vocabulary)}
        assert lm.places(pool, vocabulary).tolist() == [at.get(int(h), lm.UNKNOWN) for h in pool]


def test_lm_scores(spark, odd, no_docs):
    rows = {r["doc_id"]: r for r in lm.lm_scores(odd).collect()}
    assert len(rows) == 18 and rows[3]["n_words"] == 0 and rows[3]["score"] is None and rows[3]["log_prob"] == 0
    assert rows[0]["log_prob"] == rows[1]["log_prob"] and rows[16]["n_words"] == 20000
    assert all(r["score"] < 0 and math.isclose(r["perplexity"], math.exp(-r["score"])) for r in rows.values() if r["n_words"])
    assert lm.lm_scores(no_docs).collect() == []


def test_lm_tells_words_of_one_class_apart_by_context():
    counts = np.zeros(lm.BUCKETS)
    counts[:1000] = 1  # equal counts, so that words 0 and 1 are of one class
    net = lm.Network.new(counts, 1)
    assert len(set(net.target(np.array([0, 1]))[1])) == 1
    word = np.random.default_rng(0).integers(0, 2, 20000)
    context = np.repeat(word[:, None], 4, 1) + 10
    net.train(context, word, 0.1)
    p = [net.log_prob(context[word == i][:1], np.array([j]))[0] for i in (0, 1) for j in (0, 1)]
    assert p[0] > p[1] + 1 and p[3] > p[2] + 1


def test_lm_trains_each_window_once():
    vocabulary = np.sort(lm.hashed(np.frombuffer(b"a b", np.uint8), np.array([0, 3]))[0])
    word = lm.windows(np.frombuffer(b"a zz b yy", np.uint8), np.array([0, 9]), vocabulary)[1]
    assert word[1] == word[3] == lm.UNKNOWN and sorted([word[0], word[2]]) == [0, 1]
    rounds = inspect.signature(lm.lm_scores).parameters["rounds"].default
    for n in (0, 1, 2, 9):
        assert sorted(np.concatenate([lm.targets(n, turn, rounds) for turn in range(rounds)])) == list(range(n))


def test_lm_scores_equal_a_word_by_word_sum(spark):
    """Vocabulary of 15 words, so that most are rare; the model is trained, its scores are summed anew."""
    r = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in r.zipf(1.3, 40) % 90)) for i in range(30)] + [(None, "w1 w1 never seen"), (3, ""), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.learn(docs, 2, 0.1, 1, known=15)
    n = {x["word"]: x["n"] for x in model.words.collect()}
    assert len(model.vocabulary) == 15 and model.rare == sum(n.values()) - sum(n[int(np.int64(x.astype(np.int64)))] for x in model.vocabulary)
    p, want = model.network.params, []
    for doc_id, text in rows:
        words = [lm.hashed(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0] for w in (text or "").split()]
        place = [int(np.searchsorted(model.vocabulary, w)) if w in model.vocabulary else lm.UNKNOWN for w in words]
        total = 0.0
        for i, (w, k) in enumerate(zip(words, place)):
            c = [place[i + d] if 0 <= i + d < len(place) else lm.BUCKETS for d in (-2, -1, 1, 2)]
            h = np.tanh(np.concatenate([p["words"][x] for x in c]) @ p["mix"] + p["bias"])
            z = h @ p["out"] + p["out_bias"]
            rank = model.network.rank[k]
            own = next(j for j in range(lm.CLASSES) if model.network.cut[j] <= rank < model.network.cut[j + 1])
            inside = slice(model.network.cut[own], model.network.cut[own + 1])
            y = p["within"][inside] @ h + p["within_bias"][inside]
            total += z[own] - np.log(np.exp(z).sum()) + y[rank - inside.start] - np.log(np.exp(y).sum())
            total += math.log(n[int(w.astype(np.int64))] / model.rare) if k == lm.UNKNOWN else 0
        want.append((doc_id, len(words), total))
    got = [(x["doc_id"], x["n_words"], x["log_prob"]) for x in lm.apply(docs, model).collect()]
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    for g, w in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert g[:2] == w[:2] and math.isclose(g[2], w[2], rel_tol=1e-4, abs_tol=1e-6)


def test_lm_windows_stay_in_a_document():
    data, offsets = np.frombuffer(b"a b cd", np.uint8), np.array([0, 3, 3, 6])
    context, word, bounds, _ = lm.windows(data, offsets, np.sort(lm.hashed(data, offsets)[0]))
    a, b, c = word.tolist()
    end = lm.BUCKETS
    assert bounds.tolist() == [0, 2, 2, 3]
    assert context.tolist() == [[end, end, b, end], [end, a, end, end], [end, end, end, end]]
    assert c not in (a, b)


def test_repeated_rows(spark, odd):
    """A row that stands twice has twice the same result, whatever the operator."""
    twice = odd.unionByName(odd.where("doc_id in (3, 4, 9, 16)"))
    bench = spark.createDataFrame([(1, "a a a a a a a a a a a")], "item_id long, text string")
    for df in (language_id(twice), license_scan(twice), decontaminate(twice, bench), lm.lm_scores(twice)):
        rows = [tuple(r) for r in df.collect()]
        assert len(rows) == 22
        for i in (3, 4, 9, 16):
            same = [r for r in rows if r[0] == i]
            # sums of a language model differ in their last digits with the rows around a text
            assert len(same) == 2 and all(x == y or math.isclose(x, y, rel_tol=1e-6) for x, y in zip(*same))
    pieces = lexical_packing(twice, window=256).where("doc_id = 9").collect()
    assert sum(r["length"] for r in pieces) == 2 * pieces[0]["doc_tokens"]


PAGES = "page_id long, url string, html string, digest int, side string"


def test_merkle_audit_finds_all_damage(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * (i % 700) * 100, 1, "q") for i in range(600)] + [(None, None, None, 1, "q"), (7, "again", None, 1, "q")], PAGES)
    copies = wf.damaged(wf.warc_records(pages))
    records = wf.cut(wf.catalogue(copies))
    assert records.where("side = 'p'").count() == 602
    want, at = {}, {}
    for r in sorted(copies.collect(), key=lambda r: (r["warc"], r["page_id"] is None, r["page_id"] or 0, hashlib.sha256(r["record"].encode()).hexdigest())):
        offset = at.get(r["warc"], 0)
        at[r["warc"]] = offset + len(r["record"].encode())
        if r["copy"] != r["record"]:
            want[r["warc"], offset] = "missing" if r["copy"] is None else "corrupt"
        if r["stray"]:
            want[r["warc"], offset + 1] = "extra"
    got = {(r["warc"], r["offset"]): r for r in wf.audit(records).collect()}
    assert {k: r["status"] for k, r in got.items()} == want and set(want.values()) == {"missing", "corrupt", "extra"}
    assert {r["length"] for r in got.values() if r["status"] == "extra"} == {5}
    one = records.where("side = 'p'")
    assert wf.audit(one.unionByName(one.withColumn("side", F.lit("r")))).collect() == []
    other = one.where("warc = 'part-00000001.warc'").withColumn("side", F.lit("r"))
    assert {r["status"] for r in wf.audit(one.unionByName(other)).collect()} == {"missing"}
    twice = one.unionByName(one.withColumn("side", F.lit("r"))).unionByName(one.limit(1).withColumn("side", F.lit("r")))
    assert [r["status"] for r in wf.audit(twice).collect()] == ["corrupt"]
    assert wf.audit(records.limit(0)).collect() == []
    assert wf.audit(wf.catalogue(wf.damaged(wf.warc_records(pages.limit(0))))).collect() == []


@pytest.mark.parametrize("sizes", [[5], [300000, 300000, 5]])
def test_merkle_levels_end_in_one_root_per_file(spark, sizes):
    rows = [("p", "f", sum(sizes[:i]), n, f"d{i}") for i, n in enumerate(sizes)]
    levels = wf.merkle_levels(spark.createDataFrame(rows, "side string, warc string, offset long, length long, digest string"))
    assert levels[-1].count() == 1 and len(levels) == wf.LEVELS + 2
