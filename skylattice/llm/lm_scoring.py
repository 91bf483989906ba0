"""Masked pseudo-likelihood of documents under a bidirectional window network trained in NumPy."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as T
from .components import cut
from .minhash_dedup import LOWER

#: Context words on each side, words told apart, word vector, hidden units, word classes.
SIDE, BUCKETS, DIM, HIDDEN, CLASSES = 2, 1 << 13, 12, 32, 64
#: The arrays of a network; each row of ``out`` and ``within`` ends with its bias.
NAMES = ("words", "mix", "bias", "out", "within")
#: Windows of a minibatch in training.
BATCH = 4096
#: Windows, or rows of parameters, that are worked on at once, so that they stay in the caches.
PART = 1 << 10
#: Windows scored at once.
SCORED = 1 << 12
#: The bucket of words outside the vocabulary.
UNKNOWN = BUCKETS - 1


@dataclass
class Network:
    """P(word | both sides) = P(class | context) * P(word | class, context).

    The context's word vectors, one place each, pass a tanh layer, a softmax over classes and one
    over the words of the class. A word's class is the slice of the corpus frequency order it lies
    in; slices have equal sums of the square roots of their counts, so the few windows with rare
    words, whose classes are large, and the many with frequent ones cost about the same.
    ``rank`` is a word's place in that order and ``cut`` where each class starts.
    """

    arrays: dict[str, np.ndarray]
    rank: np.ndarray
    cut: np.ndarray

    @classmethod
    def new(cls, counts: np.ndarray, seed: int) -> Network:
        rng, counts = np.random.default_rng(seed), counts + 0.5
        order = np.argsort(-counts, kind="stable")
        sorted_counts = counts[order]
        weight = np.sqrt(sorted_counts)
        word_class = np.minimum((np.cumsum(weight) - weight / 2) / weight.sum() * CLASSES, CLASSES - 1).astype(np.int64)
        rank = np.empty(BUCKETS, np.int64)
        rank[order] = np.arange(BUCKETS)
        start = np.bincount(word_class, sorted_counts, CLASSES)
        shape = {"words": (BUCKETS + 1, DIM), "mix": (2 * SIDE * DIM, HIDDEN), "bias": (HIDDEN,), "out": (HIDDEN, CLASSES), "out_bias": (CLASSES,), "within": (BUCKETS, HIDDEN), "within_bias": (BUCKETS,)}
        scale = {"words": 0.3, "mix": (2 * SIDE * DIM) ** -0.5, "out": HIDDEN**-0.5}
        params = {k: (rng.standard_normal(s) * scale.get(k, 0)).astype(np.float32) for k, s in shape.items()}
        params["out_bias"] = np.log(np.maximum(start, 0.5) / start.sum()).astype(np.float32)
        params["within_bias"] = np.log(sorted_counts / start[word_class]).astype(np.float32)
        params["out"] = np.column_stack([params["out"].T, params.pop("out_bias")])
        params["within"] = np.column_stack([params["within"], params.pop("within_bias")])
        return cls(params, rank, np.searchsorted(word_class, np.arange(CLASSES + 1)))

    @property
    def params(self) -> dict[str, np.ndarray]:
        """Weights and biases by themselves, as views."""
        a = self.arrays
        return a | {"out": a["out"][:, :-1].T, "out_bias": a["out"][:, -1], "within": a["within"][:, :-1], "within_bias": a["within"][:, -1]}

    def copy(self) -> Network:
        return Network({k: v.copy() for k, v in self.arrays.items()}, self.rank, self.cut)

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(input, hidden units and a one for the biases)."""
        p = self.arrays
        x = np.take(p["words"], context, 0, mode="clip").reshape(len(context), -1)
        h = np.ones((len(context), HIDDEN + 1), np.float32)
        inner = x @ p["mix"]
        inner += p["bias"]
        np.tanh(inner, out=h[:, :-1])
        return x, h

    def by_class(self, rank: np.ndarray) -> Iterator[tuple[slice, slice]]:
        """(windows of a class, words of that class) for windows that stand in the order of their ranks;
        classes of one word have nothing to choose and are left out."""
        ends, cut = np.searchsorted(rank, self.cut).tolist(), self.cut.tolist()
        for first, end, start, stop in zip(ends, ends[1:], cut, cut[1:]):
            if end > first and stop > start + 1:
                yield slice(first, end), slice(start, stop)

    def target(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = self.rank[word]
        return rank, np.searchsorted(self.cut, rank, "right") - 1

    def log_prob(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Equal windows, of which copies have many, are scored once."""
        rank, context = self.rank[word], np.ascontiguousarray(context, np.uint16)
        whole = context.view(T.U64)[:, 0]
        key = rank.astype(T.U64) << T.U64(51) | T.mix(whole) >> T.U64(13)
        order = np.argsort(key)
        whole, rank = whole[order], rank[order]
        new = np.append(True, (whole[1:] != whole[:-1]) | (rank[1:] != rank[:-1]))[: len(rank)]
        at = np.flatnonzero(new)
        part, context, rank = np.empty(len(at), np.float32), context[order[at]], rank[at]
        for i in range(0, len(at), SCORED):
            part[i : i + SCORED] = self.sorted_log_prob(context[i : i + SCORED], rank[i : i + SCORED])
        out = np.empty(len(word), np.float32)
        out[order] = part[np.cumsum(new) - 1]
        return out

    def sorted_log_prob(self, context: np.ndarray, rank: np.ndarray) -> np.ndarray:
        h = self.hidden(context)[1]
        z = self.arrays["out"] @ h.T
        column, word_class = np.arange(len(rank)), np.searchsorted(self.cut, rank, "right") - 1
        part = z[word_class, column] - log_sum(z)
        for rows, words in self.by_class(rank):
            y = self.arrays["within"][words] @ h[rows].T
            part[rows] += y[rank[rows] - words.start, column[: y.shape[1]]] - log_sum(y)
        return part

    def fresh(self) -> dict[str, np.ndarray]:
        """AdaGrad's sums of squares, for ``train`` to go on with from block to block."""
        return {k: np.full_like(v, 1e-2) for k, v in self.arrays.items()}

    def train(self, context: np.ndarray, word: np.ndarray, rate: float, batch: int = 256, past: dict[str, np.ndarray] | None = None) -> None:
        """One pass of minibatch AdaGrad."""
        p, past = self.arrays, self.fresh() if past is None else past
        slope, cut, within = {k: np.empty_like(p[k]) for k in ("out", "within")}, self.cut.tolist(), p["within"]

        def step(k: str, at, d: np.ndarray) -> None:
            """``d`` is overwritten."""
            root = d * d
            root += past[k][at]
            past[k][at] = root
            np.sqrt(root, out=root)
            d /= root
            d *= rate
            p[k][at] -= d

        for i in range(0, len(word), batch):
            rank = self.rank[word[i : i + batch]]
            order = np.argsort(rank.astype(np.uint16), kind="stable")  # BUCKETS fits; such keys sort fastest
            c, rank, n = np.take(context[i : i + batch], order, 0), rank[order], len(order)
            word_class, share = np.searchsorted(self.cut, rank, "right") - 1, np.float32(1 / n)
            x, h = self.hidden(c)
            back, inside = np.empty((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)

            slope["out"][:] = 0
            for j in range(0, n, PART):
                own = h[j : j + PART]
                g = softmax(own @ p["out"].T)
                g[np.arange(len(own)), word_class[j : j + PART]] -= 1
                np.matmul(g, p["out"][:, :-1], out=back[j : j + PART])
                slope["out"] += g.T @ own

            # the scores of the words of all classes lie one after another, so that only products go class by class
            size = np.diff(self.cut)[word_class]
            first = np.cumsum(size) - size
            e, ends = np.empty(size.sum(), np.float32), np.searchsorted(rank, self.cut)
            at, ends = np.append(first, len(e))[ends].tolist(), ends.tolist()
            some = [(slice(at[k], at[k + 1]), slice(ends[k], ends[k + 1]), slice(cut[k], cut[k + 1])) for k in range(CLASSES) if ends[k] < ends[k + 1]]
            for flat, rows, words in some:
                np.matmul(h[rows], within[words].T, out=e[flat].reshape(rows.stop - rows.start, -1))
            e = softmax_of_runs(e, first, size)
            e[first + rank - self.cut[word_class]] -= 1
            slope["within"][:] = 0
            for flat, rows, words in some:
                y = e[flat].reshape(rows.stop - rows.start, -1)
                np.matmul(y, within[words, :-1], out=inside[rows])
                np.matmul(y.T, h[rows], out=slope["within"][words])

            for j in range(0, BUCKETS, PART):
                slope["within"][j : j + PART] *= share
                step("within", slice(j, j + PART), slope["within"][j : j + PART])
            slope["out"] *= share
            step("out", slice(None), slope["out"])
            h = h[:, :-1]
            back += inside
            back *= share
            back -= back * h * h
            step("mix", slice(None), x.T @ back)
            step("bias", slice(None), back.sum(0))
            ids = c.ravel().astype(np.uint16)
            place = np.argsort(ids, kind="stable")
            ids = ids[place].astype(np.int64)
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            # summed up as pairs, which takes half the steps
            pairs = np.take((back @ p["mix"].T).reshape(-1, DIM), place, 0).view(np.complex64)
            step("words", ids[first], np.add.reduceat(pairs, first).view(np.float32))


def fits(total: np.ndarray) -> bool:
    """Whether sums of exponentials are far from both ends of their type."""
    return bool(1e-30 < total.min() and total.max() < 1e30)


def softmax(z: np.ndarray) -> np.ndarray:
    """Row by row; scores are shifted by a row's top only where their exponentials would not fit."""
    with np.errstate(over="ignore"):
        e = np.exp(z)
        total = e @ np.ones(z.shape[1], z.dtype)
    if not fits(total):
        e = np.exp(z - z.max(1, keepdims=True))
        total = e.sum(1)
    e *= (1 / total)[:, None]
    return e


def softmax_of_runs(z: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Softmax of each run of a flat array; runs lie one after another."""
    with np.errstate(over="ignore"):
        e = np.exp(z)
        total = np.add.reduceat(e, first)
    if not fits(total):
        e = np.exp(z - np.repeat(np.maximum.reduceat(z, first), size))
        total = np.add.reduceat(e, first)
    e *= np.repeat(1 / total, size)
    return e


def log_sum(z: np.ndarray) -> np.ndarray:
    """Logarithm of each column's sum of exponentials."""
    with np.errstate(over="ignore"):
        total = np.ones(len(z), z.dtype) @ np.exp(z)
    if fits(total):
        return np.log(total)
    top = z.max(0)
    return top + np.log(np.exp(z - top).sum(0))


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each document)."""
    hashes, bounds, n = [], [np.zeros(1, np.int64)], 0
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])
    for _, part, at in T.blocks(np.arange(len(column)), column, 1 << 16):  # small ones stay in the caches
        part = np.take(LOWER, part)
        starts, ends, first = T.word_bounds(part, at, T.NON_SPACE)
        hashes.append(T.word_hashes(part, starts, ends))
        bounds.append(first[1:] + n)
        n += len(starts)
    return np.concatenate([np.zeros(0, T.U64), *hashes]), np.concatenate(bounds)


def places(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """The place of each hash in the sorted ``vocabulary``, or UNKNOWN. Its first bits tell where to look."""
    word, shift = np.full(len(hashes), UNKNOWN, np.uint16), T.U64(48)
    count = np.bincount((vocabulary >> shift).view(np.int64), minlength=1 << 16)
    first, top = np.cumsum(count) - count, (hashes >> shift).view(np.int64)
    left = slice(None)
    for j in range(count.max(initial=0)):
        at = np.minimum(first.take(top[left]) + j, len(vocabulary) - 1)
        word[left] = np.where(vocabulary.take(at) == hashes[left], at, word[left])
        left = np.flatnonzero(count.take(top) > j + 1)
    return word


def windows(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, words, first word of each document, hashes of the words); BUCKETS stands beyond a
    document's ends. A word is its place in the sorted hashes of ``vocabulary``, or UNKNOWN."""
    hashes, bounds = hashed(data, offsets)
    word = places(hashes, vocabulary)
    # the documents one after another with SIDE ends between them
    at = np.arange(SIDE, SIDE + len(word)) + SIDE * np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    padded = np.full(len(word) + SIDE * (len(bounds) + 1), BUCKETS, np.uint16)
    padded[at] = word
    sides = np.empty((len(padded), 2 * SIDE), np.uint16)
    for j, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        sides[SIDE:-SIDE, j] = padded[SIDE + step : len(padded) - SIDE + step]
    context = np.take(sides, at, 0)
    return context, word, bounds, hashes


def texts(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for rows, data, offsets in T.blocks(np.arange(batch.num_rows), batch["text"], size):
            yield batch, rows, data, offsets


def targets(n: int, turn: int, rounds: int) -> np.ndarray:
    """The windows of a block that a round trains; each window is in exactly one round."""
    return np.arange(turn, n, rounds)


@dataclass
class Model:
    """A trained network; ``vocabulary`` has the sorted hashes of the words told apart. ``words`` is a
    table (word, n) of all words of the corpus and ``rare`` how often words outside the vocabulary
    stand in it: P(word | unknown) is the word's own share n / rare."""

    network: Network
    vocabulary: np.ndarray
    words: DataFrame
    rare: int


def learn(docs: DataFrame, rounds: int, rate: float, seed: int, known: int = UNKNOWN) -> Model:
    """The ``known`` most frequent words, BUCKETS - 1 at most, are told apart."""
    context = docs.sparkSession.sparkContext

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, data, offsets in texts(batches):
            ids, n = np.unique(hashed(data, offsets)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n)], names=["word", "n"])

    every = cut(docs.select("text").mapInArrow(T.lean(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    top = sorted((np.uint64(r["word"] % (1 << 64)), r["n"]) for r in every.orderBy(F.desc("n"), "word").limit(min(known, UNKNOWN)).collect())
    vocabulary, counts = np.array([w for w, _ in top], T.U64), np.zeros(BUCKETS)
    counts[: len(top)] = [n for _, n in top]
    counts[UNKNOWN] = (every.agg(F.sum("n")).first()[0] or 0) - counts.sum()
    network, rare = Network.new(counts, seed), int(counts[UNKNOWN])

    for turn in range(rounds):
        shared = context.broadcast(network)

        def local(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            own = shared.value.copy()
            seen, past = 0, own.fresh()
            for _, _, data, offsets in texts(batches):
                c, w, *_ = windows(data, offsets, vocabulary)
                pick = targets(len(w), turn, rounds)
                own.train(c[pick], w[pick], rate / (turn + 1), BATCH, past)
                seen += len(pick)
            if seen:
                flat = np.concatenate([own.arrays[k].ravel() for k in NAMES]).astype(np.float64) * seen
                parts = np.array_split(flat, 64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array([p.tobytes() for p in parts]), pa.array(np.full(64, seen))], names=["part", "sum", "seen"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, "<f8") for x in table["sum"].to_pylist())
            return pa.table({"part": table["part"][:1], "sum": [total.tobytes()], "seen": [sum(table["seen"].to_pylist())]})

        sums = docs.select("text").mapInArrow(T.lean(local), "part long, sum binary, seen long")
        # in two steps, so that no task adds up the networks of all tasks
        step = sums.groupBy("part", F.pmod(F.xxhash64("sum"), F.lit(32)).alias("g")).applyInArrow(add, "part long, sum binary, seen long")
        done = sorted(step.groupBy("part").applyInArrow(add, "part long, sum binary, seen long").collect())
        shared.unpersist()
        if done:
            flat, at = np.concatenate([np.frombuffer(r["sum"], "<f8") / r["seen"] for r in done]).astype(np.float32), 0
            for k in NAMES:
                size = network.arrays[k].size
                network.arrays[k], at = flat[at : at + size].reshape(network.arrays[k].shape), at + size
    return Model(network, vocabulary, every, rare)


def apply(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((model.network, model.vocabulary))
    log_rare = math.log(max(model.rare, 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, vocabulary = shared.value
        for batch, rows, data, offsets in texts(batches):
            c, w, bounds, hashes = windows(data, offsets, vocabulary)
            each, at = network.log_prob(c, w).astype(np.float64), np.flatnonzero(w == UNKNOWN)
            each[at] -= log_rare  # the word's own count follows by a join
            total = np.concatenate([[0.0], np.cumsum(each)])
            words = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, bounds).astype(np.int32)), pa.array(hashes[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(rows)), pa.array(np.diff(bounds)), pa.array(total[bounds[1:]] - total[bounds[:-1]]), words], names=["doc_id", "n_words", "known", "words"])

    scored = docs.mapInArrow(T.lean(score), f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, known double, words array<long>")
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    # no word is very frequent here, as those are in the vocabulary; the logarithm of a count of one is 0
    more = model.words.where("n > 1").select("word", F.log("n").alias("log_n"))
    share = scored.select("row", F.explode("words").alias("word")).join(more, "word").groupBy("row").agg(F.sum("log_n").alias("share"))
    total = F.col("known") + F.coalesce("share", F.lit(0.0))
    mean = F.when(F.col("n_words") > 0, total / F.col("n_words"))
    return scored.join(share, "row", "left").select("doc_id", "n_words", total.alias("log_prob"), mean.alias("score"), F.exp(-mean).alias("perplexity"))


def lm_scores(docs: DataFrame, rounds: int = 2, rate: float = 0.1, seed: int = 11) -> DataFrame:
    """Sum over a document's words of log P(word | SIDE words before and after it).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. The BUCKETS - 1 most frequent of all
    documents are told apart by context, and all others share one unknown word; P(word | unknown)
    is the word's share among them in the whole corpus, so a word's own count always matters.
    Counts and classes come from all words of all documents. Training is local descent with
    averaging: in each round every task starts from the same network and makes one pass over
    every ``rounds``-th window of all its texts, each round at another offset, so each window is a
    target in exactly one round; the tasks' networks are averaged by the number of their windows,
    in blocks of parameters, by a Spark aggregation. So the network depends, a little, on how
    the input is split. Its size is fixed, whatever the corpus.

    Null and empty texts have no words, log_prob 0 and a null score; very long ones are read whole.
    One row per input row, null doc_ids too; ties and repeated rows get equal scores but for
    rounding; other columns are ignored. An empty table gives no rows.

    Returns doc_id, n_words, log_prob (the sum), score (the mean), perplexity.
    """
    docs = docs.select("doc_id", "text")
    return apply(docs, learn(docs, rounds, rate, seed))
