"""Language ID by unigram pieces, summed over all segmentations of the text."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from . import textops as T
from .words import LOWER as LOWER_CASE, UPPER

LETTERS = T.byte_table((0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word scores kept by a Python worker.
CACHE_WORDS = 1 << 18
#: What can stand in a run of letters with a space before it.
POSSIBLE = re.compile(rb" ?[a-z\x80-\xff]*")
ABSENT, PREFIX = -2, -1
BASE = T.BASE_A
#: Places (words times bytes) looked up at once.
PLACES = 1 << 18


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a vocabulary of ranks, one base64 piece and its rank a line: all that can stand in
    a run of letters, and every single byte that can."""
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    return sorted({p for p in pieces if p and POSSIBLE.fullmatch(p)} | {bytes([b]) for b in (32, *np.flatnonzero(LETTERS))})


class Pieces:
    """Finds all pieces, of any length, at all places of a block of words. A table maps the 64-bit
    rolling hash of each prefix of a piece to the piece, or to PREFIX; a place is given up where
    no piece goes on."""

    BITS = 19

    def __init__(self, pieces: list[bytes]):
        known: dict[int, int] = {}
        for i, p in enumerate(pieces):
            key = 0
            for b in p:
                key = (key * BASE + b + 1) & (1 << 64) - 1
                known.setdefault(key, PREFIX)
            assert known[key] == PREFIX, "two pieces of one hash"
            known[key] = i
        self.longest = max(map(len, pieces))
        self.build(np.fromiter(known, np.uint64, len(known)), np.fromiter(known.values(), np.int32, len(known)))

    def __reduce__(self):
        return restored, (self.keys[self.values > ABSENT], self.values[self.values > ABSENT], self.longest)

    def build(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, ABSENT, np.int32)
        at, left, self.depth = self.slot(keys), np.arange(len(keys)), 0
        while len(left):
            own, first = np.unique(at[left], return_index=True)
            first = left[first[self.values[own] == ABSENT]]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            left = np.setdiff1d(left, first, assume_unique=True)
            at[left], self.depth = (at[left] + 1) & (1 << self.BITS) - 1, self.depth + 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], ABSENT)
        left = np.flatnonzero((out == ABSENT) & (self.values[at] > ABSENT))
        for _ in range(self.depth):
            if not len(left):
                break
            at[left] = (at[left] + 1) & (1 << self.BITS) - 1
            hit = (self.keys[at[left]] == keys[left]) & (self.values[at[left]] > ABSENT)
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (self.values[at[left]] > ABSENT)]
        return out

    def edges(self, m: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, row, length, piece) of all pieces that begin in columns a to b, sorted by start.
        Words are the rows of a byte matrix, filled up with zeros, which no piece holds."""
        start, row = np.repeat(np.arange(a, b), len(m)), np.tile(np.arange(len(m)), b - a)
        live, key, found = np.arange(len(start)), np.zeros(len(start), np.uint64), []
        for n in range(1, self.longest + 1):
            inside = start[live] + n <= m.shape[1]
            live, key = live[inside], key[inside]
            key = key * np.uint64(BASE) + m[row[live], start[live] + n - 1] + np.uint64(1)
            value = self.find(key)
            on = value > ABSENT
            live, key, value = live[on], key[on], value[on]
            hit = value >= 0
            found.append((live[hit], np.full(int(hit.sum()), n), value[hit]))
            if not len(live):
                break
        at, n, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        return start[at[order]], row[at[order]], n[order], piece[order]


def restored(keys: np.ndarray, values: np.ndarray, longest: int) -> Pieces:
    out = Pieces.__new__(Pieces)
    out.longest = longest
    out.build(keys, values)
    return out


def matrices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indexes, byte matrix with a space first, lengths) of words of about one length at a time."""
    size = ends - starts + 1
    order = np.argsort(size, kind="stable")
    a = 0
    while a < len(order):
        least = int(size[order[a]])
        widest = -(-least // 4) * 4 if least <= 32 else least + least // 4
        b = min(int(np.searchsorted(size[order], widest, "right")), a + max(1, PLACES // widest))
        rows = order[a:b]
        length = size[rows]
        at = starts[rows, None] - 1 + np.arange(int(length[-1]))
        m = np.where(np.arange(at.shape[1]) < length[:, None], data[np.clip(at, 0, len(data) - 1)], 0)
        m[:, 0] = 32
        yield rows, m, length
        a = b


def log_sums(pieces: Pieces, log_prob: np.ndarray, m: np.ndarray, length: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations of each row, in each language, by the forward algorithm
    on logarithms: no run is too long or too rare. log_prob has a row per piece."""
    n_rows, width = m.shape
    keep = pieces.longest + 1
    ring = np.full((keep * n_rows, log_prob.shape[1]), -np.inf)
    ring[:n_rows] = 0
    out = np.zeros((n_rows, log_prob.shape[1]))
    first = np.searchsorted(length, np.arange(width + 2))  # rows come by length
    step = max(1, PLACES // n_rows)
    for a in range(0, width, step):
        b = min(a + step, width)
        start, row, n, piece = pieces.edges(m, a, b)
        cut, to, source = np.searchsorted(start, np.arange(a, b + 1)), (start + n) % keep * n_rows + row, start % keep * n_rows + row
        for i in range(a, b):
            s, base = slice(cut[i - a], cut[i - a + 1]), i % keep * n_rows
            out[first[i] : first[i + 1]] = ring[base + first[i] : base + first[i + 1]]
            t = to[s]
            ring[t] = np.logaddexp(ring[t], ring[source[s]] + log_prob[piece[s]])
            ring[base : base + n_rows] = -np.inf
    base = width % keep * n_rows
    out[first[width] :] = ring[base + first[width] : base + n_rows]
    return out


def word_scores(pieces: Pieces, log_prob: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """log P(word) in each language."""
    out = np.zeros((len(starts), log_prob.shape[1]))
    for rows, m, length in matrices(data, starts, ends):
        out[rows] = log_sums(pieces, log_prob, m, length)
    return out


def fit(words: list[bytes], counts: np.ndarray, pieces: Pieces, size: int, rounds: int) -> np.ndarray:
    """Piece probabilities of one language by expectation-maximisation over all segmentations."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    blocks = [(rows, m.shape[1], length, pieces.edges(m, 0, m.shape[1])) for rows, m, length in matrices(data, ends - [len(w) for w in words], ends)]
    uniform = np.full(size, 1 / size)
    prob = uniform
    for _ in range(rounds):
        log_prob, expected = np.log(prob), np.zeros(size)
        for rows, width, length, (start, row, n, piece) in blocks:
            ahead, back = np.full((width + 1, len(rows)), -np.inf), np.full((width + 1, len(rows)), -np.inf)
            ahead[0], back[length, np.arange(len(rows))] = 0, 0
            cut = np.searchsorted(start, np.arange(width + 1))
            for i in range(width):
                s = slice(cut[i], cut[i + 1])
                to = (start[s] + n[s], row[s])
                ahead[to] = np.logaddexp(ahead[to], ahead[i, row[s]] + log_prob[piece[s]])
            by_end = np.argsort(start + n, kind="stable")
            cut = np.searchsorted((start + n)[by_end], np.arange(width + 2))
            for i in range(width, 0, -1):
                s = by_end[cut[i] : cut[i + 1]]
                to = (start[s], row[s])
                back[to] = np.logaddexp(back[to], back[i, row[s]] + log_prob[piece[s]])
            share = np.exp(ahead[start, row] + log_prob[piece] + back[start + n, row] - back[0, row])
            expected += np.bincount(piece, share * counts[rows[row]], size)
        prob = 0.999 * expected / max(expected.sum(), 1e-300) + 0.001 * uniform
    return prob


def learn(docs: DataFrame, vocabulary_path: str, per_language: int, rounds: int) -> tuple[list[str], np.ndarray, Broadcast]:
    """Languages, logarithms of piece probabilities (a row per piece, a column per language), pieces.

    Learns from a sample of about ``per_language`` labelled rows of each language (all, where
    there are fewer), picked by a hash; each language is fitted in a task of its own from its
    word counts, which that bound limits. Only the fitted table comes to the driver.
    """
    names, schema = vocabulary(vocabulary_path), "lang string, prob binary"
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(names))
    rows = docs.where("lang is not null and text is not null and not held_out")
    share = rows.groupBy("lang").agg((F.lit(per_language) / F.count("*")).alias("share"))
    picked = rows.join(F.broadcast(share), "lang").where(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) < F.col("share") * (1 << 53))
    word = F.explode(F.split(F.translate("text", UPPER, LOWER_CASE), r"[\x00-\x60\x7B-\x7F]+"))
    counts = picked.select("lang", word.alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))

    def train(table: pd.DataFrame) -> pd.DataFrame:
        prob = fit([w.encode() for w in table["word"]], table["n"].to_numpy(float), pieces.value, len(names), rounds)
        return pd.DataFrame({"lang": [table["lang"].iloc[0]], "prob": [prob.astype("<f8").tobytes()]})

    model = sorted(counts.groupBy("lang").applyInPandas(train, schema).collect())
    table = np.stack([np.frombuffer(r["prob"], "<f8") for r in model], 1) if model else np.zeros((len(names), 0))
    return [r["lang"] for r in model], np.log(table), pieces


def language_id(docs: DataFrame, vocabulary_path: str | None = None, per_language: int = 400, rounds: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """Predict the language of every whole text.

    A text is its runs of letters (A-Z lower-cased, every byte from 0x80 counts as a letter),
    each with a space before it. The probability of a run in a language is the sum over all its
    segmentations into pieces of the vocabulary, whatever its length, by the forward algorithm.
    The language with the largest product wins and the score is its share among all languages.
    Learns only from rows with a lang whose crc32(doc_id) mod 5 is not 0; a prediction uses
    nothing but the text.

    Null texts, and texts without a letter, are ``und`` with score 0, and so is every text if
    there is nothing to learn from. Ties go to the first language in order. One row per input
    row, repeated rows and null doc_ids too; an empty table gives no rows. Returns doc_id, held_out, lang_pred, score, and the columns named by ``keep``; other columns
    are ignored.
    """
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    extra = [c for c in keep if c not in ("doc_id", "text", "lang")]
    docs = docs.select("doc_id", "text", "lang", *extra, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"))
    langs, table, pieces = learn(docs, vocabulary_path, per_language, rounds)
    model = docs.sparkSession.sparkContext.broadcast((langs, table))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, log_prob = model.value
        known, scores = np.zeros(0, T.U64), np.zeros((0, len(langs)))
        for batch in batches:
            preds, shares = [], []
            for _, data, offsets in T.blocks(np.arange(batch.num_rows), batch["text"], 1 << 20):
                raw = data
                data = LOWER[data]
                starts, ends, bounds = T.word_bounds(data, offsets, LETTERS)
                hashes, first, inverse = np.unique(T.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
                place = np.searchsorted(known, hashes)
                new = np.ones(len(hashes), bool)
                if len(known):
                    new = known[np.minimum(place, len(known) - 1)] != hashes
                own = np.empty((len(hashes), len(langs)))
                own[~new] = scores[place[~new]]
                own[new] = word_scores(pieces.value, log_prob, data, starts[first[new]], ends[first[new]])
                if len(known) + int(new.sum()) > CACHE_WORDS:
                    known, scores = hashes, own
                else:
                    order = np.argsort(np.concatenate([known, hashes[new]]), kind="stable")
                    known, scores = np.concatenate([known, hashes[new]])[order], np.concatenate([scores, own[new]])[order]
                total = np.concatenate([np.zeros((1, len(langs))), np.cumsum(own[inverse], 0)])
                total = total[bounds[1:]] - total[bounds[:-1]]
                has = np.diff(np.concatenate([[0], np.cumsum(((data >= 97) & (data <= 122)))])[offsets]) > 0
                for i in np.flatnonzero(~has & (np.diff(bounds) > 0)).tolist():  # letters outside ASCII
                    has[i] = any(c.isalpha() for c in raw[offsets[i] : offsets[i + 1]].tobytes().decode())
                if not langs:
                    has[:] = False
                    preds += ["und"] * len(has)
                    shares.append(np.zeros(len(has)))
                    continue
                best = total.argmax(1)
                share = 1 / np.exp(total - total[np.arange(len(best)), best][:, None]).sum(1)
                preds += [langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)]
                shares.append(np.where(has, share, 0.0))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(preds, pa.string()), pa.array(np.concatenate([*shares, np.zeros(0)])), *(batch[c] for c in rest)], names=["doc_id", "held_out", "lang_pred", "score", *rest])

    kinds, rest = dict(docs.dtypes), [c for c in keep if c != "doc_id"]
    schema = ", ".join([f"doc_id {kinds['doc_id']}, held_out boolean, lang_pred string, score double", *(f"{c} {kinds[c]}" for c in rest)])
    return docs.select("doc_id", "held_out", "text", *(c for c in rest if c != "text")).mapInArrow(T.lean(task), schema)
