"""Packing by lexical retrieval: each window is filled with the BM25 neighbours of its seed."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from . import textops as T
from .components import cut

SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
END = 1
K1, SATURATION_B = 1.2, 0.75
#: Topics: at most so many seeds, four a shard, each known by its best terms.
TOPICS, TOPIC_TERMS = 1024, 64
#: Documents read for each border between two shards.
BORDER_SAMPLE = 32
#: Neighbours that are put in order at once.
AT_ONCE = 64
#: How byte-level tokenizers split a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(spec: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Ranks of the pieces, and special strings, of a tokenizer file, if it is plain byte-level BPE whose
    ids come in the order of its merges, so that merging by ranks gives the same ids."""
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if [model["vocab"][t] for t in merged] != list(range(256, 256 + len(merged))):
        return None
    # the alphabet of such files: printable bytes stand for themselves, the others follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}, special


class Encoder:
    """Token ids of whole texts: by ``tokenizers``, or by ``tiktoken``, which takes a quarter of the
    time, where the file is one whose ids are ranks (``byte_ranks``)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size = max(max(spec["model"]["vocab"].values()), *(t["id"] for t in spec["added_tokens"]), END) + 1
        ranks = byte_ranks(spec)
        self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks[0], special_tokens=ranks[1]) if ranks else None

    @cached_property
    def tokenizer(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    @property
    def kind(self) -> str:
        return "<u2" if self.size <= 1 << 16 else "<u4"

    def ids(self, text: str) -> list[int]:
        if self.fast is None:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if any(x in text for x in self.fast.special_tokens_set):
            return self.fast.encode(text, allowed_special="all")
        return self.fast.encode_ordinary(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text followed by END, and the offset of each text."""
        found = [np.array([*self.ids(text), END], self.kind) for text in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        return np.concatenate([np.zeros(0, self.kind), *found]), offsets


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget_encoders() -> None:
    """Workers live on from stage to stage; later stages need the memory."""
    _encoders.clear()


def terms(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, frequency) of each distinct term of each document, by document and term."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    wide, bits = (np.uint32, 16) if ids.dtype.itemsize == 2 and n <= 1 << 16 else (np.uint64, 32)
    pairs, tf = np.unique((np.repeat(np.arange(n, dtype=wide), sizes) << wide(bits)) | ids.astype(wide), return_counts=True)
    return (pairs >> wide(bits)).astype(np.int64), (pairs & wide((1 << bits) - 1)).astype(np.int64), tf


@dataclass
class Corpus:
    """What BM25 needs of all documents: their number, mean length and document frequencies."""

    n: int
    mean: float
    df: np.ndarray

    def weights(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, BM25 weight) of each distinct term of each document, by document and term."""
        doc, term, tf = terms(ids, offsets)
        sizes, idf = np.diff(offsets), np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))
        idf[END : END + 1] = 0  # every document ends with it
        norm = K1 * (1 - SATURATION_B + SATURATION_B * sizes / max(self.mean, 1))
        return doc, term, (idf[term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)


@dataclass
class Topics:
    """Seeds drawn from all documents. A document's topic is the seed that scores it best; topics
    are numbered along a chain of similar ones, so borders between shards part little."""

    first: np.ndarray
    seed: np.ndarray
    weight: np.ndarray
    k: int

    @classmethod
    def new(cls, corpus: Corpus, seeds: list[tuple[np.ndarray, np.ndarray]]) -> Topics:
        used, place = np.unique(np.concatenate([t for t, _ in seeds]), return_inverse=True)
        m = np.zeros((len(seeds), len(used)), np.float32)
        m[np.repeat(np.arange(len(seeds)), [len(t) for t, _ in seeds]), place] = np.concatenate([w for _, w in seeds])
        m /= np.sqrt((m * m).sum(1, keepdims=True)) + 1e-9
        near, chain = m @ m.T, [0]
        free = np.ones(len(seeds), bool)
        free[0] = False
        while free.any():
            chain.append(int(np.where(free, near[chain[-1]], -1).argmax()))
            free[chain[-1]] = False
        term, seed = np.nonzero(m[chain].T)
        return cls(np.searchsorted(used[term], np.arange(len(corpus.df) + 1)), seed, m[chain].T[term, seed], len(seeds))

    def of(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        out, step = np.zeros(n, np.int64), max(1, (1 << 21) // self.k)
        for a in range(0, n, step):
            part = slice(*np.searchsorted(doc, [a, min(a + step, n)]))
            size = self.first[term[part] + 1] - self.first[term[part]]
            at = np.repeat(self.first[term[part]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            cell = np.repeat((doc[part] - a) * self.k, size) + self.seed[at]
            score = np.bincount(cell, np.repeat(weight[part], size) * self.weight[at], min(step, n - a) * self.k)
            out[a : a + step] = score.reshape(-1, self.k).argmax(1)
        return out


def routes(corpus: Corpus, topics: Topics | None, ids: np.ndarray, offsets: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A number for each document: its topic, its two best terms that others have too, a salt.
    The salt lets a border run through documents that are alike in all the rest."""
    n = len(offsets) - 1
    doc, term, weight = corpus.weights(ids, offsets)
    out = topics.of(doc, term, weight, n) if topics else np.zeros(n, np.int64)
    value, starts = np.where(corpus.df[term] > 1, weight, -1), np.searchsorted(doc, np.arange(n))
    for _ in range(2):
        best = np.flatnonzero(value == np.maximum.reduceat(value, starts)[doc]) if n else starts
        best = best[np.unique(doc[best], return_index=True)[1]]  # the first of equal ones
        out, value[best] = (out << 18) | (term[best] & 0x3FFFF), -2
    return (out << 17) | (salt & 0x1FFFF)


class Shard:
    """A BM25 inverted index over the documents of one shard; terms are token ids, and their
    weights are those of the whole corpus."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, corpus: Corpus):
        self.n = n = len(offsets) - 1
        doc, term, weight = corpus.weights(ids, offsets)
        terms, self.own, df = np.unique(term, return_inverse=True, return_counts=True)
        self.own_at = np.searchsorted(doc, np.arange(n + 1))
        by = np.argsort(self.own, kind="stable")
        self.doc, self.weight, self.end = doc[by], weight[by], np.cumsum(df)
        self.first = self.end - df
        # the lists of terms that many documents have are rows of a matrix
        often = np.flatnonzero(df > n / 8)
        self.row = np.full(len(terms), -1)
        self.row[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), n), np.float32)
        row = np.repeat(self.row, df)
        self.matrix[row[row >= 0], self.doc[row >= 0]] = self.weight[row >= 0]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all documents; the query is every distinct term of the seed."""
        own = self.own[self.own_at[seed] : self.own_at[seed + 1]]
        row = self.row[own]
        out, own = self.matrix[row[row >= 0]].sum(0), own[row < 0]
        size = self.end[own] - self.first[own]
        at = np.repeat(self.first[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return out + np.bincount(self.doc[at], self.weight[at], self.n)


def falling(score: np.ndarray, unused: np.ndarray) -> Iterator[int]:
    """All unused documents by falling score, equal ones by their number."""
    rest = np.flatnonzero(unused)
    while len(rest):
        s = score[rest]
        now = s >= np.partition(s, len(s) - AT_ONCE)[len(s) - AT_ONCE] if len(s) > AT_ONCE else np.ones(len(s), bool)
        yield from rest[now][np.argsort(-s[now], kind="stable")].tolist()
        rest = rest[~now]


def pack(ids: np.ndarray, offsets: np.ndarray, window: int, corpus: Corpus) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece.

    A seed opens a window; its unused neighbours, those with a term of its, fill it by falling score,
    and the one that doesn't fit is cut there and becomes the next seed. If no neighbour is left,
    the next unused document in the shard's order is a seed that goes on with the window. Only a
    shard's last window is padded.
    """
    shard, sizes = Shard(ids, offsets, corpus), np.diff(offsets)
    unused = np.ones(len(sizes), bool)
    fresh, sequence, filled, seed, start = 0, 0, 0, -1, 0
    left = len(sizes)
    while left or seed >= 0:
        if seed < 0:
            while not unused[fresh]:
                fresh += 1
            seed, start = fresh, 0
            unused[seed], left = False, left - 1
        # full windows of the seed itself, then the rest of it
        while sizes[seed] - start >= window - filled:
            yield seed, start, window - filled, sequence, filled
            start, sequence, filled = start + window - filled, sequence + 1, 0
        if start < sizes[seed]:
            yield seed, start, int(sizes[seed]) - start, sequence, filled
            filled += int(sizes[seed]) - start
        carried, seed = seed, -1
        if not filled or not left:
            continue
        score = shard.scores(carried)
        for d in falling(score, unused & (score > 0)):
            unused[d], left = False, left - 1
            room = window - filled
            if sizes[d] > room:
                yield d, 0, room, sequence, filled
                seed, start, sequence, filled = d, room, sequence + 1, 0
                break
            yield d, 0, int(sizes[d]), sequence, filled
            filled += int(sizes[d])
            if filled == window:
                sequence, filled = sequence + 1, 0
                break


def held(table: pa.Table | pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets of the encoded documents of a table."""
    parts, width = table["ids"].to_pylist(), np.dtype(kind).itemsize
    return np.frombuffer(b"".join(parts), kind), np.concatenate([[0], np.cumsum([len(p) // width for p in parts], dtype=np.int64)])


def few(batches: Iterator[pa.RecordBatch], size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``size`` bytes of ids; one longer document is a batch."""
    forget_encoders()
    for batch in batches:
        for rows, _, _ in T.blocks(np.arange(batch.num_rows), batch["ids"], size):
            yield batch.slice(int(rows[0]), len(rows))


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (2 or 4 bytes each), bytes of text, and a salt that differs from row to row."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("bytes", pa.int64()), ("salt", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows, _, places in T.blocks(np.arange(batch.num_rows), batch["text"], 1 << 20):
                part = batch.slice(int(rows[0]), len(rows))
                ids, offsets = encoder(tokenizer).encode(part["text"].fill_null("").to_pylist())
                raw, cuts = memoryview(ids).cast("B"), (ids.itemsize * offsets).tolist()
                salt = (T.mix(np.arange(row + 1, row + 1 + len(rows)).astype(T.U64)) >> T.U64(1)).astype(np.int64)
                row += len(rows)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([bytes(raw[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array(np.diff(places)), pa.array(salt)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(T.lean(task), "doc_id long, ids binary, bytes long, salt long")


def counted(docs: DataFrame, kind: str) -> tuple[Corpus, int]:
    """Document frequencies and lengths of all encoded documents, and their bytes of text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0, np.int64)
        for batch in few(batches):
            more = np.bincount(terms(*held(batch, kind))[1])
            n, more = (n, more) if len(n) >= len(more) else (more, n)
            n[: len(more)] += more
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["term", "n"])

    total = docs.agg(F.count("*").alias("n"), F.sum(F.length("ids") / np.dtype(kind).itemsize).alias("tokens"), F.sum("bytes").alias("bytes")).first()
    rows = docs.select("ids").mapInArrow(T.lean(task), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # at most the tokenizer's terms
    df = np.zeros(max((r["term"] for r in rows), default=0) + 1)
    for r in rows:
        df[r["term"]] = r["n"]
    return Corpus(total["n"], (total["tokens"] or 0) / max(total["n"], 1), df), total["bytes"] or 0


def drawn(docs: DataFrame, share: float) -> DataFrame:
    return docs.where(F.col("salt") < int(min(share, 1.0) * ((1 << 63) - 1))) if share < 1 else docs


def lexical_packing(docs: DataFrame, tokenizer: str | None = None, window: int = 2048, shard_bytes: int = 4 << 20) -> DataFrame:
    """Pack all documents into sequences of ``window`` tokens, neighbours by BM25 together.

    A document is its ids by ``tokenizer`` (a file of the tokenizers library) and then id 1; null
    text is empty, so it is one piece of that id; very long texts are encoded whole. Document frequencies and the mean length are those of all documents. Documents
    are dealt to shards of about ``shard_bytes`` of text by what they are about, wherever in the
    input they stand: by topic, best terms and a salt (``routes``), with borders from a sample.
    A task holds the index and ids of one shard, and neighbours are looked for in the shard,
    by all terms of the seed. Every id lies in exactly one piece; only the last sequence of a
    shard is padded.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, one row per piece.
    Repeated rows are separate documents; equal scores fall to the document first in the shard's
    order; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")

    kinds = ", ".join(f"{f.name} long" for f in SCHEMA)
    kind = encoder(tokenizer).kind
    docs = cut(encoded(docs, tokenizer))
    corpus, size = counted(docs, kind)
    if not corpus.n:
        return docs.sparkSession.createDataFrame([], kinds)
    n_shards = max(1, -(-size // shard_bytes))
    shared = docs.sparkSession.sparkContext.broadcast(corpus)

    def best_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            doc, term, weight = shared.value.weights(*held(batch, kind))
            by = np.lexsort([-weight, doc])
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            best = [by[a : min(a + TOPIC_TERMS, b)] for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch["salt"], pa.array([term[i].tobytes() for i in best]), pa.array([weight[i].tobytes() for i in best])], names=["salt", "terms", "weights"])

    topics = None
    if n_shards > 1:
        seeds = sorted(drawn(docs, min(max(4 * n_shards, 64), TOPICS) / corpus.n).mapInArrow(T.lean(best_terms), "salt long, terms binary, weights binary").collect())
        topics = Topics.new(corpus, [(np.frombuffer(r["terms"], np.int64), np.frombuffer(r["weights"], np.float32)) for r in seeds[:TOPICS]]) if seeds else None
    topics = docs.sparkSession.sparkContext.broadcast(topics)

    def route(batch: pa.RecordBatch) -> np.ndarray:
        return routes(shared.value, topics.value, *held(batch, kind), batch["salt"].to_numpy())

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            yield pa.RecordBatch.from_arrays([pa.array(route(batch)), batch["bytes"]], names=["route", "bytes"])

    borders = np.zeros(0, np.int64)
    if n_shards > 1:
        sample = np.array(sorted(drawn(docs, BORDER_SAMPLE * n_shards / corpus.n).mapInArrow(T.lean(sampled), "route long, bytes long").collect()), np.int64).reshape(-1, 2)
        reach = np.cumsum(sample[:, 1])
        if len(sample):
            borders = np.unique(sample[np.searchsorted(reach, reach[-1] * np.arange(1, n_shards) / n_shards), 0])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            at = route(batch)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(borders, at, "right")), pa.array(at), *batch.columns], names=["shard", "route", *batch.schema.names])

    def packed(table: pa.Table) -> pa.Table:
        forget_encoders()
        table = table.sort_by([("route", "ascending"), ("salt", "ascending")])
        # a shard that came out too large is cut into even parts
        reach = np.cumsum(table["bytes"].to_numpy())
        part = (reach - 1).clip(0) * -(-max(int(reach[-1]), 1) // shard_bytes) // max(int(reach[-1]), 1)
        sequence, out = table["shard"][0].as_py() << 40, []
        for own_part in np.unique(part):
            own_rows = np.flatnonzero(part == own_part)
            piece = table.slice(int(own_rows[0]), len(own_rows))
            ids, offsets = held(piece, kind)
            doc, start, length, own, offset = np.array(list(pack(ids, offsets, window, shared.value)), np.int64).reshape(-1, 5).T
            data, at = memoryview(ids.astype("<u4")).cast("B"), offsets[doc] + start
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            columns = [piece["doc_id"].combine_chunks().take(pa.array(doc)), start, length, np.array(crc, np.int64), np.diff(offsets)[doc], sequence + own, offset]
            sequence += int(own[-1]) + 1
            out.append(pa.Table.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in columns], schema=SCHEMA))
        T.release()
        return pa.concat_tables(out)

    rows = docs.mapInArrow(T.lean(dealt), "shard long, route long, doc_id long, ids binary, bytes long, salt long")
    return rows.groupBy("shard").applyInArrow(packed, kinds)
