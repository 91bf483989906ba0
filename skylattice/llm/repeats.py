"""Exact search for repeated windows of tokens by messages between text groups and key ranges.

Documents are dealt once to groups of whole texts by their id. Each pass computes, for every
group, fixed-width keys of its tokens and sends them, sorted and made distinct per block of
text, to the range of keys they fall into; the range answers each block about its own keys.
Spark does the dealing both ways (groupBy and cogroup), NumPy the sorting inside a task. A key
that many documents share costs one entry per block, not one per document, so no key range
grows with the number of copies in a block. There are as many groups and ranges as the bytes of
text ask for, so neither outgrows a task.

Passes over the text:

1. anchors: a window's anchor is its leftmost smallest k-token hash. An anchor's context is the
   whole path of tokens covered by its windows; with each anchor goes a 48-bit mark of its
   context in the block, or of several. Ranges answer which anchors occur again anywhere, which
   have several contexts (they branch), and which lie in very many blocks (they are hot).
   Equal windows have equal anchors, so windows without a repeated anchor need no further
   work; this loses nothing.
2. contexts: where every occurrence of an anchor lies on the same path the path does not branch
   and one entry stands for all its windows. Contexts go to ranges of their own hashes, which
   answer whether an equal one stands earlier.
3. windows: only for the first occurrence of each context of a branching anchor, window by
   window (see ``edges``), or by another resolver for anchors that are not hot, whose contexts
   can meet in one place.
4. the caller's ``finish`` gets the covered token intervals of each block.

Window identity is decided on two 64-bit hashes, of the anchor and of the context or window,
which start from different hashes of each word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as T

MESSAGE = "route int, grp int, blk int, payload binary"
SCHEMA = pa.schema([("route", pa.int32()), ("grp", pa.int32()), ("blk", pa.int32()), ("payload", pa.binary())])
NO_ID = np.iinfo(np.int64).max
#: Tokens of the second hash of bytes.
BYTE_TOKENS = T.mix(np.arange(1, 257).astype(T.U64))
#: Parts in which a key range sorts its keys, one after the other.
PARTS = 16
#: Bytes of text for each key range; a group of texts has a quarter of that.
RANGE_BYTES = 16 << 20


@dataclass(frozen=True)
class Plan:
    """window: tokens of a window; k: tokens of an anchor; words: tokens are words, else bytes;
    within: a repeat inside one document counts; block_bytes: text handled at once in a task;
    hot_blocks: an anchor in more blocks is hot."""

    window: int
    k: int
    words: bool
    within: bool
    block_bytes: int
    hot_blocks: int = 256

    @property
    def record(self) -> np.dtype:
        return np.dtype([("anchor", "<u8"), ("hash", "<u8"), ("doc", "<i8"), ("pos", "<i4")])


class Block:
    """Tokens, anchors and their runs of windows of one block of documents."""

    def __init__(self, plan: Plan, grp: int, blk: int, ids: np.ndarray, ties: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.plan, self.grp, self.blk, self.ids, self.ties, self.data, self.offsets = plan, grp, blk, ids, ties, data, offsets
        if plan.words:
            self.starts, self.ends, self.bounds = T.word_bounds(data, offsets, T.NON_SPACE)
        else:
            self.bounds = offsets

    def index(self) -> None:
        plan = self.plan
        tokens = T.word_hashes(self.data, self.starts, self.ends) if plan.words else self.data.astype(T.U64) + T.U64(1)
        spans, n = T.SpanHash(tokens, T.BASE_B), np.diff(self.bounds) - plan.window + 1
        del tokens
        short = (spans.every(plan.k) >> T.U64(32)).astype(np.uint32)
        n = np.maximum(n, 0)
        windows = np.repeat(self.bounds[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.lo, self.hi, at = T.anchors(short, windows, plan.window - plan.k + 1)
        self.anchor, self.at = spans.of(at, at + plan.k), at
        self.path_hash = None
        self.doc = np.searchsorted(self.bounds, self.lo, "right") - 1
        self.distinct, self.inverse = np.unique(self.anchor, return_inverse=True)

    def hash_b(self) -> T.SpanHash:
        if self.path_hash is None:
            tokens = T.word_hashes(self.data, self.starts, self.ends, T.BASE_B) if self.plan.words else BYTE_TOKENS[self.data]
            self.path_hash = T.SpanHash(tokens, T.BASE_A)
        return self.path_hash

    def context(self, which: np.ndarray) -> np.ndarray:
        """Hash of the path around each of the anchors, and of the anchor's place in it."""
        lo, hi = self.lo[which], self.hi[which]
        return T.mix(self.hash_b().of(lo, hi + self.plan.window) + (self.at[which] - lo).astype(T.U64))

    def marks(self) -> np.ndarray:
        """For each distinct anchor 48 bits of its context here, or 0 for several."""
        if not len(self.distinct):
            return np.zeros(0, T.U64)
        order = np.argsort(self.inverse, kind="stable")
        own, first = self.context(order), np.searchsorted(self.inverse[order], np.arange(len(self.distinct)))
        low, high = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
        return np.where(low == high, low | T.U64(1), T.U64(0)) & T.U64((1 << 48) - 1)

    def routes(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Where the sorted keys of each of n key ranges start."""
        edges = (np.arange(1, n).astype(T.U64)) * T.U64((1 << 64) // n)
        return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])

    def send(self, keys: np.ndarray, payload: np.ndarray, n: int) -> list[tuple[int, int, int, bytes]]:
        """One message for each key range: the rows of ``payload``, aligned with the sorted keys."""
        cut = self.routes(keys, n)
        return [(r, self.grp, self.blk, payload[cut[r] : cut[r + 1]].tobytes()) for r in np.flatnonzero(np.diff(cut))]

    def heard(self, keys: np.ndarray, replies: dict, n: int, width: int) -> np.ndarray:
        """Bits the key ranges answered, aligned with the sorted keys."""
        out, cut = np.zeros((len(keys), width), bool), self.routes(keys, n)
        for route, payload in replies.get(self.blk, ()):
            size = int(cut[route + 1] - cut[route])
            bits = np.unpackbits(np.frombuffer(payload, np.uint8), count=size * width)
            out[cut[route] : cut[route + 1]] = bits.reshape(size, width)
        return out

    def candidates(self, replies: dict, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indexes of the anchors that occur more than once anywhere; which of these branch or are hot."""
        again = np.bincount(self.inverse, minlength=len(self.distinct)) > 1
        said = self.heard(self.distinct, replies, n, 3)
        which = np.flatnonzero((again | said[:, 0])[self.inverse])
        return which, said[self.inverse[which], 1], said[self.inverse[which], 2]

    def records(self, which: np.ndarray, hashes: np.ndarray, pos: np.ndarray) -> np.ndarray:
        out = np.empty(len(which), self.plan.record)
        out["anchor"], out["hash"], out["doc"] = self.anchor[which], hashes, self.ids[self.doc[which]]
        out["pos"] = pos - self.bounds[self.doc[which]] if self.plan.within else 0
        return out


def first_of(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order by (anchor, hash, doc, pos), and for each sorted row the index of the first
    row with its anchor and hash."""
    order = np.lexsort((records["pos"], records["doc"], records["hash"], records["anchor"]))
    s = records[order]
    new = np.ones(len(s), bool)
    new[1:] = (s["anchor"][1:] != s["anchor"][:-1]) | (s["hash"][1:] != s["hash"][:-1])
    return order, np.flatnonzero(new)[np.cumsum(new) - 1] if len(s) else np.zeros(0, np.int64)


def later(records: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each record: an equal one comes before it (in document order, or by place too)."""
    s, f = records[order], records[order][first]
    out = np.zeros(len(records), bool)
    out[order] = (s["doc"] > f["doc"]) | (s["pos"] > f["pos"])
    return out


def contexts(block: Block, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context records of the anchors, distinct first records by hash, each one's index there)."""
    records = block.records(which, block.context(which), block.lo[which])
    order, first = first_of(records)
    heads, place = np.unique(first, return_inverse=True)
    by_hash = np.argsort(records["hash"][order][heads], kind="stable")
    moved, index = np.empty(len(heads), np.int64), np.empty(len(which), np.int64)
    moved[by_hash] = np.arange(len(heads))
    index[order] = moved[place]
    return records, records[order][heads[by_hash]], index


def _answer(table: pa.Table, sizes: np.ndarray, bits: np.ndarray) -> pa.Table:
    """Send each message's bits back to its block; blocks without a set bit hear nothing."""
    rows, at = [], 0
    for route, grp, blk, size in zip(*(table[c].to_pylist() for c in ("route", "grp", "blk")), sizes, strict=True):
        part = bits[at : at + size]
        at += size
        if part.any():
            rows.append((route, grp, blk, np.packbits(part).tobytes()))
    T.release()
    return _messages(rows)


def _messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)


def _joined(table: pa.Table, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All payloads of a table as one array, read in place, and the rows of each."""
    column = table["payload"].combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # none, or beyond what one array holds
        column = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1] or bytes(8), kind)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data.view(dtype), np.diff(ends).astype(np.int64) // dtype.itemsize


def _replies(table: pa.Table) -> dict[int, list[tuple[int, bytes]]]:
    out: dict[int, list[tuple[int, bytes]]] = {}
    for route, blk, payload in zip(*(table[c].to_pylist() for c in ("route", "blk", "payload")), strict=True):
        out.setdefault(blk, []).append((route, payload))
    return out


def _bundle(replies: list[tuple[int, bytes]]) -> bytes:
    """Replies (range, payload) as one payload: their number, ranges and lengths, then the payloads."""
    head = np.array([len(replies), *(r for r, _ in replies), *(len(p) for _, p in replies)], "<i4")
    return head.tobytes() + b"".join(p for _, p in replies)


def _unbundle(data: bytes) -> list[tuple[int, bytes]]:
    n = int(np.frombuffer(data, "<i4", 1)[0])
    routes, sizes = np.frombuffer(data, "<i4", 2 * n, 4).reshape(2, n)
    ends = 4 + 8 * n + np.cumsum(sizes)
    return [(r, data[e - k : e]) for r, k, e in zip(routes.tolist(), sizes.tolist(), ends.tolist(), strict=True)]


def _blocks(plan: Plan, docs: pa.Table) -> Iterator[Block]:
    if not docs.num_rows:
        return
    docs = docs.sort_by([("doc_id", "ascending"), ("tie", "ascending")])
    ids, ties = docs["doc_id"].fill_null(NO_ID).to_numpy(), docs["tie"].to_numpy()
    grp = docs["grp"][0].as_py()
    text = docs["text"].cast(pa.large_binary()).combine_chunks()
    if isinstance(text, pa.ChunkedArray):
        text = text.chunk(0)
    for blk, (i, data, offsets) in enumerate(T.blocks(np.arange(len(ids)), text, plan.block_bytes)):
        yield Block(plan, grp, blk, ids[i], ties[i], data, offsets)


#: 48 bits of an anchor travel besides those of its key range, which only choose candidates, and 48
#: of its context.
SHORT = np.dtype((np.void, 12))


def _short(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    six = [np.ascontiguousarray(x).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6] for x in (keys, marks)]
    return np.concatenate(six, 1).view(SHORT).ravel()


def _long(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((2, len(raw), 8), np.uint8)
    out[:, :, :6] = raw.view(np.uint8).reshape(-1, 2, 6).swapaxes(0, 1)
    keys, marks = out.view("<u8").reshape(2, -1)
    return keys, marks


def deal(docs: DataFrame, n: int) -> DataFrame:
    """Rows in ``n`` groups by id and text, so that rows without an id, or with one that repeats, spread as
    others do. ``tie`` orders texts of one id within a group."""
    group = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    return docs.select(group.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))


def find(docs: DataFrame, plan: Plan, finish: Callable, schema: str, branches: tuple[Callable, Callable] | None = None) -> DataFrame:
    """``docs`` has doc_id and text; ``finish(block, intervals)`` yields Arrow tables by ``schema``.

    branches: how pass 3 sends a branching context of an anchor that isn't hot and how a range answers;
    edge by edge by default.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    dealt = deal(docs, 4 * n)

    def send_anchors(docs: pa.Table) -> pa.Table:
        out = []
        for b in _blocks(plan, docs):
            b.index()
            out += b.send(b.distinct, _short(b.distinct, b.marks()), n)
            del b
        T.release()
        return _messages(out)

    def answer_anchors(table: pa.Table) -> pa.Table:
        raw, sizes = _joined(table, SHORT)
        bits, part = np.empty((len(raw), 3), bool), raw.view(np.uint8).reshape(-1, SHORT.itemsize)[:, 0] % PARTS
        for p in range(PARTS):  # by the last bits of the key, so that only a part is sorted at once
            at = np.flatnonzero(part == p)
            if not len(at):
                continue
            keys, marks = _long(raw[at])
            order = np.argsort(keys, kind="stable")
            keys, marks, at = keys[order], marks[order], at[order]
            del order
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            count = np.diff(np.append(first, len(keys)))
            low, high = np.minimum.reduceat(marks, first), np.maximum.reduceat(marks, first)
            bits[at] = np.repeat(np.stack([count > 1, (low == 0) | (low != high), count > plan.hot_blocks], 1), count, axis=0)
        return _answer(table, sizes, bits)

    def send_contexts(docs: pa.Table, replies: pa.Table) -> pa.Table:
        heard, out = _replies(replies), []
        for b in _blocks(plan, docs):
            b.index()
            heads = contexts(b, b.candidates(heard, n)[0])[1]
            out += b.send(heads["hash"], heads, n)
            # what pass 1 said goes on to the same block of the next pass, as one message
            if b.blk in heard:
                out.append((-1 - b.grp, b.grp, b.blk, _bundle(heard[b.blk])))
            del b
        T.release()
        return _messages(out)

    def answer_contexts(table: pa.Table) -> pa.Table:
        if table["route"][0].as_py() < 0:
            return table
        records, sizes = _joined(table, plan.record)
        return _answer(table, sizes, later(records, *first_of(records)))

    def send_rest(docs: pa.Table, replies: pa.Table) -> pa.Table:
        said, out = _replies(replies), []
        for b in _blocks(plan, docs):
            b.index()
            first_pass = {b.blk: [x for r, p in said.get(b.blk, ()) if r < 0 for x in _unbundle(p)]}
            second = {b.blk: [(r, p) for r, p in said.get(b.blk, ()) if r >= 0]}
            which, branching, hot = b.candidates(first_pass, n)
            records, heads, index = contexts(b, which)
            local = (records["doc"] > heads["doc"][index]) | (records["pos"] > heads["pos"][index])
            whole = local | b.heard(heads["hash"], second, n, 1)[index, 0]
            # a context's first occurrence stands for it; ties of repeated rows send the same twice
            rest = ~whole & branching
            by_edge = rest & (hot | (branches is None))
            covered = np.stack([b.lo[which[whole]], b.hi[which[whole]] + plan.window], 1).astype("<i4")
            more, known = edges(b, which[by_edge], n)
            covered = merged(np.concatenate([covered, known]))
            out += more
            if branches is not None:
                out += [(n + r, *m) for r, *m in branches[0](b, which[rest & ~by_edge], n)]
            if len(covered):
                out.append((-1 - b.grp, b.grp, b.blk, covered.tobytes()))
            del b
        T.release()
        return _messages(out)

    def answer_rest(table: pa.Table) -> pa.Table:
        route = table["route"][0].as_py()
        return table if route < 0 else answer_edges(table, plan) if route < n else branches[1](table, plan)

    def last(docs: pa.Table, replies: pa.Table) -> pa.Table:
        said, out = _replies(replies), []
        for b in _blocks(plan, docs):
            parts = [np.frombuffer(p, "<i4").reshape(-1, 2) for _, p in said.get(b.blk, ())]
            out.append(finish(b, merged(np.concatenate(parts)) if parts else np.zeros((0, 2), "<i4")))
            del b
        T.release()
        return pa.concat_tables(out) if out else finish(None, None)

    grouped = lambda df: df.groupBy("grp")
    ask = lambda df, f: df.groupBy("route").applyInArrow(f, MESSAGE)
    one = ask(grouped(dealt).applyInArrow(send_anchors, MESSAGE), answer_anchors)
    two = ask(grouped(dealt).cogroup(grouped(one)).applyInArrow(send_contexts, MESSAGE), answer_contexts)
    three = ask(grouped(dealt).cogroup(grouped(two)).applyInArrow(send_rest, MESSAGE), answer_rest)
    return grouped(dealt).cogroup(grouped(three)).applyInArrow(last, schema)


def merged(intervals: np.ndarray) -> np.ndarray:
    """Union of half-open intervals, sorted; touching ones become one."""
    if not len(intervals):
        return intervals.reshape(0, 2).astype("<i4")
    intervals = intervals[np.argsort(intervals[:, 0], kind="stable")]
    reach = np.maximum.accumulate(intervals[:, 1])
    new = np.concatenate([[True], intervals[1:, 0] > reach[:-1]])
    cut = np.flatnonzero(new)
    return np.stack([intervals[cut, 0], reach[np.append(cut[1:], len(intervals)) - 1]], 1).astype("<i4")


EDGE = np.dtype([("anchor", "<u8"), ("hash", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("start", "<i4")])


def edges(block: Block, rest: np.ndarray, n: int) -> tuple[list, np.ndarray]:
    """Each window of the contexts at ``rest`` as one edge, keyed by its hash."""
    plan = block.plan
    sizes = block.hi[rest] - block.lo[rest] + 1
    owner = np.repeat(rest, sizes)
    start = np.repeat(block.lo[rest], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if not len(start):
        return [], np.zeros((0, 2), "<i4")
    records = block.records(owner, block.hash_b().of(start, start + plan.window), start)
    order, first = first_of(records)
    after = later(records, order, first)
    known = np.stack([start[after], start[after] + plan.window], 1).astype("<i4")
    out = np.empty(int((~after).sum()), EDGE)
    for c in plan.record.names:
        out[c] = records[c][~after]
    out["start"] = start[~after]
    out = out[np.argsort(out["hash"], kind="stable")]
    return block.send(out["hash"], out, n), known


def answer_edges(table: pa.Table, plan: Plan) -> pa.Table:
    """The covered intervals of the windows that stand earlier elsewhere, back to their blocks."""
    records, sizes = _joined(table, EDGE)
    order, first = first_of(records)
    after, rows, at = later(records, order, first), [], 0
    for grp, blk, size in zip(table["grp"].to_pylist(), table["blk"].to_pylist(), sizes, strict=True):
        start = records["start"][at : at + size][after[at : at + size]]
        at += size
        if len(start):
            start = np.sort(start)
            rows.append((0, grp, blk, merged(np.stack([start, start + plan.window], 1)).tobytes()))
    return _messages(rows)
