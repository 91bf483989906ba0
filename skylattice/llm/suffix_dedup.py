"""Byte-exact removal of repeated strings: blockwise suffix sorting with cover-sample ranks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats, textops as T

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
#: Every COVER-th column of the aligned contexts is a cover sample.
COVER = 20
#: Contexts sorted at once; an anchor's contexts stay together.
AT_ONCE = 1 << 16


def context_type(plan: repeats.Plan) -> np.dtype:
    width = 2 * plan.window - plan.k
    return np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("start", "<i4"), ("left", "<u2"), ("windows", "<u2"), ("text", "u1", (width,))])


def send_suffixes(block: repeats.Block, rest: np.ndarray, n: int) -> list:
    """The bytes of each branching context, keyed by its anchor."""
    if not len(rest):
        return []
    plan, rest = block.plan, rest[np.argsort(block.anchor[rest], kind="stable")]
    out = np.zeros(len(rest), context_type(plan))
    lo = block.lo[rest]
    out["anchor"], out["doc"], out["start"] = block.anchor[rest], block.ids[block.doc[rest]], lo
    out["pos"] = lo - block.bounds[block.doc[rest]]
    out["left"], out["windows"] = block.at[rest] - lo, block.hi[rest] - lo + 1
    step = np.arange(out["text"].shape[1])
    ends = (out["windows"].astype(np.int64) - 1 + plan.window)[:, None]
    out["text"] = block.data[np.minimum(lo[:, None] + step, len(block.data) - 1)] * (step < ends)
    return block.send(out["anchor"], out, n)


def packed(m: np.ndarray, start: int, n: int) -> list[np.ndarray]:
    """Columns start..start+n of a byte matrix as big-endian numbers, most significant last."""
    wide = np.zeros((len(m), -(-n // 8) * 8), np.uint8)
    wide[:, :n] = m[:, start : start + n]
    return [c.astype(np.uint64) for c in wide.view(">u8").T][::-1]


def cover_ranks(m: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes at each cover column, from right to left: a sample is ranked by its
    own COVER bytes and then by the rank of the next sample, which was computed before."""
    ranks = [np.zeros(len(m), np.int64)]
    for q in range(m.shape[1] - COVER, -1, -COVER):
        keys = [ranks[-1], *packed(m, q, COVER)]
        order = np.lexsort(keys)
        new = np.zeros(len(m), bool)
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        rank = np.empty(len(m), np.int64)
        rank[order] = np.cumsum(new)
        ranks.append(rank)
    return ranks[::-1]


def sort_buckets(c: np.ndarray, plan: repeats.Plan) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset of the window in it) of each window that also stands earlier.

    Contexts are aligned at their anchors, so two equal windows always start in the same
    column: any two suffixes that can tie differ by a multiple of COVER at every sample, and
    the one residue 0 is a difference cover for them. One column after another is a suffix
    bucket: it is sorted by the few bytes up to the next sample and that sample's rank, so no
    long common prefix is ever compared byte by byte. Equal windows are then neighbours.
    """
    side = plan.window - plan.k
    width = -(-(side + plan.window + COVER) // COVER) * COVER
    m = np.zeros((len(c), width), np.uint8)
    source = np.arange(side + plan.window) - (side - c["left"].astype(np.int64))[:, None]
    inside = (source >= 0) & (source < c["text"].shape[1])
    m[:, : side + plan.window] = np.take_along_axis(c["text"], np.where(inside, source, 0), 1) * inside
    ranks, found, places = cover_ranks(m), [], []
    first = side - c["left"].astype(np.int64)
    for col in range(side + 1):
        rows = np.flatnonzero((first <= col) & (col < first + c["windows"]))
        if len(rows) < 2:
            continue
        q = -(-col // COVER)
        place = c["pos"][rows].astype(np.int64) + col - first[rows]
        keys = [place, c["doc"][rows], ranks[q][rows]] + (packed(m[rows], col, q * COVER - col) if q * COVER > col else [])
        rows = rows[np.lexsort(keys)]
        text = m[rows, col : col + plan.window]
        new = np.concatenate([[True], (text[1:] != text[:-1]).any(1)])
        head = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
        after = (c["doc"][rows] > c["doc"][head]) | (c["pos"][rows] - first[rows] > c["pos"][head] - first[head])
        # ranks see past the window, so the least (doc, place) of a run need not come first
        if not new.all():
            group = np.cumsum(new) - 1
            at = c["pos"][rows].astype(np.int64) + col - first[rows]
            by = np.lexsort([at, c["doc"][rows], group])
            lead = by[np.flatnonzero(new)][group[by]]
            after[by] = (c["doc"][rows][by] > c["doc"][rows][lead]) | (at[by] > at[lead])
        found.append(rows[after])
        places.append((col - first[rows])[after])
    return (np.concatenate(found), np.concatenate(places)) if found else (np.zeros(0, np.int64),) * 2


def answer_suffixes(table: pa.Table, plan: repeats.Plan) -> pa.Table:
    records, sizes = repeats._joined(table, context_type(plan))
    order = np.argsort(records["anchor"], kind="stable")
    ends = np.append(np.flatnonzero(np.diff(records["anchor"][order])) + 1, len(order))
    start, starts, owner = 0, [], []
    message = np.repeat(np.arange(len(sizes)), sizes)
    while start < len(order):
        stop = int(ends[min(np.searchsorted(ends, start + AT_ONCE), len(ends) - 1)])
        rows = order[start:stop]
        which, offset = sort_buckets(records[rows], plan)
        starts.append(records["start"][rows[which]] + offset)
        owner.append(message[rows[which]])
        start = stop
    start, owner = np.concatenate(starts), np.concatenate(owner)
    by = np.lexsort([start, owner])
    start, owner = start[by], owner[by]
    cut, out = np.searchsorted(owner, np.arange(len(sizes) + 1)), []
    for i, (grp, blk) in enumerate(zip(table["grp"].to_pylist(), table["blk"].to_pylist(), strict=True)):
        s = start[cut[i] : cut[i + 1]]
        if len(s):
            out.append((0, grp, blk, repeats.merged(np.stack([s, s + plan.window], 1)).tobytes()))
    T.release()
    return repeats._messages(out)


def suffix_dedup(docs: DataFrame, length: int = 100, anchor: int = 40, block_bytes: int = 1 << 18, hot_blocks: int = 256) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts earlier (smaller
    doc_id, or the same document and an earlier start), overlaps included.

    Suffixes are put into buckets by a content-defined anchor (the smallest hash of ``anchor``
    bytes within the string). Buckets that hold a single suffix, or suffixes with one common
    context, need no sorting (``repeats``); the rest are sorted one bucket at a time, long ties
    by the ranks of cover samples computed before (``sort_buckets``). A task holds the contexts
    of one key range, of 2 * length - anchor bytes each, never the corpus. A bucket whose anchor
    lies in more than ``hot_blocks`` blocks of text would outgrow a task; its strings are dealt one
    by one by their hashes instead, each distinct one once a block.

    Null text is empty; very long texts are read whole, each by one task. Strings never cross
    documents. Repeated rows (the same doc_id and text) do not remove each other; rows without
    a doc_id come last, and of equal strings in rows that tie the first place stays. One row per
    input row, none for an empty table; other columns are ignored.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.
    """

    def finish(block, intervals):
        rows = {c: [] for c in SCHEMA.names}
        if block is None:
            return pa.table(rows, schema=SCHEMA)
        raw, bounds = memoryview(block.data.tobytes()), block.offsets.tolist()
        first = np.searchsorted(intervals[:, 1], block.offsets[:-1], "right")
        past = np.searchsorted(intervals[:, 0], block.offsets[1:], "left")
        for i, doc in enumerate(block.ids.tolist()):
            a, b = bounds[i], bounds[i + 1]
            digest, at, removed, spans = hashlib.sha256(), a, 0, 0
            for lo, hi in intervals[first[i] : past[i]].tolist():
                lo, hi = max(lo, a), min(hi, b)
                digest.update(raw[at:lo])
                at, removed, spans = hi, removed + hi - lo, spans + 1
            digest.update(raw[at:b])
            for c, v in zip(SCHEMA.names, (None if doc == repeats.NO_ID else doc, b - a, removed, spans, digest.hexdigest()), strict=True):
                rows[c].append(v)
        return pa.table(rows, schema=SCHEMA)

    plan = repeats.Plan(window=length, k=min(anchor, length), words=False, within=True, block_bytes=block_bytes, hot_blocks=hot_blocks)
    return repeats.find(docs.select("doc_id", "text"), plan, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", (send_suffixes, answer_suffixes))
