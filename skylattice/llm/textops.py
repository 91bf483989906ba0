"""Vectorised text primitives used inside Arrow tasks: word bounds, span hashes, minimizers.

Everything here works on one block of whole documents held as a byte buffer plus offsets,
so no function loops over words in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd bases of the polynomial hashes; two bases give independent 64-bit lanes.
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Powers kept by a Python worker for each base; more are made anew for a very long text.
KEPT_POWERS = 1 << 20


def release() -> None:
    """Give freed memory back to the system: Python workers live on from stage to stage, and what
    one of them keeps is missing to the other processes of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim:
        trim(0)


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task for mapInArrow, with ``release`` at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release()

    return run


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """A boolean table of the byte values inside any of the closed ranges."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Bytes of words ``[^\x20\x09-\x0D]+``.
NON_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, which makes every output bit depend on every input bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, U64), np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        have = (np.cumprod(up, out=up), np.cumprod(down, out=down))
        if size <= KEPT_POWERS + 1:
            _powers[base] = have
    return have[0][:n], have[1][:n]


class SpanHash:
    """Polynomial hashes of any span of a token sequence from one prefix sum."""

    def __init__(self, tokens: np.ndarray, base: int):
        n = len(tokens)
        self.base, self.prefix = base, np.zeros(n + 1, U64)
        np.cumsum(tokens * powers(base, n)[0], out=self.prefix[1:])
        self.inverse = powers(base, n + 1)[1]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(U64))

    def every(self, k: int) -> np.ndarray:
        """The hash of each run of k tokens."""
        n = len(self.prefix) - 1 - k + 1
        return mix((self.prefix[k:] - self.prefix[:n]) * self.inverse[:n] + U64(k)) if n > 0 else np.zeros(0, U64)


def blocks(ids: np.ndarray, column: pa.Array, max_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cut an Arrow string column into blocks of whole documents: (ids, bytes, offsets).

    A block has at most ``max_bytes`` bytes unless one document alone has more. Nulls are
    empty documents. The cut depends on the lengths alone, so it is the same in each pass.
    """
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
        yield ids[at:to], data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the index of its first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE_A) -> np.ndarray:
    return SpanHash(data.astype(U64) + U64(1), base).of(starts, ends)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values."""
    if len(x) < w:
        return x[:0]
    p = 1
    while 2 * p <= w:
        x, p = np.minimum(x[:-p], x[p:]), 2 * p
    return np.minimum(x[: len(x) - (w - p)], x[w - p :]) if p < w else x


def anchors(x: np.ndarray, starts: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (first window, last window, anchor) of the windows at ``starts``.

    Window s holds the values x[s:s+w]; its anchor is the leftmost smallest one, so equal
    windows have anchors at the same relative place. ``starts`` is sorted.
    """
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    smallest = sliding_min(x, w)[starts]
    step = np.arange(w)
    cut = np.flatnonzero(np.concatenate([[True], (starts[1:] != starts[:-1] + 1) | (smallest[1:] != smallest[:-1])]))
    lo, hi = starts[cut], starts[np.append(cut[1:], len(starts)) - 1]

    def leftmost(at: np.ndarray, value: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.int64)
        for i in range(0, len(at), 1 << 16):
            s = at[i : i + (1 << 16)]
            out[i : i + (1 << 16)] = s + (x[s[:, None] + step] == value[i : i + (1 << 16), None]).argmax(1)
        return out

    pos = leftmost(lo, smallest[cut])
    more = hi > pos  # an equal minimum further right takes over, as in periodic text
    if more.any():
        spans = hi[more] - pos[more]
        rest = np.repeat(pos[more] + 1, spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
        own = leftmost(rest, np.repeat(smallest[cut][more], spans))
        cut2 = np.flatnonzero(np.concatenate([[True], (rest[1:] != rest[:-1] + 1) | (own[1:] != own[:-1])]))
        lo2, hi2, pos2 = rest[cut2], rest[np.append(cut2[1:], len(rest)) - 1], own[cut2]
        hi = np.where(more, pos, hi)
        lo, hi, pos = np.concatenate([lo, lo2]), np.concatenate([hi, hi2]), np.concatenate([pos, pos2])
        order = np.argsort(lo, kind="stable")
        lo, hi, pos = lo[order], hi[order], pos[order]
    return lo, hi, pos
