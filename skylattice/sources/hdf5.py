"""HDF5 datasets of two dimensions by ranges of bytes: groups, chunk index and filters, and tiles of satellite products.

The older file layout is read (superblock 0 or 1, object headers of version 1), which such products use.
Chunks are found in the index first and read in tasks of their own, so one large file is read in parallel,
and a window costs the chunks under it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import geo
from .tiff import Ranges

SIGNATURE, NOWHERE = b"\x89HDF\r\n\x1a\n", (1 << 64) - 1
#: Fixed numbers of header messages and filters.
SPACE, DATATYPE, LAYOUT, FILTERS, CONTINUED, GROUP = 1, 3, 8, 11, 16, 17
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
#: Rows of a block of a dataset that isn't chunked.
STRIP = 1024
INDEX = "filepath string, dataset string, y_off long, x_off long, rows int, columns int, kind string, address long, size long, mask int, chunk_rows int, chunk_columns int, filters array<int>"
Window = tuple[int, int, int, int]


class Hdf5:
    """A file's groups and datasets."""

    def __init__(self, ranges: Ranges):
        self.ranges = ranges
        head = ranges.get(0, 96)
        if head[:8] != SIGNATURE or head[8] > 1 or head[13:15] != b"\x08\x08":
            raise ValueError("not an HDF5 file of the older layout")
        at = 24 + 4 * head[8]  # version 1 has one number more
        self.base = struct.unpack_from("<Q", head, at)[0]
        self.root = struct.unpack_from("<Q", head, at + 40)[0]

    def get(self, at: int, n: int) -> bytes:
        return self.ranges.get(self.base + at, n)

    def messages(self, at: int) -> Iterator[tuple[int, bytes]]:
        """(type, body) of an object header's messages."""
        version, _, count, _, size = struct.unpack("<BBHII", self.get(at, 12))
        if version != 1:
            raise ValueError("object headers of this version are not supported")
        blocks = [(at + 16, size)]
        while blocks and count:
            data, i = self.get(*blocks.pop(0)), 0
            while i + 8 <= len(data) and count:
                kind, n = struct.unpack_from("<HH", data, i)
                body, i, count = data[i + 8 : i + 8 + n], i + 8 + n, count - 1
                if kind == CONTINUED:
                    blocks.append(struct.unpack("<QQ", body[:16]))
                yield kind, body

    def members(self, at: int) -> dict[str, int]:
        """Names and header addresses of a group's members."""
        found = dict(self.messages(at)).get(GROUP)
        if found is None:
            raise ValueError("not a group")
        tree, heap = struct.unpack("<QQ", found[:16])
        size, _, names_at = struct.unpack("<QQQ", self.get(heap + 8, 24))
        names, out, nodes = self.get(names_at, size), {}, [tree]
        while nodes:
            node = nodes.pop()
            if self.get(node, 4) == b"TREE":
                used = struct.unpack("<H", self.get(node + 6, 2))[0]
                nodes += struct.unpack(f"<{2 * used + 1}Q", self.get(node + 24, 16 * used + 8))[1::2]
                continue
            count = struct.unpack("<H", self.get(node + 6, 2))[0]
            for name, header in (struct.unpack("<QQ24x", self.get(node + 8 + 40 * k, 40)) for k in range(count)):
                out[names[name : names.index(b"\0", name)].decode()] = header
        return out

    def dataset(self, path: str) -> Dataset:
        at = self.root
        for name in path.strip("/").split("/"):
            members = self.members(at)
            if name not in members:
                raise ValueError(f"no {name!r} in {sorted(members)}")
            at = members[name]
        return Dataset(self, dict(self.messages(at)))


class Dataset:
    """Shape, type, filters and places of one dataset."""

    def __init__(self, file: Hdf5, found: dict[int, bytes]):
        self.file, space, kind, layout = file, found[SPACE], found[DATATYPE], found[LAYOUT]
        rank, at = space[1], 8 if space[0] == 1 else 4
        self.shape = struct.unpack_from(f"<{rank}Q", space, at)
        number, size = kind[0] & 15, struct.unpack_from("<I", kind, 4)[0]
        if rank != 2 or number > 1 or layout[0] != 3 or layout[1] not in (1, 2):
            raise ValueError("only datasets of two dimensions and of numbers are supported")
        self.kind = np.dtype(f"{'>' if kind[1] & 1 else '<'}{'f' if number else 'i' if kind[1] & 8 else 'u'}{size}")
        self.chunked = layout[1] == 2
        self.tree, self.chunk = (struct.unpack_from("<Q", layout, 3)[0], struct.unpack_from("<II", layout, 11)) if self.chunked else (struct.unpack_from("<Q", layout, 2)[0], (STRIP, self.shape[1]))
        self.filters = list(self.pipeline(found[FILTERS])) if FILTERS in found else []

    @staticmethod
    def pipeline(body: bytes) -> Iterator[int]:
        old, at = body[0] == 1, 8 if body[0] == 1 else 2
        for _ in range(body[1]):
            number = struct.unpack_from("<H", body, at)[0]
            named = old or number >= 256
            length = struct.unpack_from("<H", body, at + 2)[0] if named else 0
            values = struct.unpack_from("<H", body, at + (6 if named else 4))[0]
            at += (8 if named else 6) + (-(-length // 8) * 8 if old else length) + 4 * (values + (values % 2 if old else 0))
            yield number

    def index(self, window: Window | None = None) -> Iterator[tuple[int, int, int, int, int]]:
        """(y, x, address, bytes, filter mask) of the stored chunks that a window (x, y, w, h) touches, or of all."""
        x, y, w, h = window or (0, 0, self.shape[1], self.shape[0])
        inside = lambda a, b: a < y + h and a + self.chunk[0] > y and b < x + w and b + self.chunk[1] > x
        if self.tree == NOWHERE:
            return
        if not self.chunked:
            line = self.shape[1] * self.kind.itemsize
            for a in range(0, self.shape[0], STRIP):
                if inside(a, 0):
                    yield a, 0, self.tree + a * line, min(STRIP, self.shape[0] - a) * line, 0
            return
        nodes = [self.tree]
        while nodes:
            node = nodes.pop()
            level, used = struct.unpack("<BH", self.file.get(node + 5, 3))
            body = self.file.get(node + 24, 40 * used + 32)  # a key of 32 bytes, an address, a key, ...
            keys = [struct.unpack_from("<IIQQ", body, 40 * k) for k in range(used + 1)]
            for k in range(used):
                size, mask, a, b = keys[k]
                child = struct.unpack_from("<Q", body, 40 * k + 32)[0]
                if level and a < y + h and keys[k + 1][2] + self.chunk[0] > y:
                    nodes.append(child)
                elif not level and inside(a, b):
                    yield a, b, child, size, mask


def decoded(raw: bytes, kind: np.dtype, filters: list[int], mask: int) -> bytes:
    """Bytes of a chunk before its filters, which are undone from the last to the first."""
    for k in reversed(range(len(filters))):
        if mask >> k & 1:
            continue
        if filters[k] == CHECKSUM:
            raw = raw[:-4]
        elif filters[k] == DEFLATE:
            raw = zlib.decompress(raw)
        elif filters[k] == SHUFFLE:
            raw = np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T.tobytes()
        else:
            raise ValueError(f"filter {filters[k]} is not supported")
    return raw


def hdf5_blocks(files: DataFrame, dataset: str, window: Window | None = None, parts: int | None = None) -> DataFrame:
    """Chunks of a dataset of each file (column ``path``): filepath, y_off, x_off, rows, columns, kind (a NumPy
    type) and data, row by row. A file's index is read first, then chunks are dealt to tasks and each
    reads its bytes. Chunks that were never stored are left out, as an absent tile is empty."""

    def list_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                ranges = Ranges(path)
                file = Hdf5(ranges)
                d = file.dataset(dataset)
                found = [(path, dataset, y, x, min(d.chunk[0], d.shape[0] - y), min(d.chunk[1], d.shape[1] - x), d.kind.str, file.base + a, n, mask, d.chunk[0] if d.chunked else min(STRIP, d.shape[0] - y), d.chunk[1], d.filters) for y, x, a, n, mask in d.index(window)]
                ranges.close()
                yield pd.DataFrame(found, columns=[f.split()[0] for f in INDEX.split(", ")])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, rows in batch.groupby("filepath", sort=False):
                ranges = Ranges(path)
                for r in rows.itertuples():
                    kind = np.dtype(r.kind)
                    raw = decoded(ranges.get(r.address, r.size), kind, list(r.filters), r.mask)
                    m = np.frombuffer(raw, kind, r.chunk_rows * r.chunk_columns).reshape(r.chunk_rows, r.chunk_columns)[: r.rows, : r.columns]
                    yield pd.DataFrame({"filepath": [path], "y_off": r.y_off, "x_off": r.x_off, "rows": r.rows, "columns": r.columns, "kind": kind.newbyteorder("<").str, "data": [np.ascontiguousarray(m.astype(kind.newbyteorder("<"))).tobytes()]})
                ranges.close()

    found = files.select("path").mapInPandas(list_chunks, INDEX)
    found = found.repartition(parts or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "filepath", "y_off", "x_off")
    return found.mapInPandas(read, "filepath string, y_off long, x_off long, rows int, columns int, kind string, data binary")


def satellite_tiles(files: DataFrame, dataset: str, side: int, window: Window | None = None) -> DataFrame:
    """``hdf5_blocks`` of files named ``...h<number>v<number>...``, with the bounds of each block in degrees: a
    file is a tile of ten degrees with ``side`` rows and columns."""
    tile = lambda letter: F.regexp_extract("filepath", r"h(\d{2})v(\d{2})[^/]*$", 1 if letter == "h" else 2).cast("int")
    box, step, c = geo.tile_bounds(tile("h"), tile("v")), 10.0 / side, F.col
    out = hdf5_blocks(files, dataset, window)
    west, north = box["west"] + c("x_off") * step, box["north"] - c("y_off") * step
    return out.withColumns({"x_min": west, "x_max": west + c("columns") * step, "y_max": north, "y_min": north - c("rows") * step})


def encoded(m: np.ndarray, path: str, chunk: tuple[int, int] | None = None, filters: tuple[int, ...] = (SHUFFLE, DEFLATE), fan: int = 32) -> bytes:
    """A file of one dataset below nested groups; ``fan`` entries a node of the chunk index."""
    out = bytearray(SIGNATURE + struct.pack("<8B", 0, 0, 0, 0, 0, 8, 8, 0) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, 0, NOWHERE) + bytes(40))

    def put(data: bytes) -> int:
        out.extend(bytes(-len(out) % 8))
        out.extend(data)
        return len(out) - len(data)

    def header(*messages: tuple[int, bytes]) -> int:
        body = b"".join(struct.pack("<HHB3x", kind, len(b) + -len(b) % 8, 0) + b + bytes(-len(b) % 8) for kind, b in messages)
        return put(struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(body)) + body)

    def group(name: str, member: int) -> int:
        names = b"\0" * 8 + name.encode() + b"\0"
        at = put(names)
        heap = put(b"HEAP" + struct.pack("<4xQQQ", len(names), NOWHERE, at))
        leaf = put(b"SNOD" + struct.pack("<BBH", 1, 0, 1) + struct.pack("<QQ24x", 8, member))
        tree = put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NOWHERE, NOWHERE) + struct.pack("<QQQ", 0, leaf, 8))
        return header((GROUP, struct.pack("<QQ", tree, heap)))

    def packed(part: np.ndarray) -> bytes:
        raw = part.tobytes()
        for f in filters:
            if f == SHUFFLE:
                raw = np.frombuffer(raw, np.uint8).reshape(-1, m.itemsize).T.tobytes()
            raw = zlib.compress(raw) if f == DEFLATE else raw + b"sums" if f == CHECKSUM else raw
        return raw

    kind = struct.pack("<BBBBI", 0x10 | (m.dtype.kind == "f"), (m.dtype.byteorder == ">") | 8 * (m.dtype.kind == "i"), 0, 0, m.itemsize) + bytes(12)
    messages = [(SPACE, struct.pack("<BBB5xQQ", 1, 2, 0, *m.shape)), (DATATYPE, kind)]
    if chunk is None:
        messages.append((LAYOUT, struct.pack("<BBQQ", 3, 1, put(m.tobytes()), m.nbytes)))
    else:
        key = lambda size, y, x: struct.pack("<IIQQQ", size, 0, y, x, 0)
        level, nodes = 0, []
        for y in range(0, m.shape[0], chunk[0]):
            for x in range(0, m.shape[1], chunk[1]):
                part = m[y : y + chunk[0], x : x + chunk[1]]
                if part.any():  # a chunk of zeros is not stored
                    raw = packed(np.pad(part, [(0, chunk[0] - part.shape[0]), (0, chunk[1] - part.shape[1])]))
                    nodes.append((key(len(raw), y, x), put(raw)))
        last = key(0, m.shape[0] + chunk[0], 0)
        while level == 0 or len(nodes) > 1:
            above = []
            for k in range(0, max(len(nodes), 1), fan):
                own = nodes[k : k + fan]
                after = nodes[k + fan][0] if k + fan < len(nodes) else last
                above.append((own[0][0] if own else last, put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(own), NOWHERE, NOWHERE) + b"".join(a + struct.pack("<Q", b) for a, b in own) + after)))
            nodes, level = above, level + 1
        messages.append((LAYOUT, struct.pack("<BBBQIII", 3, 2, 3, nodes[0][1], *chunk, m.itemsize)))
        if filters:
            messages.append((FILTERS, struct.pack("<BB6x", 1, len(filters)) + b"".join(struct.pack("<HHHHI4x", f, 0, 0, 1, 0) for f in filters)))
    at = header(*messages)
    for name in reversed(path.strip("/").split("/")):
        at = group(name, at)
    out[56 + 8 : 56 + 16] = struct.pack("<Q", at)
    out[40:48] = struct.pack("<Q", len(out))
    return bytes(out)
