"""TIFF files by ranges of bytes: tags, strips and tiles, and their compressions, read and written.

Readers ask a ``Ranges`` for the bytes they need, so a header or a window costs the bytes of its tags and
blocks alone, wherever the file is kept.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyarrow import fs

#: TIFF tags that are read or written.
WIDTH, LENGTH, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILES, TILE_SIZES, SCALE, TIEPOINT = 322, 323, 324, 325, 33550, 33922
TYPES = {1: "u1", 2: "S1", 3: "u2", 4: "u4", 5: "u8", 11: "f4", 12: "f8", 16: "u8"}
#: Tags of a header; places and sizes of blocks are left out, which grow with the image.
HEADER_TAGS = frozenset((WIDTH, LENGTH, BITS, COMPRESSION, SAMPLES, ROWS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, SCALE, TIEPOINT))
#: Bytes read at once where little is asked for, as tags tend to lie together.
CHUNK = 4096


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI as Spark writes it, in which nothing is escaped, and the place there."""
    scheme, found, rest = path.partition(":/")
    if not found or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority, _, place = rest.removeprefix("/").partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system, f"{base.rstrip('/')}/{place}"


class Ranges:
    """Ranges of a file by path or URI, or of bytes; counts what it reads."""

    def __init__(self, source: str | bytes):
        self.data = source if isinstance(source, bytes | bytearray | memoryview) else None
        if self.data is None:
            system, place = located(source)
            self.file = system.open_input_file(place)
            self.size = self.file.size()
        else:
            self.size = len(self.data)
        self.read, self.held, self.at = 0, b"", 0

    def get(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise ValueError("a range beyond the end of the file")
        if self.data is not None:
            self.read += n
            return bytes(self.data[at : at + n])
        if not self.at <= at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(min(max(n, CHUNK), self.size - at), at)
            self.read += len(self.held)
        return self.held[at - self.at : at - self.at + n]

    def close(self) -> None:
        if self.data is None:
            self.file.close()


def tags_of(ranges: Ranges, only: frozenset[int] | None = None) -> dict[int, np.ndarray]:
    """Tags of the first directory of a classic or large TIFF; ValueError for anything else."""
    head = ranges.get(0, min(16, ranges.size))
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    kind = struct.unpack(f"{order}H", head[2:4])[0] if order and len(head) >= 8 else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    big = kind == 43
    at = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
    count, entry, word = (8, 20, "Q") if big else (2, 12, "I")
    n = struct.unpack(f"{order}{'Q' if big else 'H'}", ranges.get(at, count))[0]
    table, tags = ranges.get(at + count, n * entry), {}
    for i in range(n):
        tag, kind, many = struct.unpack_from(f"{order}HH{word}", table, entry * i)
        if kind in TYPES and (only is None or tag in only):
            t = np.dtype(TYPES[kind]).newbyteorder(order)
            inline = entry * i + (12 if big else 8)
            if t.itemsize * many <= (8 if big else 4):
                tags[tag] = np.frombuffer(table, t, many, inline)
            else:
                tags[tag] = np.frombuffer(ranges.get(struct.unpack_from(f"{order}{word}", table, inline)[0], t.itemsize * many), t)
    return tags


def unpacked_bits(data: bytes) -> bytes:
    """PackBits: a byte n below 128 and n + 1 bytes as they are, or one byte 257 - n times."""
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            out += data[i + 1 : i + 2] * (257 - n if n > 128 else 0)
            i += 2 if n > 128 else 1
    return bytes(out)


#: Codes that empty the table and that end the data; the width of a code grows one code early.
CLEAR, END, FIRST, WIDEST = 256, 257, 258, 12


def unpacked_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, highest bit first."""
    out, table, last, width = [], [], b"", 9
    bits = held = 0
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        while held >= width:
            held -= width
            code = bits >> held
            bits &= (1 << held) - 1
            if code == CLEAR:
                table, last, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
                continue
            if code == END:
                return b"".join(out)
            if not table:
                raise ValueError("LZW data that do not begin with a clear code")
            if not last:
                here = table[code]
            else:
                here = table[code] if code < len(table) else last + last[:1]
                table.append(last + here[:1])
            out.append(here)
            last = here
            if len(table) >= (1 << width) - 1 and width < WIDEST:
                width += 1
    return b"".join(out)


def packed_lzw(data: bytes) -> bytes:
    """The inverse of ``unpacked_lzw``."""
    out, bits, held, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held)
            bits &= (1 << held) - 1

    put(CLEAR)
    table, word = {bytes([i]): i for i in range(256)}, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = len(table) + 2
        size = len(table) + 2
        if size == (1 << WIDEST) - 1:
            put(CLEAR)
            table, width = {bytes([k]): k for k in range(256)}, 9
        elif size >= 1 << width:
            width += 1
        word = data[i : i + 1]
    if word:
        put(table[word])
        if len(table) + 3 >= 1 << width and width < WIDEST:  # the reader's table grows with this code
            width += 1
    put(END)
    if held:
        out.append(bits << (8 - held) & 255)
    return bytes(out)


#: TIFF compression number: what makes bytes of a block.
READERS = {1: bytes, 5: unpacked_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpacked_bits}
WRITERS = {"none": (1, bytes), "lzw": (5, packed_lzw), "deflate": (8, zlib.compress)}


class Tiff:
    """Geometry of an image and its blocks, which are strips or tiles."""

    def __init__(self, ranges: Ranges, header: bool = False):
        self.ranges, t = ranges, tags_of(ranges, HEADER_TAGS if header else None)
        one = lambda tag, default: int(t[tag][0]) if tag in t and len(t[tag]) else default
        if WIDTH not in t or LENGTH not in t:
            raise ValueError("a TIFF file without a size")
        self.tags, self.columns, self.rows = t, one(WIDTH, 0), one(LENGTH, 0)
        self.bands, self.bits, self.planes, self.predictor = one(SAMPLES, 1), one(BITS, 1), one(PLANAR, 1) == 2, one(PREDICTOR, 1)
        self.compression, self.tiled = one(COMPRESSION, 1), TILE_WIDTH in t
        self.block_columns = one(TILE_WIDTH, 0) if self.tiled else self.columns
        self.block_rows = one(TILE_LENGTH, 0) if self.tiled else min(one(ROWS, self.rows), self.rows)
        self.across, self.down = -(-self.columns // max(self.block_columns, 1)), -(-self.rows // max(self.block_rows, 1))
        self.kind = t[WIDTH].dtype.byteorder

    def bounds(self) -> tuple[float, float, float, float] | None:
        """x_min, x_max, y_min, y_max, or None without a model."""
        if SCALE not in self.tags or TIEPOINT not in self.tags:
            return None
        (pw, ph), tie = self.tags[SCALE][:2], self.tags[TIEPOINT]
        x, y = tie[3] - tie[0] * pw, tie[4] + tie[1] * ph
        return float(x), float(x + pw * self.columns), float(y - ph * self.rows), float(y)

    def inside(self, window: tuple[int, int, int, int] | None = None) -> Iterator[tuple[int, int]]:
        """(block_x, block_y) of the blocks that a window (x, y, w, h) touches, or of all."""
        x, y, w, h = window or (0, 0, self.columns, self.rows)
        x, y, right, bottom = max(x, 0), max(y, 0), min(x + w, self.columns), min(y + h, self.rows)
        if x < right and y < bottom:
            for j in range(y // self.block_rows, (bottom - 1) // self.block_rows + 1):
                for i in range(x // self.block_columns, (right - 1) // self.block_columns + 1):
                    yield i, j

    def block(self, i: int, j: int) -> np.ndarray:
        """Pixels (rows, columns, bands) of a block, without what lies beyond the image."""
        unpack = READERS.get(self.compression)
        if unpack is None or self.predictor not in (1, 2) or self.bits not in (8, 16, 32):
            raise ValueError("TIFF files of this compression are not supported")
        places, sizes = (self.tags[TILES], self.tags[TILE_SIZES]) if self.tiled else (self.tags[STRIPS], self.tags[SIZES])
        rows = self.block_rows if self.tiled else min(self.block_rows, self.rows - j * self.block_rows)
        kind = np.dtype(f"u{self.bits // 8}").newbyteorder("<" if self.ranges.get(0, 2) == b"II" else ">")
        parts, each = [], 1 if self.planes else self.bands
        joined = self.planes and len(places) == self.across * self.down  # all planes of a block in one piece
        for plane in range(self.bands if self.planes else 1):
            k = ((0 if joined else plane) * self.down + j) * self.across + i
            raw = unpack(self.ranges.get(int(places[k]), int(sizes[k])))
            n = rows * self.block_columns * each
            part = np.frombuffer(raw, kind, n, plane * n * kind.itemsize if joined else 0).reshape(rows, self.block_columns, each).astype(kind.newbyteorder("="))
            if self.predictor == 2:  # each value is kept as its difference from the one to the left
                part = np.cumsum(part, axis=1, dtype=part.dtype)
            parts.append(part)
        pixels = np.concatenate(parts, 2) if self.planes else parts[0]
        return pixels[: self.rows - j * self.block_rows, : self.columns - i * self.block_columns]

    def pixels(self, window: tuple[int, int, int, int] | None = None) -> np.ndarray:
        """Pixels of a window inside the image, or of all of it, from the blocks under it alone."""
        x, y, w, h = window or (0, 0, self.columns, self.rows)
        if x < 0 or y < 0 or w < 0 or h < 0 or x + w > self.columns or y + h > self.rows:
            raise ValueError("a window beyond the image")
        out = np.zeros((h, w, self.bands), f"u{self.bits // 8}")
        for i, j in self.inside((x, y, w, h)):
            part, left, top = self.block(i, j), i * self.block_columns, j * self.block_rows
            a, b, c, d = max(x, left), max(y, top), min(x + w, left + part.shape[1]), min(y + h, top + part.shape[0])
            out[b - y : d - y, a - x : c - x] = part[b - top : d - top, a - left : c - left]
        return out


def encoded(data: bytes, rows: int, columns: int, bands: int, bounds: tuple[float, float, float, float] | None = None, tile: int | None = None, compression: str = "none", predictor: bool = False) -> bytes:
    """uint8 pixels, row by row, as a little-endian TIFF of one strip or of square tiles; bounds: x_min, x_max,
    y_min, y_max. With ``predictor`` each value is kept as its difference from the one to the left."""
    number, pack = WRITERS[compression]
    image = np.frombuffer(data, np.uint8).reshape(rows, columns, bands)
    side, parts = (tile, tile) if tile else (rows, columns), []
    for y in range(0, rows, max(side[0], 1)):
        for x in range(0, columns, max(side[1], 1)):
            part = image[y : y + side[0], x : x + side[1]]
            part = np.pad(part, [(0, side[0] - part.shape[0]), (0, side[1] - part.shape[1]), (0, 0)])
            if predictor:
                part = np.diff(part, axis=1, prepend=np.uint8(0))
            parts.append(pack(part.tobytes()))
    n, extra = len(parts), b""
    tags = [(WIDTH, 4, [columns]), (LENGTH, 4, [rows]), (BITS, 3, [8] * bands), (COMPRESSION, 3, [number]), (262, 3, [2 if bands > 2 else 1]), (SAMPLES, 3, [bands]), (PLANAR, 3, [1])]
    tags += [(PREDICTOR, 3, [2])] if predictor else []
    sizes = [len(p) for p in parts]
    tags += [(TILE_WIDTH, 3, [tile]), (TILE_LENGTH, 3, [tile]), (TILES, 4, [0] * n), (TILE_SIZES, 4, sizes)] if tile else [(STRIPS, 4, [0] * n), (ROWS, 4, [rows]), (SIZES, 4, sizes)]
    if bounds is not None:
        tags += [(SCALE, 12, [(bounds[1] - bounds[0]) / columns, (bounds[3] - bounds[2]) / rows, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, bounds[0], bounds[3], 0.0])]
    tags.sort()
    at_extra = 8 + 2 + 12 * len(tags) + 4
    wide = {3: "H", 4: "I", 12: "d"}
    lengths = [len(v) * struct.calcsize(wide[k]) for _, k, v in tags]
    start = at_extra + sum(x + x % 2 for x in lengths if x > 4)
    places = [start + sum(sizes[:k]) for k in range(n)] if n < 1000 else (start + np.concatenate([[0], np.cumsum(sizes)[:-1]])).tolist()
    table = struct.pack("<H", len(tags))
    for (tag, kind, values), length in zip(tags, lengths, strict=True):
        body = struct.pack(f"<{len(values)}{wide[kind]}", *(places if tag in (STRIPS, TILES) else values))
        if length <= 4:
            table += struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        else:
            table += struct.pack("<HHII", tag, kind, len(values), at_extra + len(extra))
            extra += body + b"\0" * (length % 2)
    return struct.pack("<2sHI", b"II", 42, 8) + table + struct.pack("<I", 0) + extra + b"".join(parts)
