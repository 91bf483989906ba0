"""Rasters as tables of square tiles: images cut along tiles, and an ordered, associative merge of the pieces.

A piece is the part of an image inside a tile: tile_x, tile_y, order, image_id, its rectangle within the tile
(x, y, w, h), bands, and data (uint8, row by row). A raster has one row a tile: tile_x, tile_y, bands, data
of the whole tile, and mask (255 where anything was written).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels

PIECE = "tile_x long, tile_y long, order long, image_id long, x int, y int, w int, h int, bands int, data binary"
TILE = "tile_x long, tile_y long, bands int, data binary, mask binary"
#: Orders of one block, whose pieces of a tile are merged before blocks are.
BLOCK = 64
#: Bytes of pixels after which a task hands its pieces on.
HANDED_ON = 4 << 20


def cut_along(image: np.ndarray, x_off: int, y_off: int, tile: int) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(tile_x, tile_y, x, y, part) of an image that lies at (x_off, y_off)."""
    h, w = image.shape[:2]
    for ty in range(y_off // tile, (y_off + h - 1) // tile + 1):
        for tx in range(x_off // tile, (x_off + w - 1) // tile + 1):
            x, y = max(x_off, tx * tile), max(y_off, ty * tile)
            part = image[y - y_off : min(y_off + h, (ty + 1) * tile) - y_off, x - x_off : min(x_off + w, (tx + 1) * tile) - x_off]
            yield tx, ty, x - tx * tile, y - ty * tile, part


def pieces(images: DataFrame, tile: int) -> DataFrame:
    """Images (image_id, order, rows, columns, bands, data: uint8) resized to their pixel rectangles (x_off, y_off,
    x_size, y_size) and cut along tiles, and handed on by bytes. Empty rectangles have none."""
    frame = lambda rows: pd.DataFrame(rows, columns=[f.split()[0] for f in PIECE.split(", ")])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, size = [], 0
        for batch in batches:
            for r in batch.itertuples():
                if r.x_size < 1 or r.y_size < 1:
                    continue
                image = np.frombuffer(r.data, np.uint8).reshape(r.rows, r.columns, r.bands)
                if image.shape[:2] != (r.y_size, r.x_size):
                    image = kernels.resize(image.astype(float), r.y_size, r.x_size).round().astype(np.uint8)
                found += [(tx, ty, r.order, r.image_id, x, y, p.shape[1], p.shape[0], r.bands, p.tobytes()) for tx, ty, x, y, p in cut_along(image, r.x_off, r.y_off, tile)]
                size += image.nbytes
                if size >= HANDED_ON or len(found) >= 1000:
                    yield frame(found)
                    found, size = [], 0
        if found:
            yield frame(found)

    return images.select("image_id", "order", "x_off", "y_off", "x_size", "y_size", "rows", "columns", "bands", "data").mapInPandas(task, PIECE)


def lay(data: np.ndarray, mask: np.ndarray, part: np.ndarray, x: int, y: int, alpha: bool, covered: np.ndarray | None = None) -> None:
    """Puts a later piece under what a tile has: its colours where the tile has none. With ``alpha`` the last
    band goes with the colours and is the latest one where all are black; ``covered`` is where the
    piece, if it is itself merged, has anything."""
    h, w = part.shape[:2]
    held, seen = data[y : y + h, x : x + w], mask[y : y + h, x : x + w]
    covered = np.ones((h, w), bool) if covered is None else covered > 0
    free = (held[..., : held.shape[2] - alpha].sum(2, dtype=np.int64) == 0) & covered
    held[free] = part[free]
    seen[covered] = 255


def merged(parts: DataFrame, tile: int, alpha: bool = False) -> DataFrame:
    """The raster of all pieces, in order of (order, image_id): the first that isn't black wins.

    The merge is associative, so pieces are merged by tile and block of orders first and the blocks'
    tiles next: a tile under very many images spreads over as many tasks as it has blocks. Each task
    holds one tile and one piece.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, data, mask, out = None, None, None, pa.schema([("tile_x", pa.int64()), ("tile_y", pa.int64()), ("block", pa.int64()), ("bands", pa.int32()), ("data", pa.binary()), ("mask", pa.binary())])

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(out.names, (*at, data.shape[2], data.tobytes(), mask.tobytes()), strict=True))], out)

        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch[n][i].as_py() for n in batch.schema.names}
                key = (r["tile_x"], r["tile_y"], r["block"])
                if key != at:
                    if at is not None:
                        yield row()
                    at, data, mask = key, np.zeros((tile, tile, r["bands"]), np.uint8), np.zeros((tile, tile), np.uint8)
                part = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"], r["bands"])
                lay(data, mask, part, r["x"], r["y"], alpha, np.frombuffer(r["mask"], np.uint8).reshape(tile, tile) if r["mask"] else None)
        if at is not None:
            yield row()

    def round_of(rows: DataFrame, *sort: str) -> DataFrame:
        rows = rows.repartition("tile_x", "tile_y", "block").sortWithinPartitions("tile_x", "tile_y", "block", *sort)
        return rows.select("tile_x", "tile_y", "block", "x", "y", "w", "h", "bands", "data", "mask").mapInArrow(task, "tile_x long, tile_y long, block long, bands int, data binary, mask binary")

    first = round_of(parts.withColumns({"block": F.floor(F.col("order") / BLOCK), "mask": F.lit(None).cast("binary")}), "order", "image_id")
    whole = {"x": F.lit(0), "y": F.lit(0), "w": F.lit(tile), "h": F.lit(tile)}
    then = round_of(first.withColumns(whole).withColumns({"place": F.col("block"), "block": F.lit(0).cast("long")}), "place")
    return then.select("tile_x", "tile_y", "bands", "data", "mask")


def pixels_of(raster: DataFrame, tile: int, names: list[str]) -> DataFrame:
    """A row for each written pixel: x, y and the named bands."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                y, x = np.nonzero(np.frombuffer(r.mask, np.uint8).reshape(tile, tile))
                data = np.frombuffer(r.data, np.uint8).reshape(tile, tile, r.bands)[y, x].astype(np.int32)
                yield pd.DataFrame({"x": r.tile_x * tile + x, "y": r.tile_y * tile + y} | {n: data[:, i] for i, n in enumerate(names)})

    return raster.select("tile_x", "tile_y", "bands", "data", "mask").mapInPandas(task, "x long, y long, " + ", ".join(f"`{n}` int" for n in names))


def window(raster: DataFrame, rect: tuple[int, int, int, int], tile: int) -> DataFrame:
    """The tiles under (x_off, y_off, x_size, y_size); a range filter that reaches the scan."""
    x, y, w, h = rect
    return raster.where(F.col("tile_x").between(x // tile, (x + w - 1) // tile) & F.col("tile_y").between(y // tile, (y + h - 1) // tile))


SUMS = "image_id long, band int, n double, x double, y double, xy double, xx double, yy double"


def scores(images: DataFrame, raster: DataFrame, tile: int) -> DataFrame:
    """(image_id, score): normalised correlation coefficient of each image with the raster under it, bands
    centred each by its own mean, over values where neither is 0; null without two such values.

    Images are cut along tiles, and each piece meets its tile once; what is sent on are six sums a piece
    and band, which an aggregation with partial results adds up.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                part = np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, r.bands).astype(float)
                under = np.frombuffer(r.under, np.uint8).reshape(tile, tile, r.bands)[r.y : r.y + r.h, r.x : r.x + r.w].astype(float)
                for b in range(r.bands):
                    both = (part[..., b] != 0) & (under[..., b] != 0)
                    u, v = part[..., b][both], under[..., b][both]
                    rows.append((r.image_id, b, float(len(u)), u.sum(), v.sum(), (u * v).sum(), (u * u).sum(), (v * v).sum()))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in SUMS.split(", ")])

    met = pieces(images, tile).join(raster.select("tile_x", "tile_y", F.col("data").alias("under")), ["tile_x", "tile_y"])
    sums = met.select("image_id", "x", "y", "w", "h", "bands", "data", "under").mapInPandas(task, SUMS)
    per_band = sums.groupBy("image_id", "band").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xy", "xx", "yy"))).where("n > 0")
    cross, left, right = F.sum(F.expr("xy - x * y / n")), F.sum(F.expr("xx - x * x / n")), F.sum(F.expr("yy - y * y / n"))
    return per_band.groupBy("image_id").agg(F.when((left > 0) & (right > 0), cross / F.sqrt(left * right)).alias("score"))
