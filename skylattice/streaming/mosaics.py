"""Mosaics of flights that go on: tiles are keyed state, so new images only touch the tiles under them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import tiles as ti

TILE = "tile_x long, tile_y long, bands int, data binary, mask binary, version long"
#: Where tiles of a run are kept; the only one that keeps several values a key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NONE = np.iinfo(np.int64).max


class TileState(StatefulProcessor):
    """A tile's pixels, what was written, and the order of the image each pixel came from."""

    def __init__(self, tile: int):
        self.tile = tile

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("tile", "bands int, data binary, mask binary, ranks binary, version long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        side, data = (self.tile, self.tile), None
        if self.held.exists():
            bands, raw, seen, order, version = self.held.get()
            data, mask, ranks = (np.frombuffer(x, k).reshape(*side, *more).copy() for x, k, more in ((raw, np.uint8, (bands,)), (seen, np.uint8, ()), (order, np.int64, ())))
        for part in rows:
            for r in part.itertuples():
                if data is None:
                    data, mask, ranks, version = np.zeros((*side, r.bands), np.uint8), np.zeros(side, np.uint8), np.full(side, NONE), 0
                image = np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, r.bands)
                at = (slice(r.y, r.y + r.h), slice(r.x, r.x + r.w))
                first = (image.sum(2, dtype=np.int64) > 0) & (r.order < ranks[at])
                data[at][first], ranks[at][first], mask[at] = image[first], r.order, 255
        if data is not None:
            whole = (int(data.shape[2]), data.tobytes(), mask.tobytes(), ranks.tobytes(), int(version) + 1)
            self.held.update(whole)
            yield pd.DataFrame([(*key, *whole[:3], whole[4])], columns=[f.split()[0] for f in TILE.split(", ")])

    def close(self) -> None:
        pass


def mosaic_updates(images: DataFrame, tile: int = 256) -> DataFrame:
    """The tiles that each batch of a stream of images changes, with a version that grows.

    images: as ``tiles.pieces`` takes them. A pixel shows the image of the least ``order`` that isn't black
    there, whenever it came: the state keeps the order of what it shows, so late images fall into
    place and a flight may be cut into batches and runs in any way. A task holds one tile and one
    piece. Orders are unique among images that overlap.
    """
    images.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return ti.pieces(images, tile).groupBy("tile_x", "tile_y").transformWithStateInPandas(TileState(tile), TILE, "Append", "None")


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The raster as it stands: the last version of each tile that was stored."""
    rows = spark.read.schema(TILE).parquet(path)
    last = rows.groupBy("tile_x", "tile_y").agg(F.max("version").alias("version"))
    return rows.join(last, ["tile_x", "tile_y", "version"], "left_semi").drop("version")
