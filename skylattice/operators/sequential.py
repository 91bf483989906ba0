"""Sequential mosaics: images are aligned, in order, with what earlier ones wrote; waves of cells on Spark."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import features, image_ops, tiles as ti
from .graph import components, cut, discard
from .image_ops import Operator
from .mosaic import overlap_pairs

OUT = "image_id long, order long, return_code string, x_off long, y_off long, x_size long, y_size long, duration double, data binary, log map<string,double>"
OUT_NAMES = [f.split()[0] for f in OUT.split(", ")]
#: Tiles along the side of a cell, at least, and bytes and number of images of a cell in one wave, at most.
CELL, CELL_BYTES, CELL_IMAGES = 16, 64 << 20, 256
#: Images of a wave up to this number are broadcast by id and cell, to pick their pixels without a shuffle.
BROADCAST_IMAGES = 100_000
#: Waves after which tiles that no later image touches are put aside and the others are written anew.
TIDY = 8
#: What training images, where none is aligned, are put before the others by.
TRAINED = 1 << 62
Aligner = Callable[[np.ndarray, np.ndarray], np.ndarray]
ALIGNED = image_ops.aligner_blender()


def fold_groups(images: DataFrame, tile: int = 256) -> DataFrame:
    """Adds ``component``: images whose windows overlap, directly or through others, share one."""
    parts = components(overlap_pairs(images, tile)).select(F.col("id").alias("image_id"), "component")
    return images.join(parts, "image_id", "left").withColumn("component", F.coalesce("component", "image_id"))


def fold_step(image: np.ndarray, held: np.ndarray, operator: Operator | None, strict: bool) -> tuple[str, np.ndarray | None, dict[str, float]]:
    """Return code of one image over its window, its pixels there (uint8), and what else its operator said."""
    out = operator(image, held) if operator and (strict or held.any()) else image_ops.blender(image, held)
    code, drawn = out["return_code"], out.get("image")
    log = {k: float(v) for k, v in out.items() if k not in ("return_code", "image")}
    return code, image_ops.pixels(drawn) if code == "success" and drawn is not None else None, log


def outcome(image_id: int, order: int, code: str, x: int, y: int, drawn: np.ndarray | None, log: dict[str, float], began: float) -> tuple:
    """A row of OUT: the box of what an image drew that isn't black, and the pixels in it."""
    place, data = (None,) * 4, None
    if drawn is not None:
        ys, xs = np.nonzero(drawn.sum(2, dtype=np.int64))
        if len(xs):
            a, b, c, d = xs.min(), xs.max() + 1, ys.min(), ys.max() + 1
            place, data = (int(x + a), int(y + c), int(b - a), int(d - c)), drawn[c:d, a:b].tobytes()
    return image_id, order, code, *place, time.perf_counter() - began, data, log


def runnable(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the first images of a cell in order, those that can be folded before any outside it: all their
    tiles lie in the cell, and none is under an earlier image that must wait."""
    taken: set[tuple[int, int]] = set()
    out = []
    for r in rows.sort_values(["order", "image_id"]).itertuples():
        own = {(x, y) for x in range(r.left, r.right + 1) for y in range(r.top, r.bottom + 1)}
        if r.inside and not own & taken:
            out.append((r.image_id, r.cell_x, r.cell_y))
        else:
            taken |= own
    return pd.DataFrame(out, columns=["image_id", "cell_x", "cell_y"])


def sequential_mosaic(images: DataFrame, tile: int = 256, align: bool = True, aligner: Aligner = features.align) -> DataFrame:
    """The outcomes of ``sequential_tiles``."""
    return sequential_tiles(images, tile, image_ops.aligner_blender(aligner) if align else None)[0]


def sequential_tiles(images: DataFrame, tile: int = 256, operator: Operator | None = ALIGNED) -> tuple[DataFrame, DataFrame]:
    """Aligns each image with what earlier ones (by ``order``, then ``image_id``) wrote in its window, and
    blends it in: black pixels of the mosaic take the image's.

    images: image_id, order, window (x_off, y_off, x_size, y_size) in the mosaic, rows, columns, bands,
    data (uint8, row by row), and ``training`` if there is a training mosaic. Its images are known to
    fill their windows and are drawn first, unaligned and set-based; all others are aligned within their
    windows (search zones), and where nothing lies there their code is ``dst_dark_frame``. Without
    that column an image that meets nothing is drawn as it stands, to begin a mosaic. An empty window
    is ``out_of_bounds``. ``operator`` (``image_ops``) places an image in its window; without one, images
    fill their windows whatever lies there, so all are drawn side by side and merged set-based.

    With an operator an image depends only on earlier ones that share a tile with it, so the flight is folded in waves.
    In a wave the plane is dealt into square cells, shifted by half a cell from one wave to the next in
    either direction. Of its first images in order a cell may fold those that lie inside it and meet no
    earlier image that must wait; which ones these are follows from windows alone. Then pixels and
    the tiles under them are sent to the cells, and what was written becomes new rows of the tile
    table. The first image that remains can always run in one of four waves, cells run side by side,
    and a task holds the images of one cell (bounded in number and bytes) and the tiles under them,
    however long or dense the flight is.

    Returns (one row per image: its code, its place after alignment, its warped pixels and the numbers
    its operator logged; the tiles of the mosaic).
    """
    strict = "training" in images.columns
    window = ["x_off", "y_off", "x_size", "y_size"]
    some = F.coalesce((F.col("x_size") > 0) & (F.col("y_size") > 0), F.lit(False))
    void = images.where(~some).select("image_id", "order", F.lit("out_of_bounds").alias("return_code"))
    known = images.where(some & F.col("training")) if strict else images.limit(0)
    rest = images.where(some & ~F.coalesce("training", F.lit(False))) if strict else images.where(some)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for r in batch.itertuples():
                began, image = time.perf_counter(), np.frombuffer(r.data, np.uint8).reshape(r.rows, r.columns, r.bands)
                code, drawn, log = fold_step(image, np.zeros((r.y_size, r.x_size, r.bands), np.uint8), None, strict)
                held.append(outcome(r.image_id, r.order, code, r.x_off, r.y_off, drawn, log, began))
                size += r.y_size * r.x_size * r.bands
                if size >= ti.HANDED_ON or len(held) >= 1000:
                    yield frame(held)
                    held, size = [], 0
        if held:
            yield frame(held)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=OUT_NAMES).astype({n: "Int64" for n in OUT_NAMES[3:7]})

    pixel = ["image_id", "order", *window, "rows", "columns", "bands", "data"]
    if operator is None:
        every = images.where(some)
        first = F.when(F.col("training"), F.col("order") - TRAINED).otherwise(F.col("order")) if strict else F.col("order")
        raster = ti.merged(ti.pieces(every.withColumn("order", first), tile), tile)
        return united([void, every.select(*pixel).mapInPandas(draw, OUT)]), raster
    done = [void, known.select(*pixel).mapInPandas(draw, OUT)]
    base = cut(ti.merged(ti.pieces(known, tile), tile)) if strict else images.sparkSession.createDataFrame([], ti.TILE)

    side, heavy = rest.agg(F.max(F.greatest("x_size", "y_size")), F.max(F.col("rows") * F.col("columns") * F.col("bands"))).first()
    cell = max(CELL, 2 * (-(-(side or 1) // tile) + 1))
    most = max(1, min(CELL_IMAGES, CELL_BYTES // max(heavy or 1, 1)))
    edge = {"left": F.floor(F.col("x_off") / tile), "top": F.floor(F.col("y_off") / tile), "right": F.floor((F.col("x_off") + F.col("x_size") - 1) / tile), "bottom": F.floor((F.col("y_off") + F.col("y_size") - 1) / tile)}
    waiting = cut(rest.select("image_id", "order", *window).withColumns(edge).drop(*window))
    rest = cut(rest.select(*pixel))  # each wave picks its images from it
    fresh: list[DataFrame] = []  # tiles of recent waves, which replace those before them
    aside: list[DataFrame] = []  # tiles that no waiting image touches

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        held = {(r["tile_x"], r["tile_y"]): (np.frombuffer(r["data"], np.uint8).reshape(tile, tile, r["bands"]).copy(), np.frombuffer(r["mask"], np.uint8).reshape(tile, tile).copy()) for r in right.to_pylist()}
        order, changed, out = left.sort_by([("order", "ascending"), ("image_id", "ascending")]), set(), []
        for i in range(order.num_rows):
            r, began = {n: order[n][i].as_py() for n in pixel}, time.perf_counter()
            x, y, w, h = (r[n] for n in window)
            canvas, under = np.zeros((h, w, r["bands"]), np.uint8), list(ti.cut_along(np.zeros((h, w, 0), np.uint8), x, y, tile))
            for tx, ty, a, b, part in under:
                if (tx, ty) in held:
                    u, v = tx * tile + a - x, ty * tile + b - y
                    canvas[v : v + part.shape[0], u : u + part.shape[1]] = held[tx, ty][0][b : b + part.shape[0], a : a + part.shape[1]]
            code, drawn, log = fold_step(np.frombuffer(r["data"], np.uint8).reshape(r["rows"], r["columns"], r["bands"]), canvas, operator, strict)
            out.append(outcome(r["image_id"], r["order"], code, x, y, drawn, log, began))
            for tx, ty, a, b, part in ti.cut_along(drawn, x, y, tile) if drawn is not None else ():
                data, mask = held.setdefault((tx, ty), (np.zeros((tile, tile, r["bands"]), np.uint8), np.zeros((tile, tile), np.uint8)))
                ti.lay(data, mask, part, a, b, False)
                changed.add((tx, ty))
        done = [dict(zip(OUT_NAMES, (*x[:-1], list(x[-1].items())), strict=True)) for x in out]
        wrote = [{"tile_x": k[0], "tile_y": k[1], "tile_bands": held[k][0].shape[2], "tile_data": held[k][0].tobytes(), "mask": held[k][1].tobytes()} for k in sorted(changed)]
        return pa.Table.from_pylist(done + wrote, schema=mixed)

    mixed = pa.schema([("image_id", pa.int64()), ("order", pa.int64()), ("return_code", pa.string()), *((n, pa.int64()) for n in window), ("duration", pa.float64()), ("data", pa.binary()), ("log", pa.map_(pa.string(), pa.float64())), ("tile_x", pa.int64()), ("tile_y", pa.int64()), ("tile_bands", pa.int32()), ("tile_data", pa.binary()), ("mask", pa.binary())])

    def latest() -> DataFrame:
        """The newest row of each tile: of the recent waves', by wave, or else of those before."""
        if not fresh:
            return base
        every = base.withColumn("wave", F.lit(-1))
        for i, x in enumerate(fresh):
            every = every.unionByName(x.withColumn("wave", F.lit(i)))
        newest = every.groupBy("tile_x", "tile_y").agg(F.max("wave").alias("wave"))
        return every.join(newest, ["tile_x", "tile_y", "wave"], "left_semi").drop("wave")

    spans = lambda df: df.withColumn("tile_x", F.explode(F.sequence("left", "right"))).withColumn("tile_y", F.explode(F.sequence("top", "bottom")))
    wave = 0
    while not waiting.isEmpty():
        dx, dy = (cell // 2 * (wave % 2), cell // 2 * (wave // 2 % 2))
        at = lambda name, d: F.floor((F.col(name) + d) / cell)
        touched = waiting.withColumn("inside", (at("left", dx) == at("right", dx)) & (at("top", dy) == at("bottom", dy)))
        touched = touched.withColumn("cell_x", F.explode(F.sequence(at("left", dx), at("right", dx)))).withColumn("cell_y", F.explode(F.sequence(at("top", dy), at("bottom", dy))))
        first = F.row_number().over(Window.partitionBy("cell_x", "cell_y").orderBy("order", "image_id"))
        now = touched.withColumn("_r", first).where(F.col("_r") <= most).drop("_r")
        now = cut(now.groupBy("cell_x", "cell_y").applyInPandas(runnable, "image_id long, cell_x long, cell_y long"))
        wave += 1
        n = now.count()
        if not n:
            discard(now)
            continue
        few = F.broadcast if n <= BROADCAST_IMAGES else lambda df: df
        needed = spans(waiting.join(now, "image_id")).select("tile_x", "tile_y", F.col("cell_x").alias("to_x"), F.col("cell_y").alias("to_y")).distinct()
        under = latest().join(few(needed), ["tile_x", "tile_y"])
        ready = rest.join(few(now), "image_id")
        made = cut(ready.groupBy("cell_x", "cell_y").cogroup(under.groupBy("to_x", "to_y")).applyInArrow(fold, ", ".join([OUT, "tile_x long, tile_y long, tile_bands int, tile_data binary, mask binary"])))
        done.append(made.where("image_id is not null").select(*OUT_NAMES))
        fresh.append(made.where("image_id is null").select("tile_x", "tile_y", F.col("tile_bands").alias("bands"), F.col("tile_data").alias("data"), "mask"))
        before, waiting = waiting, cut(waiting.join(now.select("image_id"), "image_id", "left_anti"))
        discard(before)
        discard(now)
        if len(fresh) == TIDY:
            left = spans(waiting).select("tile_x", "tile_y").distinct()
            aside.append(cut(latest().join(left, ["tile_x", "tile_y"], "left_anti")))
            base, fresh = cut(latest().join(left, ["tile_x", "tile_y"], "left_semi")), []
            done = [*done[:2], cut(united(done[2:]))]
            before, rest = rest, cut(rest.join(waiting.select("image_id"), "image_id", "left_semi"))
            discard(before)
    return united(done), united([*aside, latest()])


def united(tables: list[DataFrame]) -> DataFrame:
    first, *rest = tables
    for x in rest:
        first = first.unionByName(x, allowMissingColumns=True)
    return first.select(*OUT_NAMES) if "return_code" in first.columns else first


