"""Set-based mosaics: extent, pixel rectangles, first-non-empty blend, tile windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import kernels
from ..functions.geo import to_pixels
from .quantiles import exact_quantiles

EMPTY_RASTER = {"x_min": 0.0, "x_max": 0.0, "y_min": 0.0, "y_max": 0.0, "pixel_width": 1.0, "pixel_height": -1.0, "x_size": 0, "y_size": 0}


def extent(rows: DataFrame) -> DataFrame:
    """One row: bounds with the largest padding, median pixel size, raster size and the pixel size that fits."""
    pad = F.coalesce(F.max("padding"), F.lit(0.0))
    one = rows.agg(
        (F.min("x_min") - pad).alias("x_min"), (F.max("x_max") + pad).alias("x_max"), (F.min("y_min") - pad).alias("y_min"), (F.max("y_max") + pad).alias("y_max"),
    )
    one = one.crossJoin(exact_quantiles(rows, {"_w": ("pixel_width", 0.5), "_h": ("pixel_height", 0.5)}))  # one row each
    one = one.withColumns({"x_size": F.rint((F.col("x_max") - F.col("x_min")) / F.col("_w")).cast("long"), "y_size": F.rint((F.col("y_min") - F.col("y_max")) / F.col("_h")).cast("long")})
    return one.withColumns({"pixel_width": (F.col("x_max") - F.col("x_min")) / F.col("x_size"), "pixel_height": (F.col("y_min") - F.col("y_max")) / F.col("y_size")}).drop("_w", "_h")


def pixel_rectangles(rows: DataFrame, raster: dict[str, float]) -> DataFrame:
    return rows.withColumns(to_pixels(raster))


def blend(pixels: DataFrame, bands: list[str], alpha: str | None = None, fill: float = 255) -> DataFrame:
    """Mosaic of contributions (x, y, order, bands): colours of the first one that isn't black.

    With an ``alpha`` band of the sources, a pixel keeps the alpha of its first colour, or, where all
    are black, of the latest; without one, every written pixel is ``fill``. One aggregation over
    (x, y) with partial results, whatever number of images overlap.
    """
    colour = sum((F.col(b) for b in bands[1:]), F.col(bands[0]))
    lit = F.when(colour > 0, F.struct(*bands, *([alpha] if alpha else [])))
    first = F.min_by(lit, F.when(colour > 0, F.col("order"))).alias("_f")
    last = [F.max_by(alpha, "order").alias("_a")] if alpha else []
    one = pixels.groupBy("x", "y").agg(first, *last)
    end = F.coalesce(F.col(f"_f.{alpha}"), F.col("_a")) if alpha else F.lit(fill)
    return one.select("x", "y", *(F.coalesce(F.col(f"_f.{b}"), F.lit(0)).alias(b) for b in bands), end.alias(alpha or "alpha"))


def resampled(images: DataFrame, bands: list[str]) -> DataFrame:
    """Pixels (image_id, order, x, y, bands) of images on a mosaic's grid: each image (rows, columns, bands,
    data: uint8) is resized to its pixel rectangle (x_off, y_off, x_size, y_size)."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                if r.x_size < 1 or r.y_size < 1:
                    continue
                m = kernels.resize(np.frombuffer(r.data, np.uint8).reshape(r.rows, r.columns, r.bands).astype(float), r.y_size, r.x_size)
                y, x = np.divmod(np.arange(r.y_size * r.x_size), r.x_size)
                yield pd.DataFrame({"image_id": r.image_id, "order": r.order, "x": r.x_off + x, "y": r.y_off + y} | {b: m[..., i].ravel().round().astype(np.int32) for i, b in enumerate(bands)})

    schema = "image_id long, order long, x long, y long, " + ", ".join(f"`{b}` int" for b in bands)
    return images.select("image_id", "order", "x_off", "y_off", "x_size", "y_size", "rows", "columns", "bands", "data").mapInPandas(task, schema)


def filled(pixels: DataFrame, rect: tuple[int, int, int, int], bands: list[str]) -> DataFrame:
    """Every pixel of a window; those that nothing has written are 0, as in an empty raster."""
    x, y, w, h = rect
    spark = pixels.sparkSession
    grid = spark.range(w * h).select((F.lit(x) + F.col("id") % w).alias("x"), (F.lit(y) + F.floor(F.col("id") / w)).alias("y"))
    return grid.join(read_window(pixels, rect), ["x", "y"], "left").select("x", "y", *(F.coalesce(b, F.lit(0)).alias(b) for b in bands))


def write_window(pixels: DataFrame, patch: DataFrame, rect: tuple[int, int, int, int]) -> DataFrame:
    """The raster with a window replaced by the patch, whose pixels (x, y) count from the window's corner;
    pixels of the patch beyond the window are left out."""
    x, y, w, h = rect
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    moved = patch.where(F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1)).withColumns({"x": F.col("x") + x, "y": F.col("y") + y})
    return pixels.where(~inside).unionByName(moved)


def tiles_of(rows: DataFrame, tile: int, window: tuple[str, str, str, str] = ("x_off", "y_off", "x_size", "y_size")) -> DataFrame:
    """One row per tile that a pixel rectangle touches; empty rectangles touch none."""
    x, y, w, h = (F.col(c) for c in window)
    full = rows.where((w > 0) & (h > 0))
    full = full.withColumn("tile_x", F.explode(F.sequence(F.floor(x / tile), F.floor((x + w - 1) / tile))))
    return full.withColumn("tile_y", F.explode(F.sequence(F.floor(y / tile), F.floor((y + h - 1) / tile))))


def read_window(pixels: DataFrame, rect: tuple[int, int, int, int]) -> DataFrame:
    """Pixels of (x_off, y_off, x_size, y_size); a range filter that reaches the scan."""
    x, y, w, h = rect
    return pixels.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))


def overlap_pairs(rows: DataFrame, tile: int, key: str = "image_id") -> DataFrame:
    """Pairs (a, b) of rectangles that share a pixel, by joining on shared tiles."""
    t = tiles_of(rows, tile).select("tile_x", "tile_y", key, "x_off", "y_off", "x_size", "y_size")
    a, b = (t.select("tile_x", "tile_y", *(F.col(c).alias(f"{s}_{c}") for c in (key, "x_off", "y_off", "x_size", "y_size"))) for s in "ab")
    meet = (F.col("a_x_off") < F.col("b_x_off") + F.col("b_x_size")) & (F.col("b_x_off") < F.col("a_x_off") + F.col("a_x_size"))
    meet &= (F.col("a_y_off") < F.col("b_y_off") + F.col("b_y_size")) & (F.col("b_y_off") < F.col("a_y_off") + F.col("a_y_size"))
    return a.join(b, ["tile_x", "tile_y"]).where((F.col(f"a_{key}") < F.col(f"b_{key}")) & meet).select(F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b")).distinct()


def similarity(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Normalised correlation coefficient per key of two sets of pixels (keys, band, i, value), bands
    centred each by its own mean, over pixels where neither side is 0."""
    both = a.join(b.withColumnRenamed("value", "_w"), [*keys, "band", "i"]).where("value <> 0 and _w <> 0")
    per_band = both.groupBy(*keys, "band").agg(F.count("*").alias("n"), F.sum("value").alias("x"), F.sum("_w").alias("y"), F.sum(F.col("value") * F.col("_w")).alias("xy"), F.sum(F.col("value") ** 2).alias("xx"), F.sum(F.col("_w") ** 2).alias("yy"))
    cross, left, right = F.sum(F.expr("xy - x * y / n")), F.sum(F.expr("xx - x * x / n")), F.sum(F.expr("yy - y * y / n"))
    return per_band.groupBy(*keys).agg(F.when((left > 0) & (right > 0), cross / F.sqrt(left * right)).alias("score"))


def first_failure(rows: DataFrame, ok: str = "ok") -> DataFrame:
    return rows.agg(F.min(F.when(~F.col(ok), F.col("order"))).alias("first_failure"))


def running(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds the number of rows up to each one in its group's order."""
    return rows.withColumn("n_before", F.count("*").over(Window.partitionBy(*by).orderBy("order").rowsBetween(Window.unboundedPreceding, 0)))
