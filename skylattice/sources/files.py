"""Finding and loading files through Spark's readers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .tiff import Ranges, Tiff
from .tiff_source import header


def find_files(spark: SparkSession, directory: str) -> DataFrame:
    """All files below a directory; names only, no content is read. A missing directory is an error."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select(F.col("path").alias("filepath"))


def select_files(files: DataFrame, extension: str | list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """Files whose path contains ``pattern``, anything, and ends in the extension (a regular expression,
    or several); numbered from 0 by path."""
    from ..operators.order import ordered

    end = "" if not extension else f"({'|'.join([extension] if isinstance(extension, str) else extension)})"
    kept = files.where(F.col("filepath").rlike(f"{pattern or ''}.*{end}$"))
    return ordered(kept, [], "filepath").select(F.col("order").alias("file_id"), "filepath")


def find_selected_files(spark: SparkSession, directory: str, extension: str | list[str] | None = None, pattern: str | None = None) -> DataFrame:
    return select_files(find_files(spark, directory), extension, pattern)


def find_input_files(spark: SparkSession, description: str | dict, root: str = "") -> str | DataFrame:
    """A path below ``root`` (not checked), or the files of {directory, extension, pattern}."""
    if isinstance(description, str):
        return f"{root.rstrip('/')}/{description}" if root else description
    if "directory" not in description:
        raise ValueError("a description of input files needs a directory")
    return find_selected_files(spark, find_input_files(spark, description["directory"], root), description.get("extension"), description.get("pattern"))


def as_files(spark: SparkSession, files: DataFrame | Iterable[str]) -> DataFrame:
    """A table with ``filepath``: one that has the column, one whose only column holds paths, or a list
    or series of paths. Other columns stay."""
    if not isinstance(files, DataFrame):
        return spark.createDataFrame([(str(f),) for f in files], "filepath string")
    if "filepath" in files.columns:
        return files
    if len(files.columns) != 1:
        raise ValueError(f"no column filepath in {files.columns}")
    return files.withColumnRenamed(files.columns[0], "filepath")


def discover_directory(spark: SparkSession, directory: str, globs: str | list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """Files below a directory whose names match a glob, one glob after another, so a file that matches
    several is listed for each; by default those with a dot. ``pattern``: a regular expression
    that the path must hold besides."""
    parts = []
    for glob in ["*.*"] if globs is None else [globs] if isinstance(globs, str) else globs:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(directory)
        parts.append(found.select(F.col("path").alias("filepath")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("filepath").rlike(pattern)) if pattern else out


def discover(files: DataFrame, patterns: str | list[str] | None = None) -> DataFrame:
    """Files that match any of the patterns; one that matches several is listed for each."""
    if patterns is None:
        patterns = r"\.[^/]*$"
    parts = [files.where(F.col("filepath").rlike(p)).select("filepath") for p in ([patterns] if isinstance(patterns, str) else patterns)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def cached_or(spark: SparkSession, path: str, compute, use_cached: bool = True) -> DataFrame:
    """The table stored at ``path`` if there is one, else the computed table, which is stored there.

    Rows are matched by what they hold, so a stored table is only used whole.
    """
    if use_cached:
        try:
            return spark.read.parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def tiff_pixels(data: bytes) -> np.ndarray:
    """Pixels (rows, columns, bands) of a TIFF of strips or tiles."""
    return Tiff(Ranges(data)).pixels()


def rescaled(pixels: np.ndarray, kind: str) -> np.ndarray:
    """Pixels of another type, with the largest value of one type on that of the other; floats are 0 to 1."""
    top = lambda t: 1.0 if t.kind == "f" else float(np.iinfo(t).max)
    to = np.dtype(kind)
    if pixels.dtype == to:
        return pixels
    out = pixels.astype(np.float64) / top(pixels.dtype) * top(to)
    return out.astype(to) if to.kind == "f" else out.round().astype(to)


def raw_pixels(data: bytes, rows: int = 1200, columns: int = 1920, bits: int = 12) -> np.ndarray:
    """RGB of a raw RGGB sensor image, scaled to 8 bits.

    Each colour is known at some sites; elsewhere it is the mean of the nearest ones that have it: two beside,
    or four around, by bilinear weights over shifted planes. The border is mirrored, so sites keep
    their colours.
    """
    sensor = np.pad(np.frombuffer(data, "<u2").reshape(rows, columns).astype(np.float64), 1, "reflect")
    y, x = np.mgrid[-1 : rows + 1, -1 : columns + 1] % 2
    out = np.empty((rows, columns, 3))
    for band, site in enumerate(((y == 0) & (x == 0), y != x, (y == 1) & (x == 1))):
        value = weight = 0.0
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                w = (2 - abs(dy)) * (2 - abs(dx)) if band != 1 else 1 - abs(dy * dx)
                part = (slice(1 + dy, rows + 1 + dy), slice(1 + dx, columns + 1 + dx))
                value, weight = value + w * np.where(site, sensor, 0)[part], weight + w * site[part]
        if band == 1:  # green keeps its own sites
            value, weight = np.where(site[1:-1, 1:-1], sensor[1:-1, 1:-1], value), np.where(site[1:-1, 1:-1], 1, weight)
        out[..., band] = value / weight
    return (out / ((1 << bits) - 1) * 255).astype(np.uint8)


HEADER = "filepath string, x_min double, x_max double, y_min double, y_max double, pixel_width double, pixel_height double, x_rot double, y_rot double, x_size long, y_size long"


def geotiff_headers(files: DataFrame, padding_fraction: float = 0.1) -> DataFrame:
    """Bounds, centre and padding of each image of a ``binaryFile`` table, whose content is not read: tags come by
    ranges of the file. An unreadable file, or one without a model, is a row of nulls."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in HEADER.split(", ")]
        for batch in batches:
            rows = [header(path) for path in batch["path"]]
            rows = [(r["filepath"], *(r.get(n) if "x_min" in r else None for n in names[1:7]), *((0.0, 0.0, r["x_size"], r["y_size"]) if "x_min" in r else [None] * 4)) for r in rows]
            yield pd.DataFrame(rows, columns=names).astype({"x_size": "Int64", "y_size": "Int64"})

    from ..functions import geo

    c = F.col
    out = files.select("path").mapInPandas(task, HEADER)
    return out.withColumns({"x_center": geo.centre(c("x_min"), c("x_max")), "y_center": geo.centre(c("y_min"), c("y_max")), "padding": geo.padding(c("x_min"), c("x_max"), c("y_min"), c("y_max"), padding_fraction)})


#: Bytes of pixels that are handed on at once.
HANDED_ON = 32 << 20


def in_parts(rows: Iterator[tuple], names: list[str], most: int = HANDED_ON) -> Iterator[pd.DataFrame]:
    """Frames of a few images, by the bytes of their pixels (column ``data``, which may be null), so that a task
    never holds the decoded images of a whole batch."""
    held, size, at = [], 0, names.index("data")
    for row in rows:
        held.append(row)
        size += len(row[at] or b"")
        if size >= most:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)


PIXELS = "filepath string, rows long, columns long, bands long, data binary"


def load_images(files: DataFrame, raw_shape: tuple[int, int] = (1200, 1920), kind: str | None = None) -> DataFrame:
    """Pixels of a ``binaryFile`` table as bytes, row by row; ``.raw`` and ``.tif``/``.tiff`` only.
    ``kind``: a NumPy type all images are rescaled to, else each keeps its own."""

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                end = path.rpartition(".")[2].lower()
                if end not in ("raw", "tif", "tiff"):
                    raise OSError(f"cannot read images of type {end!r}")
                m = raw_pixels(data, *raw_shape) if end == "raw" else tiff_pixels(data)
                m = rescaled(m, kind) if kind else m
                yield path, *m.shape, np.ascontiguousarray(m).tobytes()

    return files.select("path", "content").mapInPandas(lambda batches: in_parts(decoded(batches), [f.split()[0] for f in PIXELS.split(", ")]), PIXELS)


REFERENCED = PIXELS + ", x_min double, x_max double, y_min double, y_max double"


def load_referenced(files: DataFrame, source: str = "EPSG:3857", target: str | None = None) -> DataFrame:
    """Pixels (uint8) and bounds of each georeferenced TIFF of a ``binaryFile`` table, in one row a file; a
    file without a reference has null bounds.

    With another ``target`` system of ``functions.projection``, bounds are transformed and the pixels are
    resampled (``kernels.reprojected``).
    """

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                t = Tiff(Ranges(data))
                m, bounds = rescaled(t.pixels(), "u1"), t.bounds() or [None] * 4
                if t.bounds() and target and target != source:
                    m, bounds = kernels.reprojected(m, bounds, source, target)
                yield path, *m.shape, np.ascontiguousarray(m).tobytes(), *bounds

    from ..operators import kernels

    return files.select("path", "content").mapInPandas(lambda batches: in_parts(decoded(batches), [f.split()[0] for f in REFERENCED.split(", ")]), REFERENCED)

