"""TIFF files as a Spark data source: rows of images from their headers, or rows of blocks under a window.

``register(spark)``, then ``spark.read.format("tiff").option("rows", "images" or "blocks").load(path)``.
A schema given by hand prunes columns: pixels are only read where ``data`` is asked for. Conditions on
``filepath`` leave files out when partitions are planned, and conditions on ``block_x`` and ``block_y``, and
the option ``window`` ("x,y,w,h"), leave blocks unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from .tiff import Ranges, Tiff, located

IMAGES = "filepath string, x_min double, x_max double, y_min double, y_max double, pixel_width double, pixel_height double, x_size long, y_size long, bands int, bits int, compression int, block_columns int, block_rows int, bytes_read long"
BLOCKS = "filepath string, block_x int, block_y int, x_off long, y_off long, rows int, columns int, bands int, data binary, bytes_read long"
#: Bytes of files of a partition, at most, unless one file has more.
PART_BYTES = 128 << 20
TESTS = {
    EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, StringStartsWith: lambda v, x: v.startswith(x), StringEndsWith: lambda v, x: v.endswith(x), StringContains: lambda v, x: x in v,
    GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
}


class Part(InputPartition):
    """Files that one task reads."""

    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


def header(path: str) -> dict:
    """The row of IMAGES of one file; nulls where it cannot be read."""
    row = {"filepath": path}
    ranges = None
    try:
        ranges = Ranges(path)
        t = Tiff(ranges, header=True)
        row |= {"x_size": t.columns, "y_size": t.rows, "bands": t.bands, "bits": t.bits, "compression": t.compression, "block_columns": t.block_columns, "block_rows": t.block_rows}
        b = t.bounds()
        if b:
            row |= dict(zip(("x_min", "x_max", "y_min", "y_max"), b, strict=True)) | {"pixel_width": (b[1] - b[0]) / t.columns, "pixel_height": (b[2] - b[3]) / t.rows}
    except (ValueError, KeyError, IndexError, ZeroDivisionError, OSError):
        row = {"filepath": path}
    if ranges:
        row["bytes_read"] = ranges.read
        ranges.close()
    return row


class TiffReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.options, self.tests = schema.names, options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """What is known of a file or block before its pixels are read."""
        for f in filters:
            if type(f) in TESTS and f.attribute in (("filepath",), ("block_x",), ("block_y",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            yield f  # Spark checks again

    def passes(self, **known: object) -> bool:
        return all(TESTS[kind](known[name], value) for name, kind, value in self.tests if name in known)

    def partitions(self) -> Sequence[InputPartition]:
        path = self.options["path"]
        system, place = located(path)
        info = system.get_file_info(place)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True))
        pattern, head = re.compile(self.options.get("pattern", r"\.tiff?$")), path[: path.index(place)] if place in path else ""
        parts, size = [], 0
        for f in sorted(found, key=lambda f: f.path):
            name = head + f.path
            if f.type == fs.FileType.File and pattern.search(name) and self.passes(filepath=name):
                if not parts or size + f.size > int(self.options.get("part_bytes", PART_BYTES)):
                    parts.append([])
                    size = 0
                parts[-1].append(name)
                size += f.size
        return [Part(p) for p in parts] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        window = tuple(int(x) for x in self.options["window"].split(",")) if "window" in self.options else None
        for path in partition.paths:
            if self.options.get("rows", "images") == "images":
                row = header(path)
                yield tuple(row.get(n) for n in self.names)
                continue
            ranges = Ranges(path)
            t = Tiff(ranges)
            for i, j in t.inside(window):
                if not self.passes(block_x=i, block_y=j):
                    continue
                row = {"filepath": path, "block_x": i, "block_y": j, "x_off": i * t.block_columns, "y_off": j * t.block_rows, "rows": min(t.block_rows, t.rows - j * t.block_rows), "columns": min(t.block_columns, t.columns - i * t.block_columns), "bands": t.bands}
                before = ranges.read
                if "data" in self.names:
                    row["data"] = np.ascontiguousarray(t.block(i, j)).tobytes()
                row["bytes_read"] = ranges.read - before
                yield tuple(row.get(n) for n in self.names)
            ranges.close()


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return BLOCKS if self.options.get("rows") == "blocks" else IMAGES

    def reader(self, schema: StructType) -> TiffReader:
        return TiffReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)
