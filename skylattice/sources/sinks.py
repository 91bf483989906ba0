"""Writers and the policy for outputs that exist."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import yaml
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F


def free_path(df: DataFrame, path: str, policy: str = "error") -> tuple[str, str]:
    """(path, write mode) under a policy: error, pass or load (keep what is there), overwrite, or new
    (a version ``_v000`` and up that doesn't exist yet)."""
    modes = {"error": "errorifexists", "pass": "ignore", "load": "ignore", "overwrite": "overwrite"}
    if policy in modes:
        return path, modes[policy]
    if policy != "new":
        raise ValueError(f"unknown policy {policy!r}")
    jvm, n = df.sparkSession.sparkContext._jvm, 0
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    while True:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}_v{n:03d}")
        if not p.getFileSystem(conf).exists(p):
            return f"{path}_v{n:03d}", "errorifexists"
        n += 1


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def loaded_or(spark: SparkSession, path: str, policy: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` after it was stored under the policy. Under ``load`` a table that is there is
    read and nothing is computed."""
    if policy == "load" and exists(spark, path):
        return spark.read.parquet(path)
    return spark.read.parquet(save_table(compute(), path, policy))


def save_table(df: DataFrame, path: str, policy: str = "error", format: str = "parquet", by: list[str] | None = None) -> str:
    where, mode = free_path(df, path, policy)
    writer = df.write.mode(mode).format(format).option("header", True)
    (writer.partitionBy(*by) if by else writer).save(where)
    return where


def write_file(path: str, data: bytes) -> None:
    """One whole file by path or URI, in any file system that pyarrow knows; a task that runs twice
    leaves one whole file."""
    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    system.create_dir(place.rpartition("/")[0] or ".", recursive=True)
    part = f"{place}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, place)


def save_settings(settings: dict, path: str) -> None:
    write_file(path, yaml.safe_dump(settings, sort_keys=True).encode())


BOUNDS = ("x_min", "x_max", "y_min", "y_max")


def save_images(images: DataFrame, directory: str, tile: int | None = None, compression: str = "none", predictor: bool = False) -> DataFrame:
    """Writes pixels (name, rows, columns, bands, data: uint8) as TIFF files below a directory that all
    executors share, with pixel size and place where the table has bounds; of one strip or of square
    tiles, ``compression`` none, lzw or deflate. Returns (name, path, bytes) of what was written.
    Runs when it is read."""
    own = [F.col(c).cast("double").alias(c) if c in images.columns else F.lit(None).cast("double").alias(c) for c in BOUNDS]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .tiff import encoded

        for batch in batches:
            rows = []
            for r in batch.itertuples():
                bounds = tuple(getattr(r, c) for c in BOUNDS)
                data = encoded(r.data, r.rows, r.columns, r.bands, None if any(pd.isna(x) for x in bounds) else bounds, tile, compression, predictor)
                write_file(f"{directory}/{r.name}", data)
                rows.append((r.name, f"{directory}/{r.name}", len(data)))
            yield pd.DataFrame(rows, columns=["name", "path", "bytes"])

    return images.select("name", "rows", "columns", "bands", "data", *own).mapInPandas(task, "name string, path string, bytes long")


def copy_files(files: DataFrame, directory: str) -> DataFrame:
    """Copies ``filepath`` rows (joined with their ``binaryFile`` content) below a shared directory; returns
    (filepath, copied). Files of one name are told apart by a hash of their paths."""
    name = F.element_at(F.split("filepath", "/"), -1)
    twice = files.groupBy(name.alias("name")).agg(F.count_distinct("filepath").alias("n")).where("n > 1").select("name", F.lit(True).alias("twice"))
    named = files.withColumn("name", name).join(twice, "name", "left")
    own = F.when(F.col("twice"), F.concat(F.substring(F.md5(F.col("filepath").cast("binary")), 1, 8), F.lit("_"), "name")).otherwise(F.col("name"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for to, content in zip(batch["copied"], batch["content"], strict=True):
                write_file(to, content)
            yield batch[["filepath", "copied"]]

    return named.select("filepath", F.concat(F.lit(f"{directory}/"), own).alias("copied"), "content").mapInPandas(task, "filepath string, copied string")


def progress_images(progress: DataFrame, codes: list[str], directory: str, bands: int = 3) -> DataFrame:
    """Writes the warped images of the rows whose return code is listed, named by order and image."""
    own = [c for c in BOUNDS if c in progress.columns]
    kept = progress.where(F.col("return_code").isin(codes) & F.col("data").isNotNull())
    name = F.format_string("%06d_%d.tif", "order", "image_id")
    return save_images(kept.select(name.alias("name"), F.col("y_size").alias("rows"), F.col("x_size").alias("columns"), F.lit(bands).cast("long").alias("bands"), "data", *own), directory)
