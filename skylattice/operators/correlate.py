"""Matching of image files with metadata rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import basename, last_match


class UnmatchedError(ValueError):
    """Files without metadata under the policy ``error``."""


def correlate(files: DataFrame, log: DataFrame, patterns: tuple[str, ...] = (), unmatched: str = "drop", key: str = "timestamp_id") -> DataFrame:
    """Files (file_id, filepath) joined with log rows on the file name, then, for what is left, on
    the last match of each pattern as ``key``, one pattern after another.

    Duplicate log rows multiply. ``unmatched``: ``error`` raises, ``drop`` leaves them out, ``passthrough``
    keeps them with selected = false.
    """
    rest = files.withColumn("filename", basename(F.col("filepath")))
    found = rest.join(log, "filename")
    rest = rest.join(log, "filename", "left_anti")
    for p in patterns:
        keyed = rest.withColumn(key, last_match(F.col("filename"), p)).where(F.col(key).isNotNull())
        hit = keyed.join(log.drop("filename"), key)
        found = found.unionByName(hit, allowMissingColumns=True)
        rest = rest.join(hit.select("file_id").distinct(), "file_id", "left_anti")
    if unmatched == "error":
        n = rest.count()
        if n:
            raise UnmatchedError(f"{n} files have no metadata")
    elif "passthrough" in unmatched:
        return found.withColumn("selected", F.lit(True)).unionByName(rest.withColumn("selected", F.lit(False)), allowMissingColumns=True)
    elif "drop" not in unmatched:
        raise ValueError(f"unknown policy {unmatched!r}")
    return found


def catalogue(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """Metadata rows whose file is available, by base name; rows without an output file drop out."""
    return metadata.withColumn("_name", basename(F.col("output_filepath"))).join(files.select(basename(F.col("filepath")).alias("_name"), "filepath"), "_name").drop("_name")
