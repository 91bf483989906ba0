"""Ordering, top-k and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geo import hypot
from .graph import cut


def ordered(rows: DataFrame, columns: list[str], key: str = "image_id", by: list[str] | None = None) -> DataFrame:
    """Adds ``order`` = 0.. by the columns, nulls last, ties by ``key``; within each ``by`` group if given.

    Without ``by`` a rank over the whole table needs a total order: rows are range-partitioned and
    sorted, counted per partition, and numbered from the counts before, so no task holds all.
    """
    sort = [F.col(c).asc_nulls_last() for c in (*columns, key)]
    if by:
        return rows.withColumn("order", F.row_number().over(Window.partitionBy(*by).orderBy(*sort)).cast("long") - 1)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the bounds of the ranges are sampled anew each time, so one numbering is kept for both uses
    marked = rows.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id() % (1 << 33))
    marked = cut(marked)
    before = marked.groupBy("_p").agg(F.count("*").alias("_n"))
    start = before.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_start")
    return marked.join(F.broadcast(start), "_p").withColumn("order", F.col("_start") + F.col("_m")).drop("_p", "_m", "_start")


def sensor_and_distance(rows: DataFrame, sensors: dict[int, int], key: str = "image_id") -> DataFrame:
    """Order by the sensor's rank, then by distance to the first image's centre."""
    rank = F.create_map(*(F.lit(x) for k, v in sensors.items() for x in (k, v)))[F.col("camera_num").cast("int")].cast("long")
    first = rows.agg(F.min_by(F.struct("x_center", "y_center"), key).alias("_c"))
    out = rows.crossJoin(F.broadcast(first))  # one row
    out = out.withColumn("sensor_order", rank).withColumn("distance_to_starting_image", hypot(F.col("x_center") - F.col("_c.x_center"), F.col("y_center") - F.col("_c.y_center"))).drop("_c")
    return ordered(out, ["sensor_order", "distance_to_starting_image"], key)


def top_per_group(rows: DataFrame, by: list[str], sort: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*sort))).where(F.col("_r") <= n).drop("_r")


def split(rows: DataFrame, test_size: float, seed: int, key: str = "image_id") -> DataFrame:
    """Adds ``part`` (train or test) by a seeded hash of the key; a row's part never depends on others."""
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / (1 << 30)
    return rows.withColumn("part", F.when(unit < test_size, "test").otherwise("train"))


def split_exact(rows: DataFrame, n_test: int, seed: int, key: str = "image_id") -> DataFrame:
    """Adds ``part``: the ``n_test`` rows with the smallest seeded hashes are the test set."""
    pick = rows.select(F.col(key).alias("_k"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")).alias("_h")).orderBy("_h", "_k").limit(n_test).select("_k")
    return rows.join(pick, F.col(key) == F.col("_k"), "left").withColumn("part", F.when(F.col("_k").isNotNull(), "test").otherwise("train")).drop("_k")


def downsample(rows: DataFrame, n: int, seed: int, key: str = "image_id") -> DataFrame:
    """``n`` rows without replacement, by seeded hash; a sampling operator, so the limit is the feature."""
    return split_exact(rows, n, seed, key).where("part = 'test'").drop("part")


def stratified(rows: DataFrame, by: str, n: int, seed: int, key: str = "image_id") -> DataFrame:
    """Adds ``part``: ``n`` training rows of each group, by seeded hash."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    rank = F.row_number().over(Window.partitionBy("_g").orderBy("_h", "_k"))
    # the filter on the rank is applied before the shuffle too, so a large group sends n rows a task
    pick = rows.select(F.col(by).alias("_g"), F.col(key).alias("_k"), h.alias("_h")).withColumn("_r", rank).where(F.col("_r") <= n).select("_k")
    return rows.join(pick, F.col(key) == F.col("_k"), "left").withColumn("part", F.when(F.col("_k").isNotNull(), "train").otherwise("test")).drop("_k")
