"""Batches that can be stopped and resumed: a log of outcomes per row, kept beside the results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.sinks import exists


def versions(spark: SparkSession, path: str) -> list[str]:
    """The parts of a log that were stored whole, in order; a part without its end mark is left out."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(p):
        return []
    names = sorted(s.getPath().getName() for s in system.listStatus(p) if s.isDirectory())
    return [f"{path}/{n}" for n in names if n.startswith("part=") and exists(spark, f"{path}/{n}/_SUCCESS")]


def restored(spark: SparkSession, path: str) -> DataFrame | None:
    """The log that is stored below ``path``, or None."""
    parts = versions(spark, path)
    return spark.read.parquet(*parts) if parts else None


def resumed(rows: DataFrame, path: str, process: Callable[[DataFrame], DataFrame], key: str = "image_id", start: int = 0, most: int | None = None) -> DataFrame:
    """Process the rows (``key``, ``order``, ...) from order ``start`` on that the log does not hold yet, at most
    ``most`` of them by order (a run's share, not a cut: the next run goes on), and add their outcomes
    to the log as one part. Returns the whole log: what ``process`` returned, and ``run``.

    ``process`` gets and returns a table with ``key``; a row it loses is tried again by the next run. A
    run that dies leaves no part, so nothing is counted twice. Repeated keys are one row.
    """
    spark, before = rows.sparkSession, restored(rows.sparkSession, path)
    left = rows.where(F.col("order") >= start)
    if before is not None:
        left = left.join(before.select(key).distinct(), key, "left_anti")
    if most is not None:
        left = left.orderBy("order").limit(most)
    n = len(versions(spark, path))
    process(left).withColumn("run", F.lit(n)).write.mode("overwrite").parquet(f"{path}/part={n:06d}")
    return restored(spark, path)


def prune(spark: SparkSession, path: str) -> None:
    """Put all parts of the log into one; the old parts go only after the new one is whole."""
    parts = versions(spark, path)
    if len(parts) < 2:
        return
    spark.read.parquet(*parts).write.parquet(f"{path}/part=999999-pruning")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    of = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    system = of(path).getFileSystem(conf)
    for p in parts:
        system.delete(of(p), True)
    system.rename(of(f"{path}/part=999999-pruning"), of(parts[0]))
