"""Histograms, percentiles and outcome summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .quantiles import exact_quantiles


def bin_of(value: Column, lo: float, hi: float, n: int) -> Column:
    """Number of the bin; the last one includes its right edge; null outside."""
    width = (hi - lo) / n
    return F.when(value.between(lo, hi), F.least(F.floor((value - lo) / width), F.lit(n - 1)))


def histogram(rows: DataFrame, column: str, lo: float, hi: float, n: int, weight: str) -> DataFrame:
    return rows.withColumn("bin", bin_of(F.col(column), lo, hi, n)).where("bin is not null").groupBy("bin").agg(F.sum(weight).alias("weight"))


def histogram_2d(rows: DataFrame, x: tuple[str, float, float, int], y: tuple[str, float, float, int], value: str) -> DataFrame:
    binned = rows.withColumns({"x_bin": bin_of(F.col(x[0]), *x[1:]), "y_bin": bin_of(F.col(y[0]), *y[1:])})
    return binned.where("x_bin is not null and y_bin is not null").groupBy("x_bin", "y_bin").agg(F.avg(value).alias("mean"))


def nearest_bin(rows: DataFrame, column: str, bins: DataFrame, lo: float, hi: float, n: int) -> DataFrame:
    """Joins each row with the bin it lies in; values beyond the ends take the end bins."""
    place = F.least(F.greatest(F.floor((F.col(column) - lo) / ((hi - lo) / n)), F.lit(0)), F.lit(n - 1))
    return rows.withColumn("bin", place).join(bins, "bin")


def code_fractions(rows: DataFrame, by: list[str], code: str) -> DataFrame:
    """Count of each return code and its share in the group."""
    n = rows.groupBy(*by, code).agg(F.count("*").alias("n"))
    return n.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def percentiles(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    return exact_quantiles(rows, {f"p{round(100 * p)}": (column, p) for p in (0.5, 0.16, 0.84)}, by)


def durations(rows: DataFrame, by: list[str], column: str, expected: int) -> DataFrame:
    """Median and total seconds, and the hours that ``expected`` rows would take."""
    median = exact_quantiles(rows, {"median_s": (column, 0.5)}, by)
    total = rows.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.sum(column).alias("total_s"))
    both = median.join(total, [median[c].eqNullSafe(total[f"_{c}"]) for c in by])
    return both.select(*by, "median_s", "total_s", (F.col("median_s") * expected / 3600).alias("hours"))
