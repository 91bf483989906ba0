"""Gates, outcome codes, scores and generic row plumbing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import determinant, hypot

COORDINATES = ("x_min", "x_max", "y_min", "y_max")


def steady_filter(most: float = 0.075) -> Column:
    return F.col("imuGyroMag") < most


def altitude_filter(least: float = 13000) -> Column:
    return F.col("mAltitude") > least


def filtered(rows: DataFrame, condition: Callable[[DataFrame], Column], apply: bool = True) -> DataFrame:
    """Rows that meet the condition, or, with apply=False, all rows with it in ``selected``."""
    keep = F.coalesce(condition(rows), F.lit(False))
    if apply:
        return rows.where(keep)
    before = F.coalesce(F.col("selected"), F.lit(True)) if "selected" in rows.columns else F.lit(True)
    return rows.withColumn("selected", before & keep)


class MissingColumns(ValueError):
    """A required column is absent, or an extra one is present where none may pass."""


def required(rows: DataFrame, columns: list[str], passthrough: bool | list[str] = True) -> DataFrame:
    """Required columns, and others only where they may pass through."""
    missing = [x for x in columns if x not in rows.columns]
    if missing:
        raise MissingColumns(f"missing columns: {missing}")
    if passthrough is True:
        return rows
    return rows.select(*columns, *(x for x in (passthrough or []) if x in rows.columns and x not in columns))


def with_passthrough(rows: DataFrame, columns: list[str], f: Callable[[DataFrame], DataFrame], keys: list[str], passthrough: list[str]) -> DataFrame:
    """Runs f on the required columns and joins the others back; its own output wins on a clash."""
    out = f(required(rows, columns, False))
    rest = [x for x in passthrough if x in rows.columns and x not in out.columns]
    return out.join(rows.select(*keys, *rest), keys, "left")


def combine_first(first: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Values of the first table, gaps and missing rows from the other."""
    names = [x for x in first.columns if x not in keys] + [x for x in other.columns if x not in keys and x not in first.columns]
    a, b = first.withColumnsRenamed({x: f"_a_{x}" for x in first.columns if x not in keys}), other.withColumnsRenamed({x: f"_b_{x}" for x in other.columns if x not in keys})
    both = a.join(b, keys, "full_outer")
    return both.select(*keys, *(F.coalesce(*(F.col(n) for n in (f"_a_{x}", f"_b_{x}") if n in both.columns)).alias(x) for x in names))


def acceptance(cuts: dict[str, tuple[float, float]]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).between(lo, hi) for k, (lo, hi) in cuts.items()))


def homography_gate(m: list[Column], low: float = 0.6, high: float = 1.7) -> Column:
    det = F.abs(determinant(m))
    return F.coalesce((det > low) & (det < high), F.lit(False))


def return_code(failures: dict[str, Column]) -> Column:
    """The first failure that holds, in order, else success."""
    return F.coalesce(*(F.when(cond, F.lit(name)) for name, cond in failures.items()), F.lit("success"))


def first_success(*results: Column) -> Column:
    return F.coalesce(*results)


def geometric_differences(predicted: DataFrame, true: DataFrame, key: str = "image_id", how: str = "left") -> DataFrame:
    """Differences (predicted - true, null where one is missing) of bounds and sizes, and of the centre."""
    names = [x for x in (*COORDINATES, "x_size", "y_size", "pixel_width", "pixel_height") if x in predicted.columns and x in true.columns]
    a, b = (df.select(key, *(F.col(x).alias(f"{s}_{x}") for x in names)) for s, df in (("p", predicted), ("t", true)))
    out = a.join(b, key, how)
    diff = {f"{x}_diff": F.col(f"p_{x}") - F.col(f"t_{x}") for x in names}
    x, y = diff["x_min_diff"] + diff["x_max_diff"], diff["y_min_diff"] + diff["y_max_diff"]
    return out.select(key, *(v.alias(k) for k, v in diff.items()), (0.5 * hypot(x, y)).alias("center_diff"))


def grid(a: DataFrame, b: DataFrame) -> DataFrame:
    """All combinations of two parameter lists."""
    return a.crossJoin(b)
