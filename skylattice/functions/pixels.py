"""Pixel arrays as Column expressions: cleaning, scaling, masks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F


def cleaned(pixels: Column, top: int = 255, fraction: float = 0.03) -> Column:
    """Values up to ``int(fraction * top)`` become 0."""
    floor = int(fraction * top)
    return F.transform(pixels, lambda v: F.when(v <= floor, F.lit(0)).otherwise(v))


def log_scaled(pixels: Column, top: int = 255) -> Column:
    """log10(v + 1) stretched to the full range, truncated."""
    return F.transform(pixels, lambda v: (F.log10(v + 1.0) * top / F.log10(F.lit(top + 1.0))).cast("int"))


def chained(*steps: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda pixels: reduce(lambda c, f: f(c), steps, pixels)


def rescaled(pixels: Column, top_in: int, top_out: int) -> Column:
    return F.transform(pixels, lambda v: (v / top_in * top_out).cast("int"))


def alpha(*bands: Column, full: float = 255) -> Column:
    """``full`` where any band is above zero in sum, else 0."""
    return F.when(reduce(lambda a, b: a + b, bands) > 0, F.lit(full)).otherwise(F.lit(0))


def bright_count(pixels: Column, top: int = 255, fraction: float = 0.03) -> Column:
    return F.size(F.filter(pixels, lambda v: v > fraction * top)).cast("long")
