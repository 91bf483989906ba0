"""Names, timestamps and log values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TWO_32 = 1 << 32


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def last_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The last match of a pattern; null where there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def obc_parts(stamp: Column) -> Column:
    return F.split(F.trim(stamp), "_")


def capture_time(obc: Column, odroid: Column) -> Column:
    """Year from the on-board stamp ``YYYYMMDD_HHMMSS_n``, the rest from the yearless one ``MM-DD HH:MM:SS``."""
    return F.try_to_timestamp(F.concat(F.substring(obc_parts(obc)[0], 1, 4), F.lit("-"), odroid), F.lit("yyyy-MM-dd HH:mm:ss"))


def unwrapped(stamp: Column) -> Column:
    """The last part of the stamp as an unsigned 32-bit number, in text."""
    n = F.element_at(obc_parts(stamp), -1).cast("long")
    return F.when(n < 0, n + TWO_32).otherwise(n).cast("string")


def shifted(time: Column, hours: float) -> Column:
    return time - F.make_interval(secs=F.lit(hours * 3600))


def clean_range(temperature: Column, pressure: Column, altitude: Column) -> dict[str, Column]:
    """The three readings, all null where one of them is out of its range."""
    bad = F.coalesce((temperature < -273) | (altitude < 0) | (altitude > 20000), F.lit(False))
    return {n: F.when(~bad, c) for n, c in (("TempC", temperature), ("pressure", pressure), ("mAltitude", altitude))}


def no_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
