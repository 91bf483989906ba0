"""Word arrays as Spark SQL columns: whole-array expressions, no Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; null has none."""
    text = F.coalesce(text, F.lit(""))
    # lower() leaves nothing but A-Z to change in a text of one-byte characters, and is faster
    plain = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(plain, SEPARATORS), "")


def both(array: Column, other: Column, shift: int, f: Callable[[Column, Column], Column]) -> Column:
    """f(array[i], other[i + shift]) for every i where both exist."""
    n = F.greatest(F.lit(0), F.least(F.size(array), F.size(other) - shift))
    return F.zip_with(F.slice(array, 1, n), F.slice(other, shift + 1, n), f)


def every_run(df: DataFrame, column: str, n: int, f: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """Column ``out``: f folded over each run of n neighbours, in about log2(n) steps.

    Each step is a column of its own, so no step is evaluated twice.
    """
    steps, done, have = [(1, column)], 0, None
    while 2 * steps[-1][0] <= n:
        p, last = steps[-1]
        df = df.withColumn(f"_{out}{2 * p}", both(F.col(last), F.col(last), p, f))
        steps.append((2 * p, f"_{out}{2 * p}"))
    for p, name in reversed(steps):
        if n - done >= p:
            df = df.withColumn(f"_{out}r{p}", F.col(name) if have is None else both(F.col(have), F.col(name), done, f))
            have, done = f"_{out}r{p}", done + p
    return df.withColumn(out, F.col(have)).drop(*(x for x in df.columns if x.startswith(f"_{out}")))


def by_text(df: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Join on (doc_id, th), where a null doc_id equals itself; the other side's keys go."""
    other = other.withColumnsRenamed({"doc_id": "_doc", "th": "_th"})
    return df.join(other, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("th").eqNullSafe(F.col("_th")), how).drop("_doc", "_th")


def text_key(doc_id: str = "doc_id", th: Column | str = "th") -> list[Column]:
    """Join key of a text: columns that are never null, so that a null doc_id equals itself."""
    return [F.isnull(doc_id).alias("_none"), F.coalesce(F.col(doc_id), F.lit(0)).alias("_doc"), F.col("th").alias("_th") if isinstance(th, str) else th.alias("_th")]
