"""Streams of new flights: filters, ordered per-flight progress, windowed outcome counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def read_new_files(spark, path: str, schema: str, format: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(format).load(path)


def windowed_outcomes(rows: DataFrame, time: str = "ts", code: str = "return_code", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of each code per window; rows later than ``late`` are left out, as the watermark says."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), code).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), code, "n")


def numbered(rows: DataFrame, key: str = "flight_id") -> DataFrame:
    """Resumable order: numbers the rows of each flight across micro-batches; the last number is state."""
    schema = f"{key} long, image_id long, order long"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values("image_id")
        state.update((n + len(rows),))
        yield pd.DataFrame({key: k[0], "image_id": rows["image_id"].to_numpy(), "order": range(n, n + len(rows))})

    return rows.groupBy(key).applyInPandasWithState(step, schema, "n long", "append", "NoTimeout")


def run_to_end(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what is there and stops; a later call goes on where this one ended."""
    rows.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
