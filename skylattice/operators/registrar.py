"""Footprints from sensor positions, fitted on referenced images."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.geo import error_radius, hypot
from .quantiles import exact_quantiles

MEDIANS = ("x_size", "y_size", "pixel_width", "pixel_height", "width", "height")


@dataclass(frozen=True)
class Registrar:
    """Medians of the footprints and the mean error of each camera."""

    medians: dict[str, float]
    errors: DataFrame

    def transform(self, rows: DataFrame, angles: dict[int, float], angle_error: float = 5.0) -> DataFrame:
        """Adds bounds around the sensor, spatial_error (the camera's, else by altitude) and padding."""
        angle = F.create_map(*(F.lit(x) for k, v in angles.items() for x in (k, v)))[F.col("camera_num").cast("int")]
        w, h = self.medians["width"] / 2, self.medians["height"] / 2
        out = rows.join(self.errors, "camera_num", "left")
        out = out.withColumn("spatial_error", F.coalesce("mean_error", error_radius(F.col("mAltitude"), angle, angle_error))).drop("mean_error")
        x, y = F.col("sensor_x"), F.col("sensor_y")
        return out.withColumns({"x_min": x - w, "x_max": x + w, "y_min": y - h, "y_max": y + h, "x_center": x, "y_center": y, "padding": 1.5 * F.col("spatial_error")})


def camera_errors(rows: DataFrame) -> DataFrame:
    """Mean distance between sensor and image centre per camera."""
    d = hypot(F.col("sensor_x") - F.col("x_center"), F.col("sensor_y") - F.col("y_center"))
    return rows.groupBy("camera_num").agg(F.avg(d).alias("mean_error"))


def medians(rows: DataFrame) -> DataFrame:
    wide = rows.withColumns({"width": F.col("x_max") - F.col("x_min"), "height": F.col("y_max") - F.col("y_min")})
    return exact_quantiles(wide, {c: (c, 0.5) for c in MEDIANS})


def fit(rows: DataFrame) -> Registrar:
    """One aggregate row comes to the driver; the errors stay a table, one row per camera."""
    return Registrar(medians(rows).first().asDict(), camera_errors(rows))


def centre_distance(rows: DataFrame) -> DataFrame:
    """Distance between predicted (x_center, y_center) and true (x_true, y_true) centres."""
    return rows.withColumn("score", hypot(F.col("x_center") - F.col("x_true"), F.col("y_center") - F.col("y_true")))
