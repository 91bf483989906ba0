"""Camera, inertial and position logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geo, projection, text as tx

IMAGE_LOG = ("odroid_timestamp", "obc_timestamp", "camera_num", "serial_num", "exposure_time", "sequence_ind", "internal_temp", "filename")
IMU_NUMBERS = ("TempC", "pressure", "mAltitude", "imuAccelX", "imuAccelY", "imuAccelZ", "imuGyroX", "imuGyroY", "imuGyroZ", "imuMagX", "imuMagY", "imuMagZ", "imuRoll", "imuPitch", "imuYaw", "VoltageV", "PiCurrentA", "PiPowerW")
GPS_NUMBERS = ("GPSLat", "GPSLong", "GPSAlt", "GPSHeading", "ClimbErr", "LatErr", "LonErr", "SpeerErr")
NO_FIX = "00.00.0000 00:00:00000"


def image_log(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Lines (column ``value``) of the header-less camera log; columns beyond the named ones are dropped."""
    parts = F.split("value", ",")
    rows = lines.select(*(keep or []), *(parts[i].alias(n) for i, n in enumerate(IMAGE_LOG)))
    rows = rows.withColumns({n: F.expr(f"try_cast({n} AS bigint)") for n in IMAGE_LOG[2:7]})
    rows = rows.withColumns({"timestamp": tx.capture_time(F.col("obc_timestamp"), F.col("odroid_timestamp")), "timestamp_id": tx.unwrapped(F.col("obc_timestamp")), "obc_filename": F.col("filename")})
    return rows.withColumn("filename", tx.basename(F.col("obc_filename")))


def log_from_names(files: DataFrame) -> DataFrame:
    """The camera log that names ``cycle_epoch_serial_camera_img...`` hold, for flights without one.

    The path stays with every row and the camera is a number, so later lookups find it.
    """
    name = tx.basename(F.col("filepath"))
    parts = F.split(F.split(name, "_img")[0], "_")
    rows = files.withColumn("filename", name).withColumns({n: F.get(parts, i) for i, n in enumerate(("image_cycle", "timestamp_id", "serial_num", "camera_num"))})
    return rows.withColumns({"camera_num": F.expr("try_cast(camera_num AS int)"), "timestamp": F.timestamp_micros(F.expr("CAST(try_cast(timestamp_id AS decimal(20, 6)) * 1000000 AS bigint)"))})


def numbers(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Text to double; what isn't a number, and NaN, is null."""
    return rows.withColumns({n: tx.no_nan(F.expr(f"try_cast(`{n}` AS double)")) for n in names if n in rows.columns})


def imu_log(rows: DataFrame) -> DataFrame:
    """Text rows of the inertial log: repeated headers go; a negative pressure voids the whole row;
    readings out of range are null; adds the gyro's magnitude."""
    rows = rows.where("CurrTimestamp is not null and CurrTimestamp <> 'CurrTimestamp'")
    rows = numbers(rows, IMU_NUMBERS).withColumn("CurrTimestamp", F.expr("try_cast(CurrTimestamp AS timestamp)"))
    void = F.coalesce(F.col("pressure") < 0, F.lit(False))
    rows = rows.select(*(F.when(~void, F.col(c)).alias(c) for c in rows.columns))
    rows = rows.withColumns(tx.clean_range(F.col("TempC"), F.col("pressure"), F.col("mAltitude")))
    return rows.withColumn("imuGyroMag", geo.norm(F.col("imuGyroX"), F.col("imuGyroY"), F.col("imuGyroZ")))


def gps_log(rows: DataFrame, keep: list[str] | None = None, crs: str = "EPSG:3857") -> DataFrame:
    """Text rows of the position log: headers and rows without a fix go; adds coordinates in ``crs``."""
    rows = rows.where(F.col("CurrTimestamp").isNotNull() & ~F.col("CurrTimestamp").isin("CurrTimestamp", NO_FIX)).drop("GPSTime")
    rows = numbers(rows, GPS_NUMBERS).withColumn("CurrTimestamp", F.expr("try_cast(CurrTimestamp AS timestamp)"))
    x, y = projection.transformed("EPSG:4326", crs, F.col("GPSLong"), F.col("GPSLat"))
    return rows.withColumns({"sensor_x": x, "sensor_y": y})
