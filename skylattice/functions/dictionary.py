"""Descriptions of the columns, kept as column metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: column: (type, unit, description)
COLUMNS = {
    "image_id": ("bigint", "", "identity of an image"), "filepath": ("string", "", "path of the image file"), "filename": ("string", "", "name of the image file"), "timestamp": ("timestamp", "UTC", "capture time"),
    "timestamp_id": ("string", "", "unsigned counter of the camera"), "camera_num": ("int", "", "camera"), "serial_num": ("bigint", "", "serial number of the camera"), "exposure_time": ("bigint", "ms", "exposure"),
    "TempC": ("double", "C", "temperature"), "pressure": ("double", "hPa", "pressure"), "mAltitude": ("double", "m", "pressure altitude"), "imuGyroMag": ("double", "rad/s", "turning rate"),
    "GPSLat": ("double", "deg", "latitude"), "GPSLong": ("double", "deg", "longitude"), "GPSAlt": ("double", "m", "altitude by position system"), "sensor_x": ("double", "m", "projected easting of the sensor"), "sensor_y": ("double", "m", "projected northing of the sensor"),
    "x_min": ("double", "m", "west bound"), "x_max": ("double", "m", "east bound"), "y_min": ("double", "m", "south bound"), "y_max": ("double", "m", "north bound"), "x_center": ("double", "m", "centre"), "y_center": ("double", "m", "centre"),
    "pixel_width": ("double", "m", "pixel size"), "pixel_height": ("double", "m", "pixel size, negative northwards"), "x_size": ("bigint", "px", "columns"), "y_size": ("bigint", "px", "rows"), "x_off": ("bigint", "px", "first column"), "y_off": ("bigint", "px", "first row"),
    "spatial_error": ("double", "m", "expected position error"), "padding": ("double", "m", "margin of the search zone"), "return_code": ("string", "", "outcome"), "order": ("bigint", "", "processing order"), "score": ("double", "", "score"), "duration": ("double", "s", "time taken"),
    "ClimbErr": ("double", "", "error of the climb rate by position system"), "LatErr": ("double", "", "error of latitude"), "LonErr": ("double", "", "error of longitude"), "SpeerErr": ("double", "", "error of speed"), "GPSHeading": ("double", "deg", "heading by position system"),
    "imuAccelX": ("double", "", "acceleration along x"), "imuAccelY": ("double", "", "acceleration along y"), "imuAccelZ": ("double", "", "acceleration along z"), "imuGyroX": ("double", "rad/s", "turning rate around x"), "imuGyroY": ("double", "rad/s", "turning rate around y"), "imuGyroZ": ("double", "rad/s", "turning rate around z"),
    "imuMagX": ("double", "", "magnetic field along x"), "imuMagY": ("double", "", "magnetic field along y"), "imuMagZ": ("double", "", "magnetic field along z"), "imuPitch": ("double", "deg", "pitch"), "imuRoll": ("double", "deg", "roll"), "imuYaw": ("double", "deg", "yaw"),
    "internal_temp": ("bigint", "C", "temperature inside the camera"), "sequence_ind": ("bigint", "", "place in the camera's sequence"), "obc_filename": ("string", "", "path of the image on the camera's computer"), "obc_timestamp": ("string", "", "capture time and counter as logged"), "odroid_timestamp": ("string", "", "time of the log entry, without a year"),
    "filename_x": ("string", "", "file name on the left of a join"), "filename_y": ("string", "", "file name on the right of a join"), "output_filepath": ("string", "", "path of the referenced image that was written"), "timestamp_int_gps": ("bigint", "us", "time of the position reading"), "timestamp_int_imu": ("bigint", "us", "time of the inertial reading"),
    "sensor_order": ("bigint", "", "rank of the camera in processing"), "distance_to_starting_image": ("double", "m", "distance from the first image's centre"), "x_rot": ("double", "", "row rotation of the geotransform"), "y_rot": ("double", "", "column rotation of the geotransform"),
    "center_diff": ("double", "m", "distance of estimated and true centre"), "x_min_diff": ("double", "m", "west bound, estimated less true"), "x_max_diff": ("double", "m", "east bound, estimated less true"), "y_min_diff": ("double", "m", "south bound, estimated less true"), "y_max_diff": ("double", "m", "north bound, estimated less true"),
    "pixel_width_diff": ("double", "m", "pixel width, estimated less true"), "pixel_height_diff": ("double", "m", "pixel height, estimated less true"), "x_size_diff": ("bigint", "px", "columns, estimated less true"), "y_size_diff": ("bigint", "px", "rows, estimated less true"),
}


def documented(df: DataFrame) -> DataFrame:
    """The same table with descriptions in its schema; unknown columns get a placeholder."""
    get = lambda n: COLUMNS.get(n, ("", "", "no description"))
    return df.select(*(F.col(f"`{n}`").alias(n, metadata={"unit": get(n)[1], "description": get(n)[2]}) for n in df.columns))


def described(df: DataFrame) -> DataFrame:
    rows = [(n, k, *COLUMNS.get(n, ("", "", "no description"))[1:]) for n, k in df.dtypes]
    return df.sparkSession.createDataFrame(rows, "name string, type string, unit string, description string")
