"""Spark-native analytics for time-aligned sensor metadata and georeferenced rasters."""
