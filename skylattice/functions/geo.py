"""Geometry of footprints: projection, bounds, pixels, homographies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import projection

#: Sphere of the web projection, metres.
RADIUS = 6378137.0


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3857."""
    return RADIUS * F.radians(lon), RADIUS * F.log(F.tan(F.lit(3.141592653589793) / 4 + F.radians(lat) / 2))


def inverse_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857 to (latitude, longitude)."""
    return F.degrees(2 * F.atan(F.exp(y / RADIUS)) - F.lit(3.141592653589793) / 2), F.degrees(x / RADIUS)


def hypot(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def norm(*parts: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))


def bounds_of(x_min: Column, y_max: Column, width: Column, height: Column, columns: Column, rows: Column) -> tuple[Column, Column]:
    """(x_max, y_min) of a geotransform; ``height`` is negative for north-up images."""
    return x_min + width * columns, y_max + height * rows


def centre(lo: Column, hi: Column) -> Column:
    return 0.5 * (lo + hi)


def padding(x_min: Column, x_max: Column, y_min: Column, y_max: Column, fraction: float) -> Column:
    return F.lit(fraction) * hypot(x_max - x_min, y_max - y_min)


def to_pixels(raster: dict[str, float]) -> dict[str, Column]:
    """Pixel rectangle of the bounds in a raster; offset and size are rounded half to even."""
    w, h = raster["pixel_width"], raster["pixel_height"]
    c = F.col
    return {
        "x_off": F.rint((c("x_min") - raster["x_min"]) / w).cast("long"), "y_off": F.rint((c("y_max") - raster["y_max"]) / h).cast("long"),
        "x_size": F.rint((c("x_max") - c("x_min")) / w).cast("long"), "y_size": F.rint((c("y_min") - c("y_max")) / h).cast("long"),
    }


def to_bounds(raster: dict[str, float]) -> dict[str, Column]:
    """Inverse of ``to_pixels``."""
    w, h, c = raster["pixel_width"], raster["pixel_height"], F.col
    x, y = raster["x_min"] + c("x_off") * w, raster["y_max"] + c("y_off") * h
    return {"x_min": x, "x_max": x + c("x_size") * w, "y_max": y, "y_min": y + c("y_size") * h}


def edge_pixels(x: Column, lo: Column, hi: Column, size: Column) -> Column:
    """Place of a coordinate on an axis whose first and last pixels lie on the edges."""
    return (x - lo) / (hi - lo) * (size - 1)


def edge_coordinates(i: Column, lo: Column, hi: Column, size: Column) -> Column:
    return lo + i * (hi - lo) / (size - 1)


def search_zone(pad: Column) -> dict[str, Column]:
    c = F.col
    return {"x_min": c("x_min") - pad, "x_max": c("x_max") + pad, "y_min": c("y_min") - pad, "y_max": c("y_max") + pad}


def warp_point(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point under a homography of nine coefficients, row by row."""
    w = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def determinant(m: list[Column]) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def warped_box(m: list[Column], columns: Column, rows: Column) -> dict[str, Column]:
    """Bounding box of the four corners of an image under a homography."""
    zero = F.lit(0.0)
    points = [warp_point(m, x, y) for x, y in ((zero, zero), (columns, zero), (columns, rows), (zero, rows))]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return {"x_lo": F.least(*xs), "x_hi": F.greatest(*xs), "y_lo": F.least(*ys), "y_hi": F.greatest(*ys)}


def error_radius(altitude: Column, angle: Column, angle_error: float) -> Column:
    return altitude * F.tan(F.radians(angle + angle_error))


def barometric_height(pressure: Column) -> Column:
    return 44330.8 * (1 - F.pow(pressure / 1013.25, F.lit(0.190263)))


def polar(x: Column, y: Column) -> tuple[Column, Column]:
    """(radius, angle in degrees)."""
    return hypot(x, y), F.degrees(F.atan2(y, x))


def tile_bounds(h: Column, v: Column) -> dict[str, Column]:
    """West, east, south, north of a 10 degree tile."""
    return {"west": 10.0 * h - 180, "east": 10.0 * h - 170, "south": 80 - 10.0 * v, "north": 90 - 10.0 * v}


def inside(x_size: int, y_size: int) -> Column:
    """Whether a pixel rectangle lies within a raster."""
    c = F.col
    return (c("x_off") >= 0) & (c("y_off") >= 0) & (c("x_off") + c("x_size") <= x_size) & (c("y_off") + c("y_size") <= y_size)


def trimmed(x_size: int, y_size: int) -> dict[str, Column]:
    """The part of a pixel rectangle within a raster; a rectangle outside has size 0."""
    out = {}
    for a, n in (("x", x_size), ("y", y_size)):
        off, size = F.col(f"{a}_off"), F.col(f"{a}_size")
        lo = F.least(F.greatest(off, F.lit(0)), F.lit(n))
        hi = F.greatest(F.least(off + size, F.lit(n)), lo)
        out |= {f"{a}_off": lo, f"{a}_size": hi - lo}
    return out


def reprojected(source: str, target: str) -> dict[str, Column]:
    """Bounds (x_min, x_max, y_min, y_max) in another system of ``projection``. Pixel sizes follow from the
    bounds, so the stretch by latitude is kept."""
    return projection.bounds(source, target)
