"""Coordinate systems: degrees, the web projection and the zones of the universal transverse Mercator grid.

Formulas are written once over a set of functions, ``JVM`` for columns or ``ARRAYS`` for NumPy, so tables and
rasters are transformed alike. Systems: EPSG:4326 (x is longitude), EPSG:3857, EPSG:32601-32660 (north) and
EPSG:32701-32760 (south).
"""

from __future__ import annotations

from functools import partial
from types import SimpleNamespace
from typing import Any

import numpy as np
from pyspark.sql import Column, functions as F

JVM = SimpleNamespace(sin=F.sin, cos=F.cos, tan=F.tan, asin=F.asin, atan=F.atan, atan2=F.atan2, sinh=F.sinh, cosh=F.cosh, atanh=F.atanh, exp=F.exp, log=F.log, sqrt=F.sqrt, radians=F.radians, degrees=F.degrees)
ARRAYS = SimpleNamespace(sin=np.sin, cos=np.cos, tan=np.tan, asin=np.arcsin, atan=np.arctan, atan2=np.arctan2, sinh=np.sinh, cosh=np.cosh, atanh=np.arctanh, exp=np.exp, log=np.log, sqrt=np.sqrt, radians=np.radians, degrees=np.degrees)

#: Fixed values of the WGS 84 ellipsoid and of the grid.
RADIUS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500000.0, 10000000.0
N = FLATTENING / (2 - FLATTENING)
ECCENTRICITY = 2 * N**0.5 / (1 + N)
#: Radius of the circle as long as a meridian, times the scale.
MERIDIAN = SCALE * RADIUS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
#: Fixed coefficients of the series in N: to the grid, from the grid, and of the latitude.
TO_GRID = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
FROM_GRID = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
LATITUDE = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)
#: Points along each side of a rectangle whose images bound it in another system.
ALONG = 8
Pair = tuple[Any, Any]


def zone(system: str) -> tuple[float, float] | None:
    """(central meridian in degrees, false northing) of a grid zone."""
    code = system.removeprefix("EPSG:")
    if len(code) == 5 and code[:3] in ("326", "327") and 1 <= int(code[3:]) <= 60:
        return 6.0 * int(code[3:]) - 183, FALSE_NORTH if code[2] == "7" else 0.0
    return None


def to_grid(lon: Any, lat: Any, meridian: float, north: float, m: SimpleNamespace) -> Pair:
    """Degrees to metres east and north, by the series of Krueger in the third flattening."""
    s, away = m.sin(m.radians(lat)), m.radians(lon - meridian)
    t = m.sinh(m.atanh(s) - ECCENTRICITY * m.atanh(ECCENTRICITY * s))
    xi, eta = m.atan2(t, m.cos(away)), m.atanh(m.sin(away) / m.sqrt(1 + t * t))
    y, x = xi, eta
    for j, a in enumerate(TO_GRID, 1):
        y = y + a * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        x = x + a * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
    return FALSE_EAST + MERIDIAN * x, north + MERIDIAN * y


def from_grid(x: Any, y: Any, meridian: float, north: float, m: SimpleNamespace) -> Pair:
    """Metres east and north to degrees."""
    xi, eta = (y - north) / MERIDIAN, (x - FALSE_EAST) / MERIDIAN
    u, v = xi, eta
    for j, b in enumerate(FROM_GRID, 1):
        u = u - b * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        v = v - b * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
    sphere = m.asin(m.sin(u) / m.cosh(v))
    lat = sphere
    for j, d in enumerate(LATITUDE, 1):
        lat = lat + d * m.sin(2 * j * sphere)
    return meridian + m.degrees(m.atan2(m.sinh(v), m.cos(u))), m.degrees(lat)


def known(*systems: str) -> bool:
    return all(s in ("EPSG:4326", "EPSG:3857") or zone(s) for s in systems)


def transformed(source: str, target: str, x: Any, y: Any, m: SimpleNamespace = JVM) -> Pair:
    """A point of one system in another."""
    if not known(source, target):
        raise ValueError(f"no transformation from {source} to {target}")
    if source == target:
        return x, y
    if source == "EPSG:3857":
        lon, lat = m.degrees(x / RADIUS), m.degrees(2 * m.atan(m.exp(y / RADIUS)) - np.pi / 2)
    else:
        lon, lat = from_grid(x, y, *zone(source), m) if zone(source) else (x, y)
    if target == "EPSG:3857":
        return RADIUS * m.radians(lon), RADIUS * m.log(m.tan(np.pi / 4 + m.radians(lat) / 2))
    return to_grid(lon, lat, *zone(target), m) if zone(target) else (lon, lat)


def straight(source: str, target: str) -> bool:
    """Whether axes go apart, so that the images of two corners bound a rectangle's."""
    return not zone(source) and not zone(target)


def bounds(source: str, target: str) -> dict[str, Column]:
    """Bounds (x_min, x_max, y_min, y_max) in another system: of both corners where axes go apart, or else
    of ALONG points along each side, as straight sides become curves."""
    names = ("x_min", "x_max", "y_min", "y_max")
    x0, x1, y0, y1 = (F.col(n) for n in names)
    if source == target or straight(source, target):
        (a, b), (c, d) = (transformed(source, target, x, y) for x, y in ((x0, y0), (x1, y1)))
        return dict(zip(names, (a, c, b, d), strict=True))
    shares = [k / ALONG for k in range(ALONG)]
    sides = [(x0 + s * (x1 - x0), y0) for s in shares] + [(x1, y0 + s * (y1 - y0)) for s in shares] + [(x1 - s * (x1 - x0), y1) for s in shares] + [(x0, y1 - s * (y1 - y0)) for s in shares]
    points = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in sides))
    axis = [F.transform(points, partial(lambda k, p: transformed(source, target, p["x"], p["y"])[k], k)) for k in (0, 1)]
    return dict(zip(names, (f(a) for a in axis for f in (F.array_min, F.array_max)), strict=True))


def bounds_of(box: list[float], source: str, target: str) -> list[float]:
    """The same for one rectangle."""
    x0, x1, y0, y1 = box
    s = np.linspace(0, 1, 33)
    x = np.concatenate([x0 + s * (x1 - x0), np.full(33, x1), x0 + s * (x1 - x0), np.full(33, x0)])
    y = np.concatenate([np.full(33, y0), y0 + s * (y1 - y0), np.full(33, y1), y0 + s * (y1 - y0)])
    u, v = transformed(source, target, x, y, ARRAYS)
    return [float(u.min()), float(u.max()), float(v.min()), float(v.max())]
