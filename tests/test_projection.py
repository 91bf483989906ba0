"""The grid of transverse zones: known points, round trips over a whole zone, and rasters on grids of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import geo, projection as pr
from skylattice.operators import kernels


def test_known_points():
    # a tower at 43 38 33.24 N, 79 23 13.7 W is at 630084 m east and 4833438 m north of zone 17
    east, north = pr.transformed("EPSG:4326", "EPSG:32617", -(79 + 23 / 60 + 13.7 / 3600), 43 + 38 / 60 + 33.24 / 3600, pr.ARRAYS)
    assert abs(east - 630084) < 1 and abs(north - 4833438) < 1
    assert pr.transformed("EPSG:4326", "EPSG:32631", 3.0, 0.0, pr.ARRAYS) == pytest.approx((500000, 0), abs=1e-6)
    assert pr.transformed("EPSG:4326", "EPSG:32731", 3.0, 0.0, pr.ARRAYS) == pytest.approx((500000, 1e7), abs=1e-6)
    # a quarter of the meridian is 10,001,965.729 m long
    assert pr.transformed("EPSG:4326", "EPSG:32631", 3.0, 90.0 - 1e-7, pr.ARRAYS)[1] == pytest.approx(0.9996 * 10001965.729, abs=2e-2)


@pytest.mark.parametrize("system", ["EPSG:32601", "EPSG:32633", "EPSG:32760", "EPSG:3857"])
def test_round_trip_below_a_millimetre(system):
    middle = pr.zone(system)[0] if pr.zone(system) else 0
    lon, lat = np.meshgrid(middle + np.linspace(-3.5, 3.5, 61), np.linspace(-84, 84, 169))
    x, y = pr.transformed("EPSG:4326", system, lon, lat, pr.ARRAYS)
    back = pr.transformed(system, "EPSG:4326", x, y, pr.ARRAYS)
    assert np.abs(back[0] - lon).max() * 111320 < 1e-3 and np.abs(back[1] - lat).max() * 111320 < 1e-3


def test_columns_equal_arrays(spark):
    rng = np.random.default_rng(0)
    lon, lat = rng.uniform(6, 12, 50), rng.uniform(-80, 84, 50)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon, lat, strict=True)], "x double, y double")
    for system in ("EPSG:32632", "EPSG:32732", "EPSG:3857"):
        got = np.array(df.select(*pr.transformed("EPSG:4326", system, F.col("x"), F.col("y"))).collect())
        assert np.allclose(got.T, pr.transformed("EPSG:4326", system, lon, lat, pr.ARRAYS), rtol=0, atol=1e-6)


def test_bounds_hold_every_point(spark):
    box = [13.0, 16.0, 50.0, 53.0]
    df = spark.createDataFrame([tuple(box)], "x_min double, x_max double, y_min double, y_max double")
    got = df.select(*(v.alias(k) for k, v in geo.reprojected("EPSG:4326", "EPSG:32633").items())).first()
    x, y = np.meshgrid(np.linspace(13, 16, 50), np.linspace(50, 53, 50))
    u, v = pr.transformed("EPSG:4326", "EPSG:32633", x, y, pr.ARRAYS)
    assert got.x_min <= u.min() + 1 and got.x_max >= u.max() - 1 and got.y_min <= v.min() + 60 and got.y_max >= v.max() - 1
    assert pr.bounds_of(box, "EPSG:4326", "EPSG:32633") == pytest.approx(list(got), rel=1e-3)
    for bad in ("EPSG:32600", "EPSG:32661", "EPSG:1", "x"):
        with pytest.raises(ValueError, match="no transformation"):
            pr.transformed("EPSG:4326", bad, 0.0, 0.0, pr.ARRAYS)


def test_rasters_on_a_grid_of_their_own():
    """A smooth picture keeps its values at the same places, on a grid of another shape, and is 0 outside."""
    box, (h, w) = [13.0, 17.0, 50.0, 52.0], (120, 240)
    lon, lat = np.meshgrid(13 + (np.arange(w) + 0.5) / 60, 52 - (np.arange(h) + 0.5) / 60)
    shade = lambda lon, lat: 120 + 60 * np.sin(2 * lon) + 50 * np.cos(3 * lat)
    m, to = kernels.reprojected(shade(lon, lat)[..., None], box, "EPSG:4326", "EPSG:32633")
    assert m.shape[:2] != (h, w) and abs(np.hypot(*m.shape[:2]) - np.hypot(h, w)) < 2
    x = to[0] + (np.arange(m.shape[1]) + 0.5) * (to[1] - to[0]) / m.shape[1]
    y = to[3] - (np.arange(m.shape[0]) + 0.5) * (to[3] - to[2]) / m.shape[0]
    there = pr.transformed("EPSG:32633", "EPSG:4326", *np.meshgrid(x, y), pr.ARRAYS)
    inside = (there[0] > 13.02) & (there[0] < 16.98) & (there[1] > 50.02) & (there[1] < 51.98)
    assert np.abs(m[..., 0] - shade(*there))[inside].max() < 1 and (m[..., 0][(there[0] < 12.99) | (there[1] > 52.01)] == 0).all()
    back, box2 = kernels.reprojected(m, to, "EPSG:32633", "EPSG:4326")
    assert box2[0] <= 13 and box2[3] >= 52


def test_halves_are_rounded_as_sql_does(spark):
    import duckdb

    from skylattice.queries import rounded

    values = [(k + 0.5) / 10**4 for k in range(-3000, 3000, 7)] + [1e9 + 0.00005, 0.0]
    got = [r.v for r in rounded(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()]
    assert got == [r[0] for v in values for r in duckdb.sql(f"SELECT round({v!r}::DOUBLE, 4)").fetchall()]


def test_floating_pixels_are_not_rounded():
    m = np.linspace(0.0, 1.0, 64).reshape(8, 8, 1)
    got, _ = kernels.reprojected(m, [10.0, 12.0, 40.0, 44.0], "EPSG:4326", "EPSG:3857")
    assert got.dtype == float and got[0, 0, 0] == pytest.approx(0.0, abs=0.02) and 0 < got[3, 3, 0] < 1
    assert kernels.reprojected((m * 200).astype(np.uint8), [10.0, 12.0, 40.0, 44.0], "EPSG:4326", "EPSG:3857")[0].dtype == np.uint8
