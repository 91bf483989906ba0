import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import geo, predicate
from skylattice.operators import correlate as co, features, interpolate as ip, kernels, mosaic as mo, order as od, registrar as rg, scores as sc, sequential as sq
from skylattice.operators.graph import components

RASTER = {"x_min": 0.0, "x_max": 100.0, "y_min": 0.0, "y_max": 80.0, "pixel_width": 0.5, "pixel_height": -0.5}


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_predicate_grammar(spark):
    df = spark.createDataFrame([(1, 5.0, "x"), (2, 15.0, "y"), (3, None, "z")], "id long, `a b` double, s string")
    pick = lambda text: [r[0] for r in df.where(predicate.parse(text)).orderBy("id").collect()]
    assert pick("(`a b` > 3) & (id < 2)") == [1]
    assert pick("1 < id <= 3\n and s not in ['z']") == [2]
    assert pick("~(id == 1) | (s == 'x')") == [1, 2, 3]
    assert pick("`a b` * 2 - 1 >= 9") == [1, 2]
    for bad in ("@x > 1", "f(1)", "id.x", "1 +", "__import__('os')", "id < [1]"):
        with pytest.raises(predicate.PredicateError):
            predicate.parse(bad)


def test_interpolation_edges(spark):
    log = spark.createDataFrame([(10, 1.0), (20, 3.0), (20, 3.0), (40, None), (7200, 5.0)], "s long, v double").select(F.timestamp_seconds("s").alias("t"), "v")
    img = spark.createDataFrame([(i, s) for i, s in enumerate((5, 10, 15, 20, 30, 7000, 7200, 9000))], "id long, s long").select("id", F.timestamp_seconds("s").alias("t"))
    got = {r["id"]: r["v"] for r in ip.interpolate_at(img, log, "t", ["v"], bucket_us=30_000_000).collect()}
    assert got == {0: None, 1: 1.0, 2: 2.0, 3: 3.0, 4: None, 5: None, 6: None, 7: None}
    straight = log.where("v is not null")
    got = {r["id"]: r["v"] for r in ip.interpolate_at(img, straight, "t", ["v"], bucket_us=30_000_000).collect()}
    assert got[4] == pytest.approx(3 + 2 / 7180 * 10) and got[6] == 5.0 and got[7] is None


def test_unmatched_policies(spark):
    files = spark.createDataFrame([(0, "/a/x_1.tif"), (1, "/a/y.tif"), (2, "/a/not_a_file")], "file_id long, filepath string")
    log = spark.createDataFrame([("x_1.tif", "9", 1.0), ("other", "7", 2.0)], "filename string, timestamp_id string, v double")
    assert rows(co.correlate(files, log), "file_id") == [(0,)]
    assert co.correlate(files, log, unmatched="passthrough").where("not selected").count() == 2
    with pytest.raises(co.UnmatchedError):
        co.correlate(files, log, unmatched="error")
    with pytest.raises(ValueError):
        co.correlate(files, log, unmatched="?")


def test_pixel_round_trip_and_negative_control(spark):
    rng = np.random.default_rng(42)
    a = np.sort(rng.uniform(0, 100, (1000, 2)), 1)
    b = np.sort(rng.uniform(0, 80, (1000, 2)), 1)
    df = spark.createDataFrame([(i, *map(float, (*a[i], *b[i]))) for i in range(1000)], "image_id long, x_min double, x_max double, y_min double, y_max double")

    def off(raster):
        p = mo.pixel_rectangles(df, RASTER)
        back = geo.to_bounds(raster)
        return p.select(F.max(F.greatest(*(F.abs(back[n] - F.col(n)) for n in ("x_min", "x_max", "y_min", "y_max"))))).first()[0]

    assert off(RASTER) <= 0.5
    assert off(RASTER | {"pixel_height": -1.0}) > 10


def test_trim_shrinks_by_what_is_clipped(spark):
    df = spark.createDataFrame([(-5, -5, 10, 10), (95, 2, 10, 3), (200, 0, 5, 5), (0, 0, 10, 10)], "x_off long, y_off long, x_size long, y_size long")
    got = rows(df.select(*(v.alias(k) for k, v in geo.trimmed(100, 50).items())), "x_off", "y_off", "x_size", "y_size")
    assert got == sorted([(0, 0, 5, 5), (95, 2, 5, 3), (100, 0, 0, 5), (0, 0, 10, 10)])
    assert df.where(geo.inside(100, 50)).count() == 1


def test_blend_rules(spark):
    p = spark.createDataFrame([(0, 0, 1, 0, 7), (0, 0, 2, 5, 8), (0, 0, 3, 9, 9), (1, 0, 1, 0, 4), (1, 0, 2, 0, 6)], "x long, y long, order long, r int, a int")
    assert rows(mo.blend(p, ["r"], "a"), "x", "y", "r", "a") == [(0, 0, 5, 8), (1, 0, 0, 6)]
    assert rows(mo.blend(p, ["r"], fill=1), "x", "r", "alpha") == [(0, 5, 1), (1, 0, 1)]


def test_order_is_dense_and_total(spark):
    df = spark.range(1000).select(F.col("id").alias("image_id"), F.when(F.col("id") % 10 > 0, F.col("id") % 7).alias("k"))
    got = od.ordered(df, ["k"]).orderBy("order").collect()
    assert [r["order"] for r in got] == list(range(1000))
    assert [(r["k"] is None, r["k"] or 0, r["image_id"]) for r in got] == sorted((r["k"] is None, r["k"] or 0, r["image_id"]) for r in got)


def test_splits(spark):
    df = spark.range(500).withColumnRenamed("id", "image_id")
    assert od.split_exact(df, 100, 1).where("part = 'test'").count() == 100
    assert rows(od.split(df, 0.2, 1), "image_id", "part") == rows(od.split(df, 0.2, 1).repartition(7), "image_id", "part")
    one, two = (set(rows(od.downsample(df, 20, s), "image_id")) for s in (1, 2))
    assert len(one) == len(two) == 20 and one != two


def test_registrar_falls_back_for_unseen_cameras(spark):
    ref = spark.createDataFrame([(0, 10.0, 10.0, 13.0, 14.0, 0.0, 26.0, 4.0, 24.0, 10, 10, 1.0, -1.0)], "camera_num int, sensor_x double, sensor_y double, x_center double, y_center double, x_min double, x_max double, y_min double, y_max double, x_size long, y_size long, pixel_width double, pixel_height double")
    new = spark.createDataFrame([(1, 0, 100.0, 5.0, 5.0), (2, 1, 100.0, 5.0, 5.0)], "image_id long, camera_num int, mAltitude double, sensor_x double, sensor_y double")
    got = {r["image_id"]: r for r in rg.fit(ref).transform(new, {0: 0.0, 1: 40.0}).collect()}
    assert got[1]["spatial_error"] == 5.0 and got[1]["padding"] == 7.5 and got[1]["x_max"] - got[1]["x_min"] == 26
    assert got[2]["spatial_error"] == pytest.approx(100.0)


def test_scores_and_plumbing(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "id long, v double")
    b = spark.createDataFrame([(2, 5.0, "w"), (3, 6.0, "u")], "id long, v double, s string")
    assert sorted(map(tuple, sc.combine_first(a, b, ["id"]).collect())) == [(1, 2.0, None), (2, 5.0, "w"), (3, 6.0, "u")]
    with pytest.raises(sc.MissingColumns):
        sc.required(a, ["nope"])
    assert sc.required(b, ["id"], ["s"]).columns == ["id", "s"]
    codes = a.select(sc.return_code({"bad": F.col("v").isNull()})).collect()
    assert [r[0] for r in codes] == ["success", "bad"]


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 7), (8, 9)] + [(i, i + 1) for i in range(100, 160)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(e).collect()}
    assert got[5] == got[7] == 3 and got[9] == 8 and got[160] == 100
    assert components(e.limit(0)).count() == 0


def scene(h=120, w=160, seed=3):
    rng = np.random.default_rng(seed)
    image = np.zeros((h, w, 3))
    for _ in range(60):
        y, x, s = rng.integers(0, h - 12), rng.integers(0, w - 12), rng.integers(4, 12)
        image[y : y + s, x : x + s] = rng.integers(60, 255, 3)
    return kernels.blur(image[..., 0], 0.7)[..., None].repeat(3, 2)


def test_align_recovers_a_shift():
    full = scene()
    m = features.align(full[20:100, 30:130], full)
    assert np.allclose(m[:2, 2], [30, 20], atol=1) and np.allclose(m[:2, :2], np.eye(2), atol=0.05)
    for src, dst, code in ((np.zeros((40, 40, 3)), full, "dark_frame"), (full, np.zeros((40, 40, 3)), "dst_dark_frame")):
        with pytest.raises(kernels.ImageError, match=code):
            features.align(src, dst)


def test_homography_and_resize():
    m = np.array([[1.1, 0.1, 3], [-0.05, 0.95, 2], [1e-4, 2e-4, 1]])
    p = np.random.default_rng(0).uniform(0, 100, (20, 2))
    q = np.c_[p, np.ones(20)] @ m.T
    q = q[:, :2] / q[:, 2:]
    q[:4] += 50  # outliers
    assert np.allclose(kernels.consensus(p, q), m, atol=1e-4)
    image = scene()
    assert kernels.resize(image, 60, 80).shape == (60, 80, 3)
    assert np.allclose(kernels.resize(image, *image.shape[:2]), image)


def test_sequential_mosaic_places_images(spark):
    full = scene().round().astype(np.uint8)
    cut = lambda y, x, h, w: bytearray(full[y : y + h, x : x + w].tobytes())
    data = [
        (1, 0, 0, 0, 160, 120, 120, 160, 3, cut(0, 0, 120, 160)),
        (2, 1, 20, 10, 120, 100, 80, 100, 3, cut(20, 30, 80, 100)),
        (3, 2, 5000, 0, 50, 50, 50, 50, 3, bytearray(50 * 50 * 3)),
        (4, 3, 0, 0, 160, 120, 50, 50, 3, bytearray(50 * 50 * 3)),
    ]
    df = spark.createDataFrame(data, "image_id long, order long, x_off long, y_off long, x_size long, y_size long, rows long, columns long, bands long, data binary")
    assert {r["image_id"]: r["component"] for r in sq.fold_groups(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}
    got = {r["image_id"]: r for r in sq.sequential_mosaic(df).collect()}
    assert got[1]["return_code"] == "success" and got[4]["return_code"] == "dark_frame" and got[3]["return_code"] == "success"
    assert got[2]["return_code"] == "success" and abs(got[2]["x_off"] - 30) <= 1 and abs(got[2]["y_off"] - 20) <= 1


def test_bounds_there_and_back(spark):
    df = spark.createDataFrame([(-87.5, -87.1, 40.0, 40.3), (0.0, 1.0, 0.0, 1.0)], "x_min double, x_max double, y_min double, y_max double")
    there = df.select(*(v.alias(k) for k, v in geo.reprojected("EPSG:4326", "EPSG:3857").items()))
    back = there.select(*(v.alias(k) for k, v in geo.reprojected("EPSG:3857", "EPSG:4326").items()))
    assert np.allclose(back.toPandas(), df.toPandas(), atol=1e-9) and abs(there.first()["x_min"]) > 1e6
    with pytest.raises(ValueError):
        geo.reprojected("EPSG:4326", "EPSG:2154")


def test_progress_images(spark, tmp_path):
    from skylattice.sources import sinks

    df = spark.createDataFrame([(1, 0, "success", 2, 3, bytearray(18)), (2, 1, "bad_det", None, None, None), (3, 2, "success", 1, 1, bytearray(3))], "image_id long, order long, return_code string, x_size long, y_size long, data binary")
    assert sorted(r["name"] for r in sinks.progress_images(df, ["success", "bad_det"], str(tmp_path)).collect()) == ["000000_1.tif", "000002_3.tif"]
