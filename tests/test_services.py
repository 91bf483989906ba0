"""Services, config values, image operators and the named steps of the sequential stage."""

import numpy as np
import pytest
from test_features import picture
from test_operators import scene

from skylattice.operators import image_ops, kernels
from skylattice.plans import services as sv, stages


def test_services_and_versions():
    made = []

    def plain(x, extra={"a": 1, "b": {"c": 2}}):  # noqa: B006
        made.append(x)
        return x, extra

    s = sv.Services({"plain": {"x": 1, "extra": {"b": {"d": 3}}}, "any": {"version": "double"}})
    s.register("plain", plain)
    assert s.get("plain") == (1, {"a": 1, "b": {"c": 2, "d": 3}})
    assert s.get("plain", x=7, extra={"a": 0}) == (7, {"a": 0, "b": {"c": 2, "d": 3}})
    s.register("double", lambda x=5: 2 * x)
    s.register("any")
    assert s.get("any") == 10 and s.get("any", version="plain")[0] == 1 and s.get("any", x=4) == 8
    s.register("one", lambda: object(), shared=True)
    assert s.get("one") is s.get("one")
    before = s.get("one")
    s.register("one", lambda: object(), shared=True)
    assert s.get("one") is not before
    for name in ("none", "nothing"):
        with pytest.raises(ValueError, match="no service"):
            s.get(name)


def test_config_values():
    got = sv.parsed({"random_state": None, "a": {"crs": 3857, "random_state": 7, "b": {"target_crs": "epsg:32616"}}, "crs": "EPSG:4326", "other": [1]})
    assert got == {"random_state": 0, "a": {"crs": "EPSG:3857", "random_state": 7, "b": {"target_crs": "EPSG:32616"}}, "crs": "EPSG:4326", "other": [1]}
    for bad in ({"crs": "EPSG:1"}, {"a": {"crs": 32661}}, {"random_state": -1}, {"random_state": "x"}, {"random_state": True}):
        with pytest.raises(ValueError):
            sv.parsed(bad)


def test_image_operators_and_queues():
    whole = picture(5).round().astype(np.uint8)
    piece = whole[40:150, 50:200]
    out = image_ops.aligner_blender()(piece, whole)
    assert out["return_code"] == "success" and out["determinant"] == pytest.approx(1, abs=0.05)
    held = out["image"].sum(2) > 0
    assert np.abs(out["image"].astype(int) - whole)[held].mean() < 4
    assert (image_ops.blender(piece, whole[:20, :30])["image"] == kernels.resize(piece.astype(float), 20, 30).round()).all()
    fail = lambda src, dst: {"return_code": "bad_det"}
    assert image_ops.queue(fail, image_ops.blender)(piece, whole)["i_operator"] == 1
    assert image_ops.queue(fail, fail)(piece, whole) == {"return_code": "bad_det", "i_operator": 1}
    strict = image_ops.variations({"det": (0.99999, 1.00001)}, [{}, {"det": (5, 6)}, {"det": (0.6, 1.7)}])(picture(5), kernels.warp(picture(5), np.diag([0.9, 0.9, 1]), 200, 260))
    assert strict["return_code"] == "success" and strict["i_operator"] == 2
    assert image_ops.variations({"bright": 10**9}, [])(piece, whole)["return_code"] == "dark_frame"
    with pytest.raises(ValueError):
        image_ops.queue()


def test_steps_variations_and_scores_of_the_stage(spark, tmp_path):
    whole = scene(100, 120).round().astype(np.uint8)
    piece = np.ascontiguousarray(whole[20:90, 30:110])
    bounds = "x_min double, x_max double, y_min double, y_max double"
    tables = {
        "referenced": ([(1, 0, 1000.0, 1480.0, 2000.0, 2400.0, 1240.0, 2200.0, 1250.0, 2210.0, 120, 100, 4.0, -4.0)], f"image_id long, camera_num int, {bounds}, x_center double, y_center double, sensor_x double, sensor_y double, x_size long, y_size long, pixel_width double, pixel_height double"),
        "metadata": ([(7, 0, 14000.0, 0.01, 1240.0, 2200.0), (8, 0, 100.0, 0.01, 1240.0, 2200.0)], "image_id long, camera_num int, mAltitude double, imuGyroMag double, sensor_x double, sensor_y double"),
        "pixels": ([(1, 100, 120, 3, bytearray(whole.tobytes())), (7, 70, 80, 3, bytearray(piece.tobytes())), (8, 70, 80, 3, bytearray(piece.tobytes()))], "image_id long, rows long, columns long, bands long, data binary"),
        "test": ([(7, 1120.0, 1440.0, 2040.0, 2320.0)], f"image_id long, {bounds}"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    stages.STEPS["only_seven"] = lambda rows, known, o: rows.where("image_id = 7")
    try:
        config = stages.merged({"options": stages.DEFAULTS["sequential_mosaicker"]}, {"stage": "sequential_mosaicker", "options": {"steps": ["only_seven", "registrar", "order"], "variations": [{"det": [5.0, 6.0]}, {}]}, "inputs": {n: {"path": str(tmp_path / n)} for n in tables}})
        out = stages.sequential(spark, config)
        row = {r["image_id"]: r for r in out["progress"].collect()}
        assert set(row) == {7} and row[7]["return_code"] == "success" and row[7]["log"]["i_operator"] == 1
        assert abs(row[7]["center_diff"]) <= 8 and out["mosaic"].count() > 0
        with pytest.raises(ValueError, match="unknown step"):
            stages.sequential(spark, stages.merged(config, {"options": {"steps": ["nowhere"]}}))
    finally:
        del stages.STEPS["only_seven"]
