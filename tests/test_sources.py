import zlib

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from skylattice.functions import dictionary
from skylattice.operators import tiles
from skylattice.plans import batches, stages
from skylattice.sources import files as fs, logs as lg, sinks, tiff
from skylattice.sources.tiff import encoded
from skylattice.streaming import incremental as inc


@pytest.fixture()
def folder(tmp_path):
    pixels = np.random.default_rng(1).integers(0, 255, (80, 100, 3), dtype=np.uint8)
    (tmp_path / "img" / "deep").mkdir(parents=True)
    (tmp_path / "img" / "Geo 1_0.tif").write_bytes(encoded(pixels.tobytes(), 80, 100, 3, (0.0, 200.0, 10.0, 90.0)))
    (tmp_path / "img" / "deep" / "a_1.raw").write_bytes(np.full((4, 6), 4095, "<u2").tobytes())
    (tmp_path / "img" / "notes.txt").write_text("x")
    return tmp_path, pixels


def test_discovery(spark, folder):
    d = str(folder[0] / "img")
    assert fs.find_files(spark, d).count() == 3
    assert fs.find_selected_files(spark, d, [r"\.tif", r"\.raw"]).count() == 2
    assert fs.find_input_files(spark, {"directory": "img", "pattern": "Geo"}, str(folder[0])).count() == 1
    assert fs.find_input_files(spark, "a.csv", "/x") == "/x/a.csv"
    with pytest.raises(ValueError):
        fs.find_input_files(spark, {"extension": "x"})
    with pytest.raises(Exception, match="(?i)path"):
        fs.find_files(spark, d + "/nowhere").count()


def test_headers_and_pixels(spark, folder):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(folder[0] / "img"))
    got = {r["filepath"].rpartition("/")[2]: r for r in fs.geotiff_headers(files).collect()}
    tif = got["Geo 1_0.tif"]
    assert (tif["x_min"], tif["x_max"], tif["y_min"], tif["y_max"], tif["pixel_width"], tif["pixel_height"]) == (0, 200, 10, 90, 2, -1)
    assert tif["padding"] == pytest.approx(0.1 * np.hypot(200, 80)) and got["a_1.raw"]["x_min"] is None
    images = {r["filepath"].rpartition(".")[2]: r for r in fs.load_images(files.where("path not like '%.txt'"), (4, 6)).collect()}
    assert bytes(images["tif"]["data"]) == folder[1].tobytes()
    assert set(images["raw"]["data"]) == {255} and images["raw"]["rows"] == 4
    with pytest.raises(Exception, match="cannot read"):
        fs.load_images(files, (4, 6)).collect()


def test_write_images_round_trip(spark, folder):
    df = spark.createDataFrame([("o/a.tif", 80, 100, 3, bytearray(folder[1].tobytes()))], "name string, rows long, columns long, bands long, data binary")
    assert sinks.save_images(df, str(folder[0] / "out")).count() == 1
    back = fs.load_images(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(folder[0] / "out"))).first()
    assert bytes(back["data"]) == folder[1].tobytes()


def test_output_policies(spark, tmp_path):
    df, p = spark.range(3), str(tmp_path / "t")
    assert sinks.save_table(df, p) == p
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.save_table(df, p)
    assert sinks.save_table(spark.range(9), p, "pass") == p and spark.read.parquet(p).count() == 3
    assert sinks.save_table(spark.range(9), p, "overwrite") == p and spark.read.parquet(p).count() == 9
    assert [sinks.save_table(df, p, "new") for _ in range(2)] == [f"{p}_v000", f"{p}_v001"]
    calls = []
    make = lambda: calls.append(1) or spark.range(4)
    for _ in range(2):
        assert fs.cached_or(spark, str(tmp_path / "cache"), make).count() == 4
    assert len(calls) == 1


def test_imu_log_voids_rows(spark):
    rows = [("2022-01-01 00:00:00", "20", "900", "100", "0", "3", "4"), ("CurrTimestamp", *["pressure"] * 6), ("2022-01-01 00:00:01", "20", "-1", "100", "1", "1", "1"), ("2022-01-01 00:00:02", "20", "900", "30000", "NaN", "1", "1"), (None, *["1"] * 6)]
    df = spark.createDataFrame(rows, "CurrTimestamp string, TempC string, pressure string, mAltitude string, imuGyroX string, imuGyroY string, imuGyroZ string")
    got = lg.imu_log(df).collect()
    assert len(got) == 3 and sum(r["CurrTimestamp"] is None for r in got) == 1
    high = [r for r in got if r["CurrTimestamp"] and r["CurrTimestamp"].second == 2][0]
    assert high["mAltitude"] is None and high["pressure"] is None and high["imuGyroX"] is None
    assert got[0]["imuGyroMag"] == 5.0


def test_metadata_stage_reruns_equal(spark, tmp_path):
    (tmp_path / "img").mkdir()
    lines = []
    for i in range(6):
        (tmp_path / "img" / f"i{i}.tif").write_bytes(b"x")
        lines.append(f"01-01 05:00:{10 * i:02d}, 20220101_050000_{i - 3},0,1,1,1,1,/d/i{i}.tif,u,v")
    (tmp_path / "img" / "not_a_file.tif").write_bytes(b"x")
    (tmp_path / "log.txt").write_text("\n".join(lines))
    head = "CurrTimestamp,TempC,pressure,mAltitude,imuGyroX,imuGyroY,imuGyroZ"
    body = [f"2022-01-01 10:00:{s:02d},1,900,{100 + s},0,0,{s}" for s in range(0, 60, 5)]
    (tmp_path / "imu.csv").write_text("\n".join([head, *body[:3], head, *body[3:]]))
    (tmp_path / "gps.csv").write_text("\n".join(["CurrTimestamp,GPSLat,GPSLong", *(f"2022-01-01 10:00:{s:02d},45,{s}" for s in range(0, 60, 5)), "00.00.0000 00:00:00000,0,0"]))
    config = {
        "stage": "metadata_processor", "output": str(tmp_path / "out"), "options": {"patterns": []},
        "inputs": {"images": {"directory": str(tmp_path / "img"), "extension": r"\.tif"}, "img_log": {"path": str(tmp_path / "log.txt"), "format": "text"}, "imu_log": {"path": str(tmp_path / "imu.csv"), "format": "csv"}, "gps_log": {"path": str(tmp_path / "gps.csv"), "format": "csv"}},
    }
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(config))
    saved = stages.load_config(str(tmp_path / "c.yaml"))
    first = spark.read.parquet(stages.run(spark, saved)["metadata"])
    again = spark.read.parquet(stages.run(spark, saved | {"exists": "new"})["metadata"])
    assert first.count() == 6 and first.exceptAll(again).count() == 0
    assert [r[0] for r in first.orderBy("filename").select("mAltitude").collect()] == [100.0 + 10 * i for i in range(6)]
    assert first.where("sensor_x is null").count() == 0
    assert stages.run(spark, saved | {"exists": "new"}, validate_only=True).keys() == {"counts"}
    with pytest.raises(ValueError):
        stages.run(spark, {"stage": "nope"})


def test_query_stage(spark, tmp_path):
    spark.createDataFrame([(1, 14000.0, 0.01, "/a/x.tif"), (2, 100.0, 0.01, "/a/y.tif"), (3, 15000.0, 0.02, None)], "image_id long, mAltitude double, imuGyroMag double, output_filepath string").write.parquet(str(tmp_path / "m"))
    (tmp_path / "f").mkdir()
    for n in ("x.tif", "y.tif"):
        (tmp_path / "f" / n).write_bytes(b"1")
    config = stages.merged({"options": stages.DEFAULTS["query_processor"]}, {"stage": "query_processor", "options": {"condition": "(mAltitude > 13000.) &(imuGyroMag < 0.075)"}, "inputs": {"metadata": {"path": str(tmp_path / "m")}, "files": {"directory": str(tmp_path / "f")}}})
    assert [r["image_id"] for r in stages.query(spark, config)["selected"].collect()] == [1]


def test_streaming_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "flight_id long, image_id long, ts timestamp, return_code string"
    part = lambda lo, hi: spark.range(lo, hi).select((F.col("id") % 2).alias("flight_id"), F.col("id").alias("image_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit("success").alias("return_code"))
    for lo, hi in ((0, 10), (10, 16)):
        part(lo, hi).write.mode("append").parquet(src)
        inc.run_to_end(inc.numbered(inc.read_new_files(spark, src, schema)), out, ck)
    got = spark.read.parquet(out)
    assert sorted(tuple(r) for r in got.collect()) == sorted((i % 2, i, i // 2) for i in range(16))
    inc.run_to_end(inc.windowed_outcomes(inc.read_new_files(spark, src, schema), width="5 minutes"), out + "w", ck + "w")
    assert spark.read.parquet(out + "w").where("n = 5").count() >= 1


def test_dictionary(spark):
    df = dictionary.documented(spark.range(1).selectExpr("id AS image_id", "1.0 AS other"))
    assert df.schema["image_id"].metadata["description"] == "identity of an image"
    assert {r["name"]: r["description"] for r in dictionary.described(df).collect()}["other"] == "no description"


def test_strips_and_planes():
    pixels = np.random.default_rng(4).integers(0, 9, (6, 5, 3), dtype=np.uint8)
    plain = encoded(pixels.tobytes(), 6, 5, 3)
    tags = tiff.tags_of(tiff.Ranges(plain))
    at, n = int(tags[tiff.STRIPS][0]), int(tags[tiff.SIZES][0])

    def changed(raw, compression, planar=1):
        """The same file with another strip at its end."""
        data = bytearray(plain) + raw
        table = int.from_bytes(data[4:8], "little")
        for i in range(int.from_bytes(data[table : table + 2], "little")):
            e = table + 2 + 12 * i
            value = {tiff.COMPRESSION: compression, tiff.STRIPS: len(plain), tiff.SIZES: len(raw), tiff.PLANAR: planar}.get(int.from_bytes(data[e : e + 2], "little"))
            if value is not None:
                data[e + 8 : e + 12] = value.to_bytes(4, "little")
        return bytes(data)

    raw = plain[at : at + n]
    bits = b"".join(bytes([len(raw[i : i + 100]) - 1]) + raw[i : i + 100] for i in range(0, n, 100)) + bytes([128])
    for data in (changed(raw, 1), changed(zlib.compress(raw), 8), changed(bits, 32773), changed(np.moveaxis(pixels, 2, 0).tobytes(), 1, 2)):
        assert (fs.tiff_pixels(data) == pixels).all()
    assert tiff.unpacked_bits(bytes([254, 7, 1, 3, 4])) == bytes([7, 7, 7, 3, 4])
    with pytest.raises(ValueError):
        fs.tiff_pixels(changed(raw, 5))
    assert fs.rescaled(np.array([0, 255], np.uint8), "f4").tolist() == [0.0, 1.0] and fs.rescaled(np.array([65535], np.uint16), "u1").tolist() == [255]


def test_reprojection_there_and_back(spark, folder):
    files = spark.read.format("binaryFile").load(str(folder[0] / "img" / "*.tif"))
    one = fs.load_referenced(files).first()
    assert bytes(one["data"]) == folder[1].tobytes() and (one["x_max"], one["y_max"]) == (200, 90)
    there = fs.load_referenced(files, "EPSG:3857", "EPSG:4326").first()
    assert there["x_max"] == pytest.approx(np.degrees(200 / 6378137.0)) and bytes(there["data"]) == folder[1].tobytes()  # so near the equator nothing moves
    with pytest.raises(Exception, match="no transformation"):
        fs.load_referenced(files, "EPSG:3857", "EPSG:1").collect()


def test_coerced_inputs(spark):
    assert fs.as_files(spark, ["a", "b"]).count() == 2
    assert fs.as_files(spark, spark.range(1).selectExpr("'x' AS url")).columns == ["filepath"]
    assert fs.as_files(spark, spark.range(1).selectExpr("'x' AS filepath", "id")).columns == ["filepath", "id"]
    with pytest.raises(ValueError):
        fs.as_files(spark, spark.range(1).selectExpr("id", "id AS b"))


def test_copies_of_one_name_stay_apart(spark, tmp_path):
    df = spark.createDataFrame([("/a/x.tif", bytearray(b"1")), ("/b/x.tif", bytearray(b"2")), ("/b/y.tif", bytearray(b"3"))], "filepath string, content binary")
    copied = {r["filepath"]: r["copied"] for r in sinks.copy_files(df, str(tmp_path / "c")).collect()}
    assert len(set(copied.values())) == 3 and copied["/b/y.tif"].endswith("c/y.tif")
    assert {open(p, "rb").read() for p in copied.values()} == {b"1", b"2", b"3"}
    sinks.write_file(f"file://{tmp_path}/uri/z", b"z")
    assert (tmp_path / "uri" / "z").read_bytes() == b"z"


def test_mosaic_stage_from_files(spark, tmp_path):
    (tmp_path / "img").mkdir()
    full = lambda v: np.full((10, 10, 3), v, np.uint8).tobytes()
    (tmp_path / "img" / "a.tif").write_bytes(encoded(full(40), 10, 10, 3, (0.0, 20.0, 0.0, 20.0)))
    (tmp_path / "img" / "b.tif").write_bytes(encoded(full(90), 10, 10, 3, (10.0, 30.0, 0.0, 20.0)))
    (tmp_path / "img" / "plain.tif").write_bytes(encoded(full(1), 10, 10, 3))
    config = stages.merged({"options": stages.DEFAULTS["mosaicker"]}, {"stage": "mosaicker", "options": {"padding_fraction": 0.0}, "inputs": {"images": {"directory": str(tmp_path / "img"), "extension": r"\.tif"}}, "output": str(tmp_path / "out")})
    where = stages.run(spark, config)
    got = {(r["x"], r["y"]): r["r"] for r in tiles.pixels_of(spark.read.parquet(where["mosaic"]), 256, ["r"]).collect()}
    assert len(got) == 150 and got[9, 0] == 40 and got[10, 9] == 90 and got[5, 5] == 40  # 2 m pixels: 15 x 10
    assert spark.read.parquet(where["footprints"]).count() == 2
    assert stages.run(spark, config | {"exists": "pass"}) == where


def test_sequential_stage_with_training_mosaic(spark, tmp_path):
    """A referenced image is the training mosaic; a raw one cut from it is found and gets its true bounds."""
    from test_operators import scene

    whole = scene(100, 120).round().astype(np.uint8)
    piece = np.ascontiguousarray(whole[20:90, 30:110])
    bounds = "x_min double, x_max double, y_min double, y_max double"
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, 0, 1000.0, 1480.0, 2000.0, 2400.0, 1240.0, 2200.0, 1250.0, 2210.0, 120, 100, 4.0, -4.0)], f"image_id long, camera_num int, {bounds}, x_center double, y_center double, sensor_x double, sensor_y double, x_size long, y_size long, pixel_width double, pixel_height double").write.parquet(str(tmp_path / "in" / "referenced"))
    spark.createDataFrame([(7, 0, 14000.0, 0.01, 1240.0, 2200.0), (8, 0, 100.0, 0.01, 1240.0, 2200.0), (9, 0, 14000.0, 0.01, 91240.0, 2200.0)], "image_id long, camera_num int, mAltitude double, imuGyroMag double, sensor_x double, sensor_y double").write.parquet(str(tmp_path / "in" / "metadata"))
    rows = [(1, 100, 120, 3, bytearray(whole.tobytes())), (7, 70, 80, 3, bytearray(piece.tobytes())), (9, 70, 80, 3, bytearray(piece.tobytes()))]
    spark.createDataFrame(rows, "image_id long, rows long, columns long, bands long, data binary").write.parquet(str(tmp_path / "in" / "pixels"))
    config = stages.merged({"options": stages.DEFAULTS["sequential_mosaicker"]}, {"stage": "sequential_mosaicker", "inputs": {n: {"path": str(tmp_path / "in" / n)} for n in ("referenced", "metadata", "pixels")}})
    got = {r["image_id"]: r for r in stages.sequential(spark, config)["progress"].collect()}
    assert {i: r["return_code"] for i, r in got.items()} == {7: "success", 9: "dst_dark_frame"}  # 8 flies too low
    true = {"x_min": 1120, "x_max": 1440, "y_min": 2040, "y_max": 2320}
    assert all(abs(got[7][k] - v) <= 8 for k, v in true.items()) and got[9]["x_min"] is None


def test_query_stage_copies_files(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for n in ("x.tif", "y.tif"):
        (tmp_path / "f" / n).write_bytes(n.encode())
    spark.createDataFrame([(1, 14000.0, "/a/x.tif"), (2, 100.0, "/a/y.tif")], "image_id long, mAltitude double, output_filepath string").write.parquet(str(tmp_path / "m"))
    config = {"stage": "query_processor", "options": {"condition": "mAltitude > 13000.", "copy_to": str(tmp_path / "c")}, "inputs": {"metadata": {"path": str(tmp_path / "m")}, "files": {"directory": str(tmp_path / "f"), "extension": r"\.tif"}}, "output": str(tmp_path / "o")}
    stages.run(spark, config)
    assert [p.name for p in (tmp_path / "c").iterdir()] == ["x.tif"]


def test_batches_resume(spark, tmp_path):
    rows, path = spark.range(10).selectExpr("id AS image_id", "id AS order"), str(tmp_path / "log")
    seen = []

    def process(df):
        seen.append(sorted(r[0] for r in df.select("image_id").collect()))
        return df.where("image_id <> 3") if len(seen) == 1 else df

    assert batches.restored(spark, path) is None
    batches.resumed(rows, path, process, start=1, most=4)
    (tmp_path / "log" / "part=000001").mkdir()  # a run that died
    assert len(batches.versions(spark, path)) == 1
    batches.resumed(rows, path, process, start=1)
    assert seen == [[1, 2, 3, 4], [3, 5, 6, 7, 8, 9]]
    before = sorted(map(tuple, batches.restored(spark, path).collect()))
    batches.prune(spark, path)
    assert len(batches.versions(spark, path)) == 1 and sorted(map(tuple, batches.restored(spark, path).collect())) == before


def test_command_line(spark, tmp_path, capsys):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"stage": "base", "inputs": {"t": {"path": str(tmp_path / "t")}}, "output": str(tmp_path / "o")}))
    stages.main([str(tmp_path / "c.yaml")])
    assert "counts" in capsys.readouterr().out
    saved = yaml.safe_load((tmp_path / "o" / "settings.yaml").read_text())
    assert saved["config"]["stage"] == "base" and "mosaicker" in saved["stages"]


def test_sql_source(spark):
    """Reading through a database driver: the in-memory one that comes with Spark."""
    url = "jdbc:derby:memory:sky;create=true"
    spark.range(4).write.jdbc(url, "t", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    assert fs.read_jdbc(spark, url, "t", driver="org.apache.derby.jdbc.EmbeddedDriver").count() == 4


def test_colours_are_interpolated():
    """A flat field stays flat, each site keeps its own colour, and a ramp is followed inside."""
    flat = fs.raw_pixels(np.full((6, 8), 4095, "<u2").tobytes(), 6, 8)
    assert flat.shape == (6, 8, 3) and (flat == 255).all()
    y, x = np.mgrid[:10, :12]
    ramp = (100 * x + 60 * y).astype("<u2")
    m = fs.raw_pixels(ramp.tobytes(), 10, 12).astype(int)
    want = (ramp.astype(float) / 4095 * 255).astype(np.uint8).astype(int)
    assert np.abs(m - want[..., None])[1:-1, 1:-1].max() <= 1
    own = np.where((y % 2 == 0) & (x % 2 == 0), 0, np.where(y % 2 != x % 2, 1, 2))
    assert (np.take_along_axis(m, own[..., None], 2)[..., 0] == want).all()


def test_images_are_handed_on_by_bytes():
    rows = [(i, bytes(10) if i % 3 else None) for i in range(20)]
    parts = list(fs.in_parts(iter(rows), ["i", "data"], 30))
    assert [r for p in parts for r in p["i"]] == list(range(20))
    assert all(sum(len(x or b"") for x in p["data"]) <= 30 for p in parts) and len(parts) > 3
