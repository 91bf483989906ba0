"""TIFF files of every layout and compression by ranges, and as a data source."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.sources import files as fs, sinks, tiff
from skylattice.sources.tiff_source import register


def picture(rows, columns, bands, seed=0):
    rng = np.random.default_rng(seed)
    return np.cumsum(rng.integers(-3, 4, (rows, columns, bands)), 1).astype(np.uint8)


def test_lzw_there_and_back():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 256), (2, 256), (300, 2), (5000, 256), (70000, 3), (40000, 256), (511, 256), (4096 * 3, 17)):
        data = rng.integers(0, top, n).astype(np.uint8).tobytes()
        assert tiff.unpacked_lzw(tiff.packed_lzw(data)) == data
    for n in range(250, 520):  # where codes grow wider
        data = bytes((i * 7 + i // 256) % 256 for i in range(n))
        assert tiff.unpacked_lzw(tiff.packed_lzw(data)) == data
    with pytest.raises(ValueError, match="clear"):
        tiff.unpacked_lzw(bytes([0, 1, 2]))


@pytest.mark.parametrize("compression", ["none", "lzw", "deflate"])
@pytest.mark.parametrize(("tile", "predictor", "bands"), [(None, False, 1), (None, True, 3), (16, False, 3), (16, True, 1), (32, True, 4)])
def test_layouts(compression, tile, predictor, bands):
    m = picture(45, 70, bands)
    data = tiff.encoded(m.tobytes(), 45, 70, bands, (10.0, 80.0, -5.0, 40.0), tile, compression, predictor)
    t = tiff.Tiff(tiff.Ranges(data))
    assert (t.pixels() == m).all() and t.bounds() == (10.0, 80.0, -5.0, 40.0) and t.tiled == bool(tile)
    assert (t.pixels((9, 31, 40, 7)) == m[31:38, 9:49]).all()
    assert [t.block(i, j).shape[:2] for i, j in t.inside((64, 32, 1, 1))] == [(45, 70) if not tile else (13, 6) if tile == 16 else (13, 6)]
    with pytest.raises(ValueError, match="beyond"):
        t.pixels((60, 0, 11, 1))


def test_large_tiff_and_byte_order():
    """The 64-bit layout, highest byte first, two bytes a pixel, planes apart and differences."""
    m = np.random.default_rng(1).integers(0, 65536, (4, 6, 2)).astype(">u2")
    delta = np.diff(m.astype(np.uint16), axis=1, prepend=np.zeros((4, 1, 2), np.uint16)).astype(">u2")
    planes = [np.ascontiguousarray(delta[..., b]).tobytes() for b in (0, 1)]
    tags = [(256, 4, 1, 6), (257, 4, 1, 4), (258, 3, 2, struct.pack(">HH", 16, 16)), (259, 3, 1, 1), (273, 16, 2, None), (277, 3, 1, 2), (278, 3, 1, 4), (279, 4, 2, struct.pack(">II", 48, 48)), (284, 3, 1, 2), (317, 3, 1, 2)]
    after = 16 + 8 + 20 * len(tags) + 8
    body, extra = struct.pack(">Q", len(tags)), b""
    for tag, kind, n, value in tags:
        body += struct.pack(">HHQ", tag, kind, n)
        if value is None:
            body += struct.pack(">Q", after)
            extra = struct.pack(">QQ", after + 16, after + 64)
        elif isinstance(value, bytes):
            body += value.ljust(8, b"\0")
        else:
            body += struct.pack(">H6x" if kind == 3 else ">I4x", value)
    data = struct.pack(">2sHHHQ", b"MM", 43, 8, 0, 16) + body + struct.pack(">Q", 0) + extra + b"".join(planes)
    assert (tiff.Tiff(tiff.Ranges(data)).pixels() == m).all()
    for bad in (b"", b"II*\0", b"hello world, no image", data[:40]):
        with pytest.raises((ValueError, struct.error)):
            tiff.Tiff(tiff.Ranges(bad)).pixels()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tiff")
    rows = [(f"a/img{i}.tif", 300, 400, 3, bytearray(picture(300, 400, 3, i).tobytes()), 10.0 * i, 10.0 * i + 400, 0.0, 300.0) for i in range(4)]
    df = spark.createDataFrame(rows, "name string, rows long, columns long, bands long, data binary, x_min double, x_max double, y_min double, y_max double")
    assert sinks.save_images(df, str(where), 64, "deflate", True).count() == 4
    (where / "b").mkdir()
    (where / "b" / "broken.tif").write_bytes(b"II*\0 but not an image")
    (where / "b" / "empty.tiff").write_bytes(b"")
    (where / "b" / "notes.txt").write_bytes(b"x")
    register(spark)
    return where


def test_headers_cost_few_bytes(spark, folder):
    df = spark.read.format("tiff").load(str(folder))
    got = {r.filepath.rpartition("/")[2]: r for r in df.collect()}
    assert sorted(got) == ["broken.tif", "empty.tiff", *(f"img{i}.tif" for i in range(4))]
    assert (got["img2.tif"].x_min, got["img2.tif"].x_max, got["img2.tif"].x_size, got["img2.tif"].block_rows) == (20.0, 420.0, 400, 64)
    assert got["broken.tif"].x_size is None and all(r.bytes_read < 1 << 16 for r in got.values() if r.bytes_read is not None)
    assert (folder / "a" / "img0.tif").stat().st_size > 1 << 16
    heads = fs.geotiff_headers(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(folder)))
    assert heads.where("x_min is not null").count() == 4 and heads.where("x_min is null and x_size is null").count() == 2  # Spark lists no empty file


def test_filters_and_schemas_reach_the_reader(spark, folder):
    path = f"{folder}/a/img1.tif"
    read = spark.read.format("tiff").option("rows", "blocks").option("pattern", r"img\d\.tif$")
    one = read.load(str(folder)).where((F.col("filepath") == path) & (F.col("block_x") >= 5) & (F.col("block_y") < 2))
    assert sorted((r.block_x, r.block_y, r.rows, r.columns) for r in one.collect()) == [(5, 0, 64, 64), (5, 1, 64, 64), (6, 0, 64, 16), (6, 1, 64, 16)]
    assert one.rdd.getNumPartitions() == 1
    slim = read.schema("filepath string, block_x int, bytes_read long").load(str(folder))
    assert slim.count() == 4 * 7 * 5 and slim.agg(F.sum("bytes_read")).first()[0] == 0
    spread = spark.read.format("tiff").option("part_bytes", 1).load(str(folder))
    assert spread.rdd.getNumPartitions() == 6


def test_a_window_reads_its_tiles_only(spark, folder):
    got = spark.read.format("tiff").option("rows", "blocks").option("pattern", "img3").option("window", "60,130,10,40").load(str(folder)).collect()
    assert sorted((r.block_x, r.block_y) for r in got) == [(0, 2), (1, 2)]
    m = picture(300, 400, 3, 3)
    for r in got:
        part = np.frombuffer(r.data, np.uint8).reshape(r.rows, r.columns, r.bands)
        assert (part == m[r.y_off : r.y_off + r.rows, r.x_off : r.x_off + r.columns]).all()
    assert sum(r.bytes_read for r in got) < 3 * tiff.CHUNK + 2 * 64 * 64 * 3
    assert spark.read.format("tiff").option("rows", "blocks").option("pattern", "img3").option("window", "900,0,5,5").load(str(folder)).count() == 0
