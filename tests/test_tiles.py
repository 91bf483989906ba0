"""Tile rasters and sequential mosaics in waves against plain folds over a whole canvas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import image_ops, kernels, mosaic as mo, sequential as sq, tiles as ti

IMAGES = "image_id long, order long, x_off long, y_off long, x_size long, y_size long, rows long, columns long, bands long, data binary"


def random_images(n, seed, bands=2, span=60, size=20, dark=0.3):
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        h, w = rng.integers(1, size, 2)
        m = rng.integers(0, 256, (h, w, bands)).astype(np.uint8)
        m[rng.random((h, w)) < dark] = 0
        x, y = rng.integers(-span // 2, span, 2)
        out.append((i, int(rng.permutation(n)[0]), int(x), int(y), int(w), int(h), int(h), int(w), bands, bytearray(m.tobytes())))
    return out


def plain_fold(rows, aligner=None, strict=(), lo=-40, hi=200):
    """Outcome codes and the canvas after folding the rows in order, one after the other."""
    bands = rows[0][8]
    canvas, codes = np.zeros((hi - lo, hi - lo, bands), np.uint8), {}
    for r in sorted(rows, key=lambda r: (r[0] not in strict, r[1], r[0])):
        i, _, x, y, w, h, rr, cc, b, data = r
        held = canvas[y - lo : y - lo + h, x - lo : x - lo + w]
        code, drawn, _ = sq.fold_step(np.frombuffer(bytes(data), np.uint8).reshape(rr, cc, b), held, None if i in strict else aligner, bool(strict))
        codes[i] = code
        if drawn is not None:
            free = held.sum(2, dtype=int) == 0
            held[free] = drawn[free]
    return codes, canvas


def canvas_of(raster, tile, bands, lo=-40, hi=200):
    out = np.zeros((hi - lo, hi - lo, bands), int)
    for r in ti.pixels_of(raster, tile, [f"b{i}" for i in range(bands)]).collect():
        out[r.y - lo, r.x - lo] = [r[f"b{i}"] for i in range(bands)]
    return out


@pytest.mark.parametrize("alpha", [False, True])
def test_merged_tiles_equal_the_pixel_blend(spark, alpha, monkeypatch):
    monkeypatch.setattr(ti, "BLOCK", 5)  # many blocks a tile
    rows = random_images(60, 1)
    rows = [(*r[:1], i * 3 % 61, *r[2:]) for i, r in enumerate(rows)]  # orders differ, as the pixel blend has no ties
    images = spark.createDataFrame(rows, IMAGES)
    raster = ti.merged(ti.pieces(images, 16), 16, alpha)
    names = ["r", "a"]
    want = mo.blend(mo.resampled(images, names), ["r"] if alpha else names, "a" if alpha else None)
    got = ti.pixels_of(raster, 16, names)
    pick = names if alpha else names[:2]
    assert sorted(got.select("x", "y", *pick).collect()) == sorted(want.select("x", "y", *pick).collect())
    assert raster.count() == raster.select("tile_x", "tile_y").distinct().count()
    assert ti.window(raster, (0, 0, 16, 17), 16).select("tile_x", "tile_y").distinct().count() <= 2


def test_an_image_is_resized_to_its_rectangle(spark):
    m = np.arange(1, 17, dtype=np.uint8).reshape(4, 4, 1)
    images = spark.createDataFrame([(1, 0, 3, 5, 8, 2, 4, 4, 1, bytearray(m.tobytes())), (2, 1, 0, 0, 0, 4, 4, 4, 1, bytearray(16))], IMAGES)
    got = ti.pixels_of(ti.merged(ti.pieces(images, 4), 4), 4, ["v"])
    assert sorted(got.collect()) == sorted(mo.resampled(images, ["v"]).select("x", "y", "v").collect())


@pytest.mark.parametrize(("seed", "most"), [(1, 256), (2, 3)])
def test_waves_equal_the_plain_fold(spark, seed, most, monkeypatch):
    """Unaligned: each pixel is the first in order that isn't black, whatever cells and waves there were."""
    monkeypatch.setattr(sq, "CELL", 4)
    monkeypatch.setattr(sq, "CELL_IMAGES", most)
    rows = random_images(50, seed)
    out, raster = sq.sequential_tiles(spark.createDataFrame(rows, IMAGES).repartition(3), 8, None)
    codes, canvas = plain_fold(rows)
    assert {r.image_id: r.return_code for r in out.collect()} == codes
    assert (canvas_of(raster, 8, 2) == canvas).all()


@pytest.mark.parametrize("strict", [(), (3, 8, 30)])
def test_unaligned_images_take_no_waves(spark, strict, monkeypatch):
    """Six times the images over one place take as many jobs, and give the plain fold."""
    monkeypatch.setattr(sq, "CELL_IMAGES", 2)
    monkeypatch.setattr(ti, "BLOCK", 7)
    jobs = []
    for n in (10, 60):
        rows = random_images(n, 9, span=12)
        df = spark.createDataFrame(rows, IMAGES)
        df = df.withColumn("training", F.col("image_id").isin(*strict)) if strict else df
        spark.sparkContext.setJobGroup(f"unaligned {strict} {n}", "")
        try:
            out, raster = sq.sequential_tiles(df, 8, None)
            codes, canvas = plain_fold(rows, strict=strict)
            assert {r.image_id: r.return_code for r in out.collect()} == codes
            assert (canvas_of(raster, 8, 2) == canvas).all()
            jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"unaligned {strict} {n}")))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


@pytest.fixture
def by_shift():
    """A quick aligner that depends on all of the window, to tell one order of folding from another."""

    def aligner(src, dst):
        total = int(dst.sum())
        if total == 0:
            raise kernels.ImageError("dst_dark_frame")
        if total % 7 == 0:
            raise kernels.ImageError("bad_det")
        return np.array([[1.0, 0, total % 3], [0, 1, total % 2], [0, 0, 1]])

    return image_ops.aligner_blender(aligner)


@pytest.mark.parametrize("strict", [(), (0, 7, 9, 21)])
def test_what_is_folded_depends_on_all_before(spark, strict, by_shift, monkeypatch):
    monkeypatch.setattr(sq, "CELL", 4)
    monkeypatch.setattr(sq, "TIDY", 2)
    rows = [*random_images(40, 5), (90, 3, 0, 0, 0, 9, 1, 1, 2, bytearray(2))]
    df = spark.createDataFrame(rows, IMAGES)
    if strict:
        df = df.withColumn("training", F.col("image_id").isin(*strict))
    out, raster = sq.sequential_tiles(df, 8, by_shift)
    codes, canvas = plain_fold(rows[:-1], by_shift, strict)
    assert {r.image_id: r.return_code for r in out.collect()} == codes | {90: "out_of_bounds"}
    assert (canvas_of(raster, 8, 2) == canvas).all()
    assert raster.count() == raster.select("tile_x", "tile_y").distinct().count()


def chain(n, step=6, size=16):
    """A long flight: each image overlaps only its neighbours, and the order runs along it."""
    rng = np.random.default_rng(0)
    return [(i, i, i * step, int(rng.integers(0, 3)), size, size, size, size, 1, bytearray(rng.integers(0, 200, size * size).astype(np.uint8).tobytes())) for i in range(n)]


def test_a_chained_flight_takes_bounded_tasks(spark, by_shift, monkeypatch):
    """No task gets more tiles than a cell has, or more images than allowed, and the fold is the plain one."""
    seen = spark.sparkContext.accumulator(0)
    rows, real = chain(120), sq.runnable

    def watched(group):
        assert len(group) <= 40
        seen.add(1)
        return real(group)

    monkeypatch.setattr(sq, "CELL", 8)
    monkeypatch.setattr(sq, "CELL_IMAGES", 40)
    monkeypatch.setattr(sq, "runnable", watched)
    out, raster = sq.sequential_tiles(spark.createDataFrame(rows, IMAGES), 16, by_shift)
    codes, canvas = plain_fold(rows, by_shift, hi=900)
    assert {r.image_id: r.return_code for r in out.collect()} == codes
    assert (canvas_of(raster, 16, 1, hi=900) == canvas).all() and seen.value > 10


def test_scores_against_a_raster(spark):
    """By tiles as by rows of pixels, and 1 for an image that lies on top."""
    rows = random_images(25, 6)
    images = spark.createDataFrame(rows, IMAGES)
    raster = ti.merged(ti.pieces(images, 16), 16)
    got = {r.image_id: r.score for r in ti.scores(images, raster, 16).collect()}
    canvas = canvas_of(raster, 16, 2)
    for r in rows:
        m = np.frombuffer(bytes(r[9]), np.uint8).reshape(r[7 - 1], r[7], 2).astype(float)
        under = canvas[r[3] + 40 : r[3] + 40 + r[5], r[2] + 40 : r[2] + 40 + r[4]].astype(float)
        cross = left = right = 0.0
        for b in (0, 1):
            both = (m[..., b] != 0) & (under[..., b] != 0)
            if both.any():
                u, v = m[..., b][both] - m[..., b][both].mean(), under[..., b][both] - under[..., b][both].mean()
                cross, left, right = cross + u @ v, left + u @ u, right + v @ v
        if left > 1e-9 and right > 1e-9:
            assert got[r[0]] == pytest.approx(cross / np.sqrt(left * right), abs=1e-9)
    first = min(rows, key=lambda r: (r[1], r[0]))
    assert got[first[0]] is None or got[first[0]] == pytest.approx(1)


def test_no_images(spark):
    out, raster = sq.sequential_tiles(spark.createDataFrame([], IMAGES), 16)
    assert out.count() == raster.count() == 0
