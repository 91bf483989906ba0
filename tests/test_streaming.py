"""A mosaic that grows with new files: runs over parts equal one run over all, in whatever order images come."""

import random

from test_tiles import IMAGES, random_images

from skylattice.operators import tiles as ti
from skylattice.streaming import incremental as inc, mosaics as ms


def test_two_runs_over_halves_equal_one(spark, tmp_path):
    rows = [(*r[:1], 3 * i + 1, *r[2:]) for i, r in enumerate(random_images(40, 4))]
    random.Random(1).shuffle(rows)  # late images come in later runs
    images = spark.createDataFrame(rows, IMAGES)
    want = sorted(map(tuple, ti.merged(ti.pieces(images, 16), 16).collect()))
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for lo, hi in ((0, 25), (25, 26), (26, 40)):
        spark.createDataFrame(rows[lo:hi], IMAGES).coalesce(2).write.mode("append").parquet(source)
        inc.run_to_end(ms.mosaic_updates(inc.read_new_files(spark, source, IMAGES), 16), out, state)
    got = sorted(map(tuple, ms.newest(spark, out).collect()))
    assert got == want
    versions = [r.version for r in spark.read.schema(ms.TILE).parquet(out).collect()]
    assert max(versions) > 1 and len(versions) > len(want)
