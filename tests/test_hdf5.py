"""HDF5 datasets written here are read back by chunk, whole and by window."""

import struct

import numpy as np
import pytest

from skylattice.sources import hdf5
from skylattice.sources.tiff import Ranges


def grid(rows, columns, kind, seed=0):
    return np.cumsum(np.random.default_rng(seed).integers(0, 5, (rows, columns)), 1).astype(kind)


def whole(data, path, window=None):
    d = hdf5.Hdf5(Ranges(data)).dataset(path)
    out = np.zeros(d.shape, d.kind)
    for y, x, at, n, mask in d.index(window):
        part = np.frombuffer(hdf5.decoded(data[at : at + n], d.kind, d.filters, mask), d.kind).reshape(-1, d.chunk[1])
        out[y : y + part.shape[0], x : x + part.shape[1]] = part[: d.shape[0] - y, : d.shape[1] - x]
    return out


@pytest.mark.parametrize("kind", ["<u2", ">f4", "<i4", "<u1", "<f8"])
@pytest.mark.parametrize("filters", [(), (2, 1), (1,), (2, 1, 3)])
def test_chunks_there_and_back(kind, filters):
    m = grid(53, 70, kind)
    m[16:32, 16:48] = 0  # two chunks are not stored
    data = hdf5.encoded(m, "HDFEOS/GRIDS/day/light", (16, 16), filters, fan=3)  # an index of several levels
    assert (whole(data, "HDFEOS/GRIDS/day/light") == m).all()
    d = hdf5.Hdf5(Ranges(data)).dataset("/HDFEOS/GRIDS/day/light")
    assert d.shape == (53, 70) and len(list(d.index())) == 4 * 5 - 2
    assert sorted(x[:2] for x in d.index((17, 30, 3, 3))) == [(32, 16)]
    assert list(d.index((100, 0, 5, 5))) == []


def test_whole_blocks_and_other_files():
    m = grid(2500, 3, "<i2")
    assert (whole(hdf5.encoded(m, "a"), "a") == m).all()
    d = hdf5.Hdf5(Ranges(hdf5.encoded(m, "a"))).dataset("a")
    assert [x[0] for x in d.index((0, 1000, 1, 100))] == [0, 1024]
    with pytest.raises(ValueError, match="no 'b'"):
        hdf5.Hdf5(Ranges(hdf5.encoded(m, "a"))).dataset("b")
    with pytest.raises(ValueError, match="group"):
        hdf5.Hdf5(Ranges(hdf5.encoded(m, "a"))).dataset("a/b")
    for bad in (b"", b"\x89HDF\r\n\x1a\n", b"x" * 200, hdf5.SIGNATURE + b"\x02" + bytes(100)):
        with pytest.raises((ValueError, struct.error)):
            hdf5.Hdf5(Ranges(bad))


def test_tiles_on_spark(spark, tmp_path):
    """Chunks of several files with bounds from their names; a window reads its chunks only."""
    real = {}
    for h, v in ((9, 4), (10, 4), (35, 17)):
        real[h, v] = grid(40, 40, "<u2", h)
        (tmp_path / f"VNP46.A2020.h{h:02d}v{v:02d}.001.h5").write_bytes(hdf5.encoded(real[h, v], "g/light", (16, 16)))
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path")
    got = hdf5.satellite_tiles(files, "g/light", 40).collect()
    assert len(got) == 3 * 9
    for r in got:
        h, v = (int(r.filepath.partition(".h")[2][a:b]) for a, b in ((0, 2), (3, 5)))
        part = np.frombuffer(r.data, r.kind).reshape(r.rows, r.columns)
        assert (part == real[h, v][r.y_off : r.y_off + r.rows, r.x_off : r.x_off + r.columns]).all()
        assert r.x_min == pytest.approx(10 * h - 180 + r.x_off / 4) and r.y_max == pytest.approx(90 - 10 * v - r.y_off / 4)
        assert r.x_max - r.x_min == pytest.approx(r.columns / 4) and r.y_max - r.y_min == pytest.approx(r.rows / 4)
    some = hdf5.hdf5_blocks(files, "g/light", (0, 33, 17, 2)).collect()
    assert sorted({(r.y_off, r.x_off) for r in some}) == [(32, 0), (32, 16)] and len(some) == 6
