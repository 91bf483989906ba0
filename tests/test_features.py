"""Features, matching and homographies on seeded pictures that are turned, resized and made brighter."""

import numpy as np
import pytest

from skylattice.operators import features as fe, kernels


def picture(seed, h=200, w=260):
    rng = np.random.default_rng(seed)
    image = np.full((h, w), 12.0)
    for _ in range(140):
        y, x, s = rng.integers(0, h - 16), rng.integers(0, w - 16), rng.integers(5, 16)
        image[y : y + s, x : x + s] = rng.integers(30, 255)
    return kernels.blur(image, 0.8)[..., None]


def turned(image, scale, degrees):
    h, w = image.shape[:2]
    a = np.radians(degrees)
    m = np.eye(3)
    m[:2, :2] = scale * np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
    rows, columns = int(h * 1.1 * max(scale, 1)), int(w * 1.1 * max(scale, 1))
    m[:2, 2] = [columns / 2, rows / 2] - m[:2, :2] @ [w / 2, h / 2]
    return m, kernels.warp(image, m, rows, columns)


def off(found, true, w, h):
    corner = np.array([[0, 0, 1], [w, 0, 1], [w, h, 1], [0, h, 1]])
    p, q = corner @ found.T, corner @ true.T
    return np.abs(p[:, :2] / p[:, 2:] - q[:, :2] / q[:, 2:]).max()


def test_scale_and_turn_are_recovered():
    """At least 0.9 of the cases within 3 pixels at the corners."""
    good = n = 0
    for seed in range(3):
        image = picture(seed)
        base = fe.features(image)
        for scale in (0.7, 0.85, 1.0, 1.2, 1.4):
            for degrees in (-30, 0, 15, 30):
                m, there = turned(image, scale, degrees)
                points, bits = fe.features(there * 1.2 if seed else there)
                pair = fe.matched(base[1], bits)
                n += 1
                try:
                    good += off(kernels.consensus(base[0][pair[:, 0]], points[pair[:, 1]], 3.0), m, 260, 200) < 3
                except kernels.ImageError:
                    pass
    assert good >= 0.9 * n


def test_matching_is_mutual_and_bounded():
    rng = np.random.default_rng(1)
    a = rng.random((30, 256)) < 0.5
    b = np.concatenate([a[10:20] ^ (rng.random((10, 256)) < 0.05), rng.random((40, 256)) < 0.5])
    pair = fe.matched(a, b)
    assert sorted(map(tuple, pair.tolist())) == [(10 + i, i) for i in range(10)]
    assert len(fe.matched(a, b, most=4)) == 4 and len(fe.matched(a[:0], b)) == 0
    differ = (a[:, None] != b[None]).sum(2)
    assert differ[pair[0][0], pair[0][1]] == differ[10:20].min()


def test_align_gates_by_determinant_and_bounds():
    image = picture(5)
    m, there = turned(image, 0.9, 8)
    assert off(fe.align(image, there), m, 260, 200) < 3
    _, small = turned(image, 0.6, 0)
    with pytest.raises(kernels.ImageError, match="bad_det"):
        fe.align(image, small)
    with pytest.raises(kernels.ImageError, match="out_of_bounds"):
        fe.align(image, image[:, 60:])
    with pytest.raises(kernels.ImageError, match="opencv_err"):
        fe.align(image[:20, :20], image)
    m = fe.align(image[30:130, 40:200], image, detector=kernels.corners, matcher=kernels.matches, pixels=5.0)
    assert np.allclose(m[:2, 2], [40, 30], atol=1)


def test_four_points_and_degenerate_ones():
    true = np.array([[1.1, 0.1, 3], [-0.05, 0.95, 2], [1e-4, 2e-4, 1]])
    p = np.random.default_rng(0).uniform(0, 100, (5, 4, 2))
    p[3, 2] = p[3, 1]  # a point twice
    q = np.concatenate([p, np.ones((5, 4, 1))], 2) @ true.T
    found = kernels.through_four(p, q[..., :2] / q[..., 2:])
    assert len(found) == 4 and np.allclose(found, true, atol=1e-6)
    with pytest.raises(kernels.ImageError, match="linalg_err"):
        kernels.consensus(np.zeros((8, 2)), np.zeros((8, 2)))
