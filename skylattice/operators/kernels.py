"""Array kernels of single images for Arrow tasks: resampling, corners, matching, homographies."""

from __future__ import annotations

import numpy as np

from ..functions import projection as pr


class ImageError(Exception):
    """Carries the return code of an image that could not be aligned."""


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values at (x, y); 0 outside the image."""
    h, w = image.shape[:2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy, out = (x - x0)[..., None], (y - y0)[..., None], 0
    for dx, dy, weight in ((0, 0, (1 - fx) * (1 - fy)), (1, 0, fx * (1 - fy)), (0, 1, (1 - fx) * fy), (1, 1, fx * fy)):
        u, v = x0 + dx, y0 + dy
        inside = ((u >= 0) & (u < w) & (v >= 0) & (v < h))[..., None]
        out = out + weight * np.where(inside, image[np.clip(v, 0, h - 1), np.clip(u, 0, w - 1)], 0)
    return out


def resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    h, w = image.shape[:2]
    y, x = np.mgrid[:rows, :columns]
    return sample(image, np.clip((x + 0.5) * w / columns - 0.5, 0, w - 1), np.clip((y + 0.5) * h / rows - 0.5, 0, h - 1))


def warp(image: np.ndarray, m: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """The image under the homography m, on a canvas of rows x columns."""
    y, x = np.mgrid[:rows, :columns]
    p = np.linalg.inv(m) @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    return sample(image, (p[0] / p[2]).reshape(x.shape), (p[1] / p[2]).reshape(x.shape))


def reprojected(image: np.ndarray, bounds: list[float], source: str, target: str) -> tuple[np.ndarray, list[float]]:
    """The image on an even grid of another system, each pixel the bilinear value at its place in the source,
    and 0 where that lies outside. Integers are rounded, floating values stay as they are.

    Between systems whose axes go apart the grid has the same rows and columns. Otherwise it has pixels of
    about the size that keeps the diagonal's number of pixels, and so a shape of its own.
    """
    h, w = image.shape[:2]
    to = pr.bounds_of(bounds, source, target)
    rows, columns = h, w
    if not pr.straight(source, target):
        size = np.hypot(to[1] - to[0], to[3] - to[2]) / np.hypot(h, w)
        rows, columns = max(1, round((to[3] - to[2]) / size)), max(1, round((to[1] - to[0]) / size))
    u = to[0] + (np.arange(columns) + 0.5) * (to[1] - to[0]) / columns
    v = to[3] - (np.arange(rows) + 0.5) * (to[3] - to[2]) / rows
    x, y = pr.transformed(target, source, *np.meshgrid(u, v), pr.ARRAYS)
    x = (x - bounds[0]) / (bounds[1] - bounds[0]) * w - 0.5
    y = (bounds[3] - y) / (bounds[3] - bounds[2]) * h - 0.5
    out = sample(image.astype(float), np.clip(x, 0, w - 1), np.clip(y, 0, h - 1))
    out[(x < -0.5 - 1e-6) | (x > w - 0.5 + 1e-6) | (y < -0.5 - 1e-6) | (y > h - 0.5 + 1e-6)] = 0
    return (out if image.dtype.kind == "f" else out.round().astype(image.dtype)), to


def blur(grey: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, round(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    for axis in (0, 1):
        wide, n = np.pad(grey, [(r, r) if a == axis else (0, 0) for a in (0, 1)], "edge"), grey.shape[axis]
        grey = sum(weight * wide.take(range(i, i + n), axis) for i, weight in enumerate(k))
    return grey


def corners(image: np.ndarray, most: int = 300, half: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of the strongest corners, and the normalised patch around each."""
    grey = image.reshape(*image.shape[:2], -1).astype(float).sum(2)
    gy, gx = np.gradient(blur(grey, 1.0))
    a, b, c = blur(gx * gx, 1.5), blur(gy * gy, 1.5), blur(gx * gy, 1.5)
    strength = a * b - c * c - 0.05 * (a + b) ** 2
    peak = strength[1:-1, 1:-1] > 0
    for dy in (0, 1, 2):
        for dx in (0, 1, 2):
            if (dy, dx) != (1, 1):
                peak &= strength[1:-1, 1:-1] >= strength[dy : dy + strength.shape[0] - 2, dx : dx + strength.shape[1] - 2]
    y, x = np.nonzero(peak)
    y, x = y + 1, x + 1
    ok = (x >= half) & (y >= half) & (x < grey.shape[1] - half) & (y < grey.shape[0] - half)
    x, y = x[ok], y[ok]
    best = np.argsort(-strength[y, x], kind="stable")[:most]
    x, y, step = x[best], y[best], np.arange(-half, half + 1)
    patch = grey[y[:, None, None] + step[:, None], x[:, None, None] + step].reshape(len(x), -1)
    patch = patch - patch.mean(1, keepdims=True)
    return np.stack([x, y], 1).astype(float), patch / np.maximum(np.linalg.norm(patch, axis=1, keepdims=True), 1e-9)


def matches(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """(index in a, index in b) of each descriptor's nearest one, closest pairs first."""
    d = ((a[:, None] - b[None]) ** 2).sum(2)
    near = d.argmin(1)
    order = np.argsort(d[np.arange(len(a)), near], kind="stable")[:most]
    return np.stack([order, near[order]], 1)


def normalised(points: np.ndarray) -> np.ndarray:
    """The map of points to mean 0 and mean distance sqrt(2), as a 3 x 3 matrix."""
    centre = points.mean(0)
    s = np.sqrt(2) / max(np.hypot(*(points - centre).T).mean(), 1e-12)
    return np.array([[s, 0, -s * centre[0]], [0, s, -s * centre[1]], [0, 0, 1]])


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Direct linear transform of at least four point pairs, in normalised coordinates, scaled to m[2, 2] = 1."""
    s, d = normalised(src), normalised(dst)
    x, y = (src @ s[:2, :2] + s[:2, 2]).T
    u, v = (dst @ d[:2, :2] + d[:2, 2]).T
    one, zero = np.ones(len(src)), np.zeros(len(src))
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], 1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], 1)])
    m = np.linalg.inv(d) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ s
    return m / m[2, 2]


def through_four(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Homographies (n x 3 x 3) through four point pairs each (n x 4 x 2); those of degenerate fours are left out."""
    (x, y), (u, v) = np.moveaxis(src, 2, 0), np.moveaxis(dst, 2, 0)
    one, zero = np.ones_like(x), np.zeros_like(x)
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], 2), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], 2)], 1)
    scale = np.maximum(np.abs(rows).max(1, keepdims=True), 1e-12)  # of each unknown
    with np.errstate(over="ignore", invalid="ignore"):
        good = np.abs(np.linalg.det(rows / scale)) > 1e-9
    h = np.linalg.solve((rows / scale)[good], np.concatenate([u, v], 1)[good][..., None])[..., 0] / scale[good][:, 0]
    return np.concatenate([h, np.ones((len(h), 1))], 1).reshape(-1, 3, 3)


def consensus(src: np.ndarray, dst: np.ndarray, pixels: float = 5.0, rounds: int = 500, seed: int = 0) -> np.ndarray:
    """Homography with the most pairs within ``pixels``, of those through ``rounds`` seeded fours, refitted on
    them, and then, if there are enough, on those within a fifth of that."""
    rng = np.random.default_rng(seed)
    if len(src) < 4:
        raise ImageError("opencv_err")
    pick = rng.random((rounds, len(src))).argpartition(3, axis=1)[:, :4]
    ones = np.concatenate([src, np.ones((len(src), 1))], 1)

    def within(m: np.ndarray, most: float) -> np.ndarray:
        p = ones @ m.swapaxes(-1, -2)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.hypot(*np.moveaxis(p[..., :2] / p[..., 2:] - dst, -1, 0)) < most

    found = through_four(src[pick], dst[pick])
    good = within(found, pixels) if len(found) else np.zeros((1, len(src)), bool)
    best = good[good.sum(1).argmax()]
    if best.sum() < 4:
        raise ImageError("linalg_err")
    m = homography(src[best], dst[best])
    for most in (pixels, pixels / 2, pixels / 5):
        good = within(m, most)
        if good.sum() >= 8:
            m = homography(src[good], dst[good])
    return m


def blended(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """dst, with src where dst is empty."""
    return np.where((dst.sum(2) == 0)[..., None], src, dst)


__all__ = ["ImageError", "blended", "blur", "consensus", "corners", "homography", "matches", "reprojected", "resize", "sample", "warp"]
