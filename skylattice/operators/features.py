"""Binary features at several scales for Arrow tasks: oriented corners, bit descriptors, cross-checked matching,
and the alignment of one image with another that rests on them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .kernels import ImageError, blur, consensus, resize

#: Ratio of sizes from one level of the pyramid to the next, and the least side of a level.
STEP, LEAST = 2**0.25, 36
#: Radius of the neighbourhood that gives a corner its direction, and of the pairs that describe it.
AROUND, REACH = 9, 11
BITS = 256
#: Pairs of places around a corner, drawn once from a rule: normal, within REACH, seeded.
PAIRS = np.clip(np.random.default_rng(31).normal(0, REACH / 2.2, (BITS, 2, 2)), -REACH, REACH)


def strength_of(grey: np.ndarray) -> np.ndarray:
    """Harris response: large where brightness changes in two directions."""
    gy, gx = np.gradient(blur(grey, 1.0))
    a, b, c = blur(gx * gx, 1.5), blur(gy * gy, 1.5), blur(gx * gy, 1.5)
    return a * b - c * c - 0.05 * (a + b) ** 2


def peaks(strength: np.ndarray, border: int, most: int) -> np.ndarray:
    """(x, y) of the strongest local maxima, between pixels by a parabola along each axis."""
    mid = strength[1:-1, 1:-1]
    top = mid > 0
    for dy in (0, 1, 2):
        for dx in (0, 1, 2):
            if (dy, dx) != (1, 1):
                top &= mid >= strength[dy : dy + mid.shape[0], dx : dx + mid.shape[1]]
    y, x = np.nonzero(top)
    y, x = y + 1, x + 1
    ok = (x >= border) & (y >= border) & (x < strength.shape[1] - border) & (y < strength.shape[0] - border)
    x, y = x[ok], y[ok]
    best = np.argsort(-strength[y, x], kind="stable")[:most]
    x, y = x[best], y[best]

    def between(before: np.ndarray, here: np.ndarray, after: np.ndarray) -> np.ndarray:
        bend = before - 2 * here + after
        return np.clip(np.where(bend < 0, 0.5 * (before - after) / np.where(bend < 0, bend, 1), 0), -0.5, 0.5)

    here = strength[y, x]
    return np.stack([x + between(strength[y, x - 1], here, strength[y, x + 1]), y + between(strength[y - 1, x], here, strength[y + 1, x])], 1)


def features(image: np.ndarray, most: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of corners over all levels of a pyramid, and BITS bits for each.

    A corner's direction is that of its neighbourhood's centre of brightness. Its bits compare pairs of
    places of the smoothed level, turned into that direction, so that they change little when the
    image is turned, resized, or made brighter.
    """
    grey = image.reshape(*image.shape[:2], -1).astype(float).mean(2)
    h, w = grey.shape
    points, bits, level, shares = [], [], 0, []
    while min(h, w) / STEP**level >= LEAST and level < 8:
        shares.append(STEP ** (-2 * level))
        level += 1
    step = np.arange(-AROUND, AROUND + 1)
    disc = (step[:, None] ** 2 + step**2 <= AROUND**2).astype(float)
    for k, share in enumerate(shares):
        f = STEP**k
        rows, columns = round(h / f), round(w / f)
        here = grey if not k else resize(blur(grey, 0.45 * np.sqrt(f * f - 1))[..., None], rows, columns)[..., 0]
        border = REACH + 2
        at = peaks(strength_of(here), border, max(8, round(most * share / sum(shares))))
        if not len(at):
            continue
        x, y = at.round().astype(int).T
        patch = here[y[:, None, None] + step[:, None], x[:, None, None] + step] * disc
        angle = np.arctan2((patch * step[:, None]).sum((1, 2)), (patch * step).sum((1, 2)))
        turn = np.stack([np.stack([np.cos(angle), -np.sin(angle)], 1), np.stack([np.sin(angle), np.cos(angle)], 1)], 1)
        place = (at[:, None, None] + np.einsum("nij,bpj->nbpi", turn, PAIRS)).round().astype(int)
        place = np.clip(place, 0, [columns - 1, rows - 1])
        value = blur(here, 1.6)[place[..., 1], place[..., 0]]
        points.append((at + 0.5) * [w / columns, h / rows] - 0.5)
        bits.append(value[..., 0] < value[..., 1])
    if not points:
        return np.zeros((0, 2)), np.zeros((0, BITS), bool)
    return np.concatenate(points), np.concatenate(bits)


def matched(a: np.ndarray, b: np.ndarray, most: int | None = None, furthest: float = 0.3) -> np.ndarray:
    """(index in a, index in b) of bit descriptors that are each other's nearest by Hamming distance and
    differ in at most a share ``furthest`` of their bits; closest pairs first."""
    if not len(a) or not len(b):
        return np.zeros((0, 2), int)
    u, v = (np.where(x, 1.0, -1.0).astype(np.float32) for x in (a, b))
    differ = (a.shape[1] - u @ v.T) / 2
    there, back = differ.argmin(1), differ.argmin(0)
    i = np.flatnonzero(back[there] == np.arange(len(a)))
    far = differ[i, there[i]]
    order = np.argsort(far, kind="stable")
    order = order[far[order] <= furthest * a.shape[1]][:most]
    return np.stack([i[order], there[i[order]]], 1)


def align(src: np.ndarray, dst: np.ndarray, bright: int = 50, detector: Callable = features, matcher: Callable = matched, det: tuple[float, float] = (0.6, 1.7), pixels: float = 3.0) -> np.ndarray:
    """Homography of src onto dst. Raises ImageError with the code of the first gate that fails.

    ``detector`` gives (points, descriptors) of an image and ``matcher`` the pairs of two sets of descriptors;
    ``kernels.corners`` with ``kernels.matches`` is another choice, for images of one scale and direction.
    """
    for image, code in ((src, "dark_frame"), (dst, "dst_dark_frame")):
        if (image > 0.03 * 255).sum() < bright:
            raise ImageError(code)
    (a, da), (b, db) = detector(src), detector(dst)
    if min(len(a), len(b)) < 4:
        raise ImageError("opencv_err")
    pair = matcher(da, db)
    m = consensus(a[pair[:, 0]], b[pair[:, 1]], pixels)
    if not det[0] < abs(np.linalg.det(m)) < det[1]:
        raise ImageError("bad_det")
    h, w = src.shape[:2]
    p = np.array([[0, 0, 1], [w, 0, 1], [w, h, 1], [0, h, 1]]) @ m.T
    p = p[:, :2] / p[:, 2:]
    if (p < -1).any() or (p > [dst.shape[1] + 1, dst.shape[0] + 1]).any():
        raise ImageError("out_of_bounds")
    return m
