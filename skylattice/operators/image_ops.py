"""Image operators: functions of (source, window of the mosaic) that return a dict with what came of it.

``return_code`` is ``success`` or says what failed; ``image`` holds the source's pixels over the window (uint8)
where it did succeed; any other number is kept in the outcome's log. Any such function, or one made
of others by ``queue``, can be folded into a sequential mosaic.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import features, kernels

Operator = Callable[[np.ndarray, np.ndarray], dict]


def pixels(image: np.ndarray) -> np.ndarray:
    return image if image.dtype == np.uint8 else np.clip(np.asarray(image).round(), 0, 255).astype(np.uint8)


def blender(src: np.ndarray, dst: np.ndarray) -> dict:
    """The source fills the window."""
    same = src.shape[:2] == dst.shape[:2]
    return {"return_code": "success", "image": pixels(src if same else kernels.resize(src.astype(float), *dst.shape[:2]))}


def aligner_blender(aligner: Callable[[np.ndarray, np.ndarray], np.ndarray] = features.align, **options: object) -> Operator:
    """The source is warped onto the window by the homography that ``aligner`` finds, with its options."""

    def operate(src: np.ndarray, dst: np.ndarray) -> dict:
        try:
            m = aligner(src.astype(float), dst.astype(float), **options)
            return {"return_code": "success", "image": pixels(kernels.warp(src.astype(float), m, *dst.shape[:2])), "determinant": float(np.linalg.det(m))}
        except kernels.ImageError as e:
            return {"return_code": str(e)}
        except np.linalg.LinAlgError:
            return {"return_code": "linalg_err"}

    return operate


def queue(*operators: Operator) -> Operator:
    """The first operator that succeeds, or else what the last one says; ``i_operator`` tells which it was."""
    if not operators:
        raise ValueError("a queue needs an operator")

    def operate(src: np.ndarray, dst: np.ndarray) -> dict:
        for i, each in enumerate(operators):
            out = {**each(src, dst), "i_operator": float(i)}
            if out["return_code"] == "success":
                break
        return out

    return operate


def variations(defaults: dict, changes: list[dict]) -> Operator:
    """A queue of aligners with the same options but for each one's changes."""
    return queue(*(aligner_blender(**{**defaults, **change}) for change in changes or [{}]))
