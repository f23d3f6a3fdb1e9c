"""Lenses: a pinhole with rational, tangential and thin-prism distortion, as column expressions and as NumPy twins.

A lens is ``(fx, fy, cx, cy)`` and up to 12 coefficients in the usual order
``k1 k2 p1 p2 k3 k4 k5 k6 s1 s2 s3 s4``; what is left out is zero.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import Vec, dot

Lens = tuple[float, ...]
#: Newton steps of an inverse; they square the error each.
STEPS = 12
#: A point is in view if its pixel looks back at it within this angle.
LOOKS_BACK = math.cos(math.radians(0.01))
#: The lens models that are known, and how many coefficients each has.
MODELS = {"LENSMODEL_PINHOLE": 0, "LENSMODEL_OPENCV4": 4, "LENSMODEL_OPENCV5": 5, "LENSMODEL_OPENCV8": 8, "LENSMODEL_OPENCV12": 12}


def coefficients(lens: Sequence) -> tuple:
    """The 12 coefficients; a lens with another number of values is an error."""
    if not 4 <= len(lens) <= 16:
        raise ValueError(f"a lens has 4 to 16 values, not {len(lens)}")
    return (*lens[4:], *[0.0] * (16 - len(lens)))


def _bent(x, y, k: Sequence):
    """Distorted ``x, y`` and the four derivatives; works on columns, arrays and numbers."""
    k1, k2, p1, p2, k3, k4, k5, k6, s1, s2, s3, s4 = k
    r = x * x + y * y
    up, down = 1 + r * (k1 + r * (k2 + r * k3)), 1 + r * (k4 + r * (k5 + r * k6))
    g = up / down
    dg = (k1 + r * (2 * k2 + r * 3 * k3) - g * (k4 + r * (2 * k5 + r * 3 * k6))) / down  # by r
    u = x * g + 2 * p1 * x * y + p2 * (r + 2 * x * x) + r * (s1 + r * s2)
    v = y * g + p1 * (r + 2 * y * y) + 2 * p2 * x * y + r * (s3 + r * s4)
    su, sv = s1 + 2 * r * s2, s3 + 2 * r * s4
    ux = g + 2 * x * x * dg + 2 * p1 * y + 6 * p2 * x + 2 * x * su
    uy = 2 * x * y * dg + 2 * p1 * x + 2 * p2 * y + 2 * y * su
    vx = 2 * x * y * dg + 2 * p1 * x + 2 * p2 * y + 2 * x * sv
    vy = g + 2 * y * y * dg + 6 * p1 * y + 2 * p2 * x + 2 * y * sv
    return u, v, ux, uy, vx, vy


def project(p: Vec, lens: Sequence) -> tuple[Column, Column]:
    """Pixel of a point in the camera's frame."""
    k = coefficients(lens)
    if _plain(k):
        return p[0] / p[2] * lens[0] + lens[2], p[1] / p[2] * lens[1] + lens[3]

    def pixel(at: Column) -> Column:
        u, v, *_ = _bent(at["x"], at["y"], k)
        return F.struct((u * lens[0] + lens[2]).alias("u"), (v * lens[1] + lens[3]).alias("v"))

    # the ratio is named once, so that the many terms do not each repeat it
    found = F.get(F.transform(F.array(F.struct((p[0] / p[2]).alias("x"), (p[1] / p[2]).alias("y"))), pixel), F.lit(0))
    return found["u"], found["v"]


def _plain(k: Sequence) -> bool:
    return all(isinstance(c, int | float) and c == 0 for c in k)


def unproject(u: Column, v: Column, lens: Sequence) -> Vec:
    """The point at depth 1 that is seen at a pixel: Newton steps over many pixels at once.

    Where the lens folds over, no such point may exist; what comes out then
    does not project back to the pixel.
    """
    k = coefficients(lens)
    a, b = (u - lens[2]) / lens[0], (v - lens[3]) / lens[1]
    if _plain(k):
        return a, b, F.lit(1.0)
    by_row = [i for i, c in enumerate(k) if isinstance(c, Column)]
    fixed = [0.0 if isinstance(c, Column) else c for c in k]

    def rays(a: pd.Series, b: pd.Series, *own: pd.Series) -> pd.DataFrame:
        bend = list(fixed)
        for i, c in zip(by_row, own, strict=True):
            bend[i] = c.to_numpy(float)
        with np.errstate(all="ignore"):
            x, y = _unbent(a.to_numpy(float), b.to_numpy(float), bend)
        return pd.DataFrame({"x": x, "y": y})

    found = F.pandas_udf(rays, "x double, y double")(a.cast("double"), b.cast("double"), *(k[i].cast("double") for i in by_row))
    # a null pixel or coefficient has no ray
    there = a.isNotNull() & b.isNotNull()
    for i in by_row:
        there &= k[i].isNotNull()
    return F.when(there, found["x"]), F.when(there, found["y"]), F.lit(1.0)


def _unbent(a: np.ndarray, b: np.ndarray, k: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Where Newton's steps come to from ``a, b`` for the point that is bent to there."""
    x, y = a, b
    for _ in range(STEPS):
        eu, ev, ux, uy, vx, vy = _bent(x, y, k)
        eu, ev, whole = eu - a, ev - b, ux * vy - uy * vx
        whole = np.where(np.abs(whole) > 1e-12, whole, 1e-12)
        x, y = x - (vy * eu - uy * ev) / whole, y - (ux * ev - vx * eu) / whole
    return x, y


def in_view(p: Vec, lens: Sequence, width, height) -> Column:
    """In front of the camera, inside the image, and where the pixel looks back at the point."""
    ahead = (p[0], p[1], F.when(p[2] > 0, p[2]))
    u, v = project(ahead, lens)
    inside = (u >= 0) & (u <= width - 1) & (v >= 0) & (v <= height - 1)
    back = unproject(u, v, lens)
    along = dot(p, back)
    near = (along > 0) & (along * along >= LOOKS_BACK**2 * dot(p, p) * dot(back, back))
    return F.coalesce(inside & near, F.lit(False))


# NumPy twins


def project_points(p: np.ndarray, lens: Lens) -> np.ndarray:
    u, v, *_ = _bent(p[:, 0] / p[:, 2], p[:, 1] / p[:, 2], coefficients(lens))
    return np.stack([u * lens[0] + lens[2], v * lens[1] + lens[3]], 1)


def projection_jacobian(p: np.ndarray, lens: Lens) -> np.ndarray:
    """d(u, v)/dp for points in the camera's frame, (n, 2, 3)."""
    z = p[:, 2]
    x, y = p[:, 0] / z, p[:, 1] / z
    _, _, ux, uy, vx, vy = (np.broadcast_to(a, z.shape) for a in _bent(x, y, coefficients(lens)))
    fx, fy = lens[:2]
    return np.stack([np.stack([fx * ux, fx * uy, -fx * (ux * x + uy * y)], 1), np.stack([fy * vx, fy * vy, -fy * (vx * x + vy * y)], 1)], 1) / z[:, None, None]


def unproject_points(seen: np.ndarray, lens: Lens) -> np.ndarray:
    """Points at depth 1; not a number where Newton's steps do not come back to the pixel."""
    k = coefficients(lens)
    goal = (seen - [lens[2], lens[3]]) / [lens[0], lens[1]]
    x, y = _unbent(goal[:, 0], goal[:, 1], k)
    u, v, *_ = _bent(x, y, k)
    good = np.hypot(u - goal[:, 0], v - goal[:, 1]) < 1e-9
    return np.stack([np.where(good, x, np.nan), np.where(good, y, np.nan), np.ones(len(x))], 1)
