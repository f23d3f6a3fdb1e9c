"""Rigid transforms as column expressions and as NumPy twins.

A pose is (r, t): Rodrigues rotation and translation, mapping p to R(r) p + t.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import Vec, add, cross, dot, scale

SMALL = 1e-9


def rotate(r: Vec, p: Vec) -> Vec:
    """R(r) p by Rodrigues' formula."""
    theta = F.sqrt(dot(r, r))
    safe = F.when(theta > SMALL, theta).otherwise(F.lit(1.0))
    k = scale(r, 1 / safe)
    c, s = F.cos(theta), F.sin(theta)
    along = dot(k, p)
    turned = tuple(a * c + b * s + d * along * (1 - c) for a, b, d in zip(p, cross(k, p), k, strict=True))
    small = add(p, cross(r, p))
    return tuple(F.when(theta > SMALL, a).otherwise(b) for a, b in zip(turned, small, strict=True))


def transform(r: Vec, t: Vec, p: Vec) -> Vec:
    return add(rotate(r, p), t)


def inverse(r: Vec, t: Vec) -> tuple[Vec, Vec]:
    back = scale(r, -1)
    return back, scale(rotate(back, t), -1)


def quaternion(r: Vec) -> tuple[Column, Column, Column, Column]:
    """Unit quaternion (x, y, z, w) of a rotation."""
    theta = F.sqrt(dot(r, r))
    k = F.when(theta > SMALL, F.sin(theta / 2) / F.when(theta > SMALL, theta).otherwise(F.lit(1.0))).otherwise(F.lit(0.5))
    return r[0] * k, r[1] * k, r[2] * k, F.cos(theta / 2)


def from_quaternion(x: Column, y: Column, z: Column, w: Column) -> Vec:
    """Rotation of a unit quaternion, with angle in [0, pi]."""
    sign = F.when(w < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    s = F.sqrt(x * x + y * y + z * z)
    theta = 2 * F.atan2(s, w * sign)
    k = sign * F.when(s > SMALL, theta / F.when(s > SMALL, s).otherwise(F.lit(1.0))).otherwise(F.lit(2.0))
    return x * k, y * k, z * k


def quaternion_product(p: tuple[Column, ...], q: tuple[Column, ...]) -> tuple[Column, Column, Column, Column]:
    """Rotation p after rotation q, both (x, y, z, w)."""
    (x0, y0, z0, w0), (x1, y1, z1, w1) = p, q
    return w0 * x1 + x0 * w1 + y0 * z1 - z0 * y1, w0 * y1 - x0 * z1 + y0 * w1 + z0 * x1, w0 * z1 + x0 * y1 - y0 * x1 + z0 * w1, w0 * w1 - x0 * x1 - y0 * y1 - z0 * z1


def rotation_to(n: Vec) -> Vec:
    """The rotation that takes z to the unit vector n, without turn about n."""
    s = F.sqrt(n[0] * n[0] + n[1] * n[1])
    angle = F.atan2(s, n[2])
    k = angle / F.when(s > 1e-12, s)
    return F.coalesce(-n[1] * k, angle), F.coalesce(n[0] * k, F.lit(0.0)), F.lit(0.0)


# NumPy twins for the driver's small dense algebra


def skew(v: np.ndarray) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


def skews(v: np.ndarray) -> np.ndarray:
    """``skew`` of each row."""
    out = np.zeros((len(v), 3, 3))
    out[:, 0, 1], out[:, 0, 2], out[:, 1, 2] = -v[:, 2], v[:, 1], -v[:, 0]
    return out - out.transpose(0, 2, 1)


def matrix(r: np.ndarray) -> np.ndarray:
    theta = float(np.linalg.norm(r))
    if theta < SMALL:
        return np.eye(3) + skew(r)
    k = skew(np.asarray(r) / theta)
    return np.eye(3) + np.sin(theta) * k + (1 - np.cos(theta)) * k @ k


def rodrigues(m: np.ndarray) -> np.ndarray:
    w = np.array([m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]]) / 2
    s, c = float(np.linalg.norm(w)), (np.trace(m) - 1) / 2
    theta = np.arctan2(s, c)
    if s > 1e-6:
        return w * (theta / s)
    if c > 0:
        return w
    axis = np.sqrt(np.maximum((np.diag(m) + 1) / 2, 0))
    k = int(np.argmax(axis))
    axis = m[:, k] + np.eye(3)[k]
    return axis / np.linalg.norm(axis) * theta


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pose a after pose b; poses are (r, t) of six numbers."""
    ra = matrix(a[:3])
    return np.concatenate([rodrigues(ra @ matrix(b[:3])), ra @ b[3:] + a[3:]])


def inverted(a: np.ndarray) -> np.ndarray:
    return np.concatenate([-np.asarray(a[:3]), -(matrix(-np.asarray(a[:3])) @ a[3:])])


def is_rotation(m: np.ndarray, tolerance: float = 1e-9) -> bool:
    return bool(np.abs(m @ m.T - np.eye(3)).max() < tolerance and abs(np.linalg.det(m) - 1) < tolerance)


def left_jacobian(r: np.ndarray) -> np.ndarray:
    """d(R(r) p)/dr = -[R p]x J(r)."""
    theta = float(np.linalg.norm(r))
    k = skew(np.asarray(r))
    if theta < 1e-5:
        return np.eye(3) + k / 2
    return np.eye(3) + (1 - np.cos(theta)) / theta**2 * k + (theta - np.sin(theta)) / theta**3 * k @ k


def aligning(n: np.ndarray) -> np.ndarray:
    """A rotation that takes z to the unit vector n, without turn about n."""
    n = np.asarray(n) / np.linalg.norm(n)
    v = np.cross([0, 0, 1.0], n)
    s, c = np.linalg.norm(v), n[2]
    if s < 1e-12:
        return np.eye(3) if c > 0 else np.diag([1.0, -1.0, -1.0])
    return matrix(v / s * np.arctan2(s, c))


def procrustes(cross_sums: np.ndarray) -> np.ndarray:
    """R that takes vectors b to a best, from M = sum a b^T."""
    u, _, vt = np.linalg.svd(cross_sums)
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
