"""Three-vectors, azimuth cells and small integer helpers as column expressions.

A vector is a tuple of three columns (x, y, z), so that nothing leaves
whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str = "", names: str = "xyz") -> Vec:
    """Columns ``<prefix>x``, ``<prefix>y``, ``<prefix>z``; a prefix like ``p.`` reads a struct."""
    return tuple(F.col(prefix + n) for n in names)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm2(a: Vec) -> Column:
    return dot(a, a)


def norm(a: Vec) -> Column:
    return F.sqrt(norm2(a))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def scale(a: Vec, k: Column | float) -> Vec:
    return tuple(p * k for p in a)


def mean(a: Vec, b: Vec) -> Vec:
    return tuple((p + q) / 2 for p, q in zip(a, b, strict=True))


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def azimuth(p: Vec) -> Column:
    return F.atan2(p[1], p[0])


def elevation(p: Vec) -> Column:
    return F.atan2(p[2], F.sqrt(p[0] * p[0] + p[1] * p[1]))


def azimuth_cell(az: Column, cells: int) -> Column:
    """Cell of [-pi, pi), clamped to 0..cells-1."""
    return F.least(F.greatest(F.floor((az + math.pi) / (2 * math.pi / cells)), F.lit(0)), F.lit(cells - 1)).cast("int")


def azimuth_column(az: Column, columns: int) -> Column:
    """Nearest image column, halves to even; what falls outside is column 0."""
    i = F.rint((az + math.pi) / (2 * math.pi) * columns)
    return F.when((i < 0) | (i >= columns), 0).otherwise(i).cast("int")


def sector(x: Column, y: Column, sectors: int) -> Column:
    """Yaw sector of [0, 2 pi), clamped."""
    yaw = F.atan2(y, x)
    yaw = F.when(yaw < 0, yaw + 2 * math.pi).otherwise(yaw)
    return F.least(F.floor(yaw / (2 * math.pi / sectors)), F.lit(sectors - 1)).cast("int")


def circular_add(i: Column, d: Column | int, n: Column | int) -> Column:
    return F.pmod(i + d, F.lit(n) if isinstance(n, int) else n)


def circular_count(first: Column, last: Column, n: Column | int) -> Column:
    """Members of the circular inclusive range first..last."""
    return circular_add(last, -first, n) + 1


def circular_centre(first: Column, last: Column, n: Column | int) -> Column:
    return circular_add(first, F.floor(circular_count(first, last, n) / 2), n)


def ceil_power2(n: Column) -> Column:
    """The least power of two that is not below ``n`` (n >= 1), from the bit length."""
    return F.when(n <= 1, F.lit(1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin((n - 1).cast("long")))))


def nearest_power2(n: Column) -> Column:
    """The nearest power of two; a tie goes down."""
    up = ceil_power2(n)
    down = F.when(up == n, up).otherwise(F.floor(up / 2))
    return F.when(up - n < n - down, up).otherwise(down).cast("long")


def pair_index(a: Column, b: Column, n: int) -> Column:
    """Place of pair a < b in the row-first upper triangle of n members."""
    return F.floor(a * n - a * (a + 1) / 2 + b - a - 1).cast("long")


def pair_count(n: int) -> int:
    return n * (n - 1) // 2


def eigenvalues3(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> tuple[Column, Column, Column]:
    """Ascending eigenvalues of a symmetric 3x3 matrix by the trigonometric closed form."""
    off = xy * xy + xz * xz + yz * yz
    q = (xx + yy + zz) / 3
    a, b, c = xx - q, yy - q, zz - q
    p = F.sqrt((a * a + b * b + c * c + 2 * off) / 6)
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    half = F.when(p > 0, F.greatest(F.least(det / (2 * p * p * p), F.lit(1.0)), F.lit(-1.0))).otherwise(F.lit(1.0))
    phi = F.acos(half) / 3
    high = q + 2 * p * F.cos(phi)
    low = q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return low, 3 * q - low - high, high


def eigenvector3(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column, value: Column) -> Vec:
    """Unnormalised eigenvector: the longest cross product of two rows of (M - value)."""
    rows = (xx - value, xy, xz), (xy, yy - value, yz), (xz, yz, zz - value)
    one, two, three = cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2])
    a, b, c = norm2(one), norm2(two), norm2(three)
    return tuple(F.when((a >= b) & (a >= c), p).when(b >= c, q).otherwise(r) for p, q, r in zip(one, two, three, strict=True))


def is_normal(v: Vec, n: Vec, cos_most: float) -> Column:
    """v lies across n: |cos| below ``cos_most``, compared squared."""
    return dot(v, n) * dot(v, n) < cos_most * cos_most * norm2(v) * norm2(n)


def same_direction(a: Vec, b: Vec, cos_least: float) -> Column:
    d = dot(a, b)
    return (d > 0) & (d * d > cos_least * cos_least * norm2(a) * norm2(b))


def not_tilted(p: Vec, n: Vec, cos_least: float) -> Column:
    """|cos| between the view direction and the plane's normal is at least ``cos_least``."""
    d = dot(p, n)
    return d * d >= cos_least * cos_least * norm2(p) * norm2(n)


def plane_error(p: Vec, at: Vec, n: Vec) -> Column:
    """Signed distance of p from the plane through ``at`` with unit normal n."""
    return dot(sub(p, at), n)


def in_plane(p: Vec, at: Vec, n: Vec, most: float) -> Column:
    """Distance within ``most`` for a normal of any length."""
    d = dot(sub(p, at), n)
    return d * d < most * most * norm2(n)


def bits_set(mask: Column) -> Column:
    return F.bit_count(mask)


def bit_check(mask: Column, i: Column | int) -> Column:
    return F.getbit(mask, F.lit(i) if isinstance(i, int) else i) == 1


def bit_with(mask: Column, i: Column | int) -> Column:
    return mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(i) if isinstance(i, int) else i))


def bit_without(mask: Column, i: Column | int) -> Column:
    return mask.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(i) if isinstance(i, int) else i)))


def bit_range(first: int, count: int) -> int:
    """A mask of ``count`` (at most 63) bits from ``first``."""
    return ((1 << count) - 1) << first


def bit_words(n: int) -> int:
    return -(-n // 64)
