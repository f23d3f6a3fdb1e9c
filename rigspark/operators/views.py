"""Tables for display: frames, grids and clouds in one frame."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import poses
from ..functions import vectors as v


def sphere_grid(spark: SparkSession, around: int = 40, up: int = 20) -> DataFrame:
    """``(i, j, x, y, z)`` on the unit sphere."""
    i, j = F.floor(F.col("id") / up), F.col("id") % up
    az, el = i * (2 * math.pi / around), (j + 0.5) * (math.pi / up) - math.pi / 2
    return spark.range(around * up).select(i.cast("int").alias("i"), j.cast("int").alias("j"), (F.cos(el) * F.cos(az)).alias("x"), (F.cos(el) * F.sin(az)).alias("y"), F.sin(el).alias("z"))


def mesh_grid(spark: SparkSession, n: int, reach: float) -> DataFrame:
    """``(i, j, x, y)``: n by n places over [-reach, reach] squared."""
    i, j = F.floor(F.col("id") / n), F.col("id") % n
    at = lambda k: k * (2 * reach / (n - 1)) - reach
    return spark.range(n * n).select(i.cast("int").alias("i"), j.cast("int").alias("j"), at(j).alias("x"), at(i).alias("y"))


def forward_vectors(sensor_poses: DataFrame) -> DataFrame:
    """Where each sensor looks in the xy plane: a lidar along its x, a camera along its z; zero if it looks up or down.

    ``sensor_poses(sensor, kind, rx..rz, tx..tz)``.
    """
    lidar = F.col("kind") == "lidar"
    ahead = poses.rotate(v.vec("r"), (F.when(lidar, 1.0).otherwise(0.0), F.lit(0.0), F.when(lidar, 0.0).otherwise(1.0)))
    size = F.sqrt(ahead[0] * ahead[0] + ahead[1] * ahead[1])
    flat = lambda c: F.when(size > 1e-12, c / F.when(size > 1e-12, size)).otherwise(0.0)
    return sensor_poses.select("sensor", "kind", F.col("tx").alias("x"), F.col("ty").alias("y"), flat(ahead[0]).alias("dx"), flat(ahead[1]).alias("dy"))


def in_common_frame(points: DataFrame, sensor_poses: DataFrame, beyond: float | None = None) -> DataFrame:
    """Points of all sensors in the reference frame; with ``beyond``, only those nearer to their sensor."""
    if beyond is not None:
        points = points.where(v.norm(v.vec()) < beyond)
    both = points.join(sensor_poses, "sensor")
    moved = poses.transform(v.vec("r"), v.vec("t"), v.vec())
    return both.select(*(c for c in points.columns if c not in "xyz"), *(m.alias(c) for m, c in zip(moved, "xyz", strict=True)))


def axes(sensor_poses: DataFrame, length: float = 1.0) -> DataFrame:
    """``(sensor, axis, x, y, z, dx, dy, dz)``: the axes of every frame."""
    rows = []
    for k, name in enumerate("xyz"):
        d = poses.rotate(v.vec("r"), tuple(F.lit(length if i == k else 0.0) for i in range(3)))
        rows.append(F.struct(F.lit(name).alias("axis"), *(c.alias("d" + n) for c, n in zip(d, "xyz", strict=True))))
    out = sensor_poses.select("sensor", *(F.col("t" + c).alias(c) for c in "xyz"), F.explode(F.array(*rows)).alias("a"))
    return out.select("sensor", "a.axis", *"xyz", *("a.d" + c for c in "xyz"))
