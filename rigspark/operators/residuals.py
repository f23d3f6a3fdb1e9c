"""Measurement residuals and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lenses, poses
from ..functions import vectors as v

SIGMA_M, SIGMA_PX = 0.03, 0.15
REGULAR_R, REGULAR_T = 1 / 100, 1 / 10000


def board_grid(spark: SparkSession, height: int, width: int, spacing: float) -> DataFrame:
    """``(i, j, x, y, z)``: corners of the ideal board."""
    i, j = F.floor(F.col("id") / width), F.col("id") % width
    return spark.range(height * width).select(i.cast("int").alias("i"), j.cast("int").alias("j"), (j * spacing).alias("x"), (i * spacing).alias("y"), F.lit(0.0).alias("z"))


def board_centre(height: int, width: int, spacing: float) -> tuple[float, float, float]:
    """The exact middle, also of a board with an even number of corners."""
    return (width - 1) / 2 * spacing, (height - 1) / 2 * spacing, 0.0


def _board_normal() -> v.Vec:
    return poses.rotate(v.vec("br"), (F.lit(0.0), F.lit(0.0), F.lit(1.0)))


def lidar_residuals(rows: DataFrame) -> DataFrame:
    """``rows`` with ``plane_error`` and ``range_error`` in standard deviations.

    ``rows(x, y, z)`` are points in lidar frames, with poses ``lr?, lt?`` of
    the lidar and ``br?, bt?`` of the board, both in the reference frame.
    """
    p = v.vec()
    n = _board_normal()
    d = v.dot(n, v.vec("bt"))
    at = poses.transform(v.vec("lr"), v.vec("lt"), p)
    # along the ray of the point, from the lidar to the board's plane
    turned = v.dot(n, poses.rotate(v.vec("lr"), p))
    ahead = d - v.dot(n, v.vec("lt"))
    plane = (d - v.dot(n, at)) / SIGMA_M
    span = v.norm(p) * (1 - ahead / F.when(turned != 0, turned)) / SIGMA_M
    return rows.withColumns({"plane_error": plane, "range_error": span})


def camera_residuals(rows: DataFrame) -> DataFrame:
    """``rows`` with ``eu``, ``ev`` in standard deviations.

    ``rows(x, y, z)`` are board corners, with poses ``cr?, ct?`` of the camera
    and ``br?, bt?`` of the board, intrinsics ``fx, fy, cx, cy``, those of the
    distortion's coefficients that are columns, and observed ``u, v``.
    """
    in_reference = poses.transform(v.vec("br"), v.vec("bt"), v.vec())
    r, t = poses.inverse(v.vec("cr"), v.vec("ct"))
    names = ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2", "k3", "k4", "k5", "k6", "s1", "s2", "s3", "s4")
    u, w = lenses.project(poses.transform(r, t, in_reference), [F.col(n) if n in rows.columns else 0.0 for n in names])
    return rows.withColumns({"eu": (u - F.col("u")) / SIGMA_PX, "ev": (w - F.col("v")) / SIGMA_PX})


def regularisation(boards: DataFrame) -> DataFrame:
    """``(snapshot, k, error)``: six small residuals that hold each board's pose."""
    parts = [F.struct(F.lit(k).alias("k"), (F.col(c) * w).alias("error")) for k, (c, w) in enumerate([(f"br{c}", REGULAR_R) for c in "xyz"] + [(f"bt{c}", REGULAR_T) for c in "xyz"])]
    return boards.select("snapshot", F.explode(F.array(*parts)).alias("e")).select("snapshot", "e.k", "e.error")


def rms(residuals: DataFrame) -> DataFrame:
    """``(kind, n, rms)`` of ``residuals(kind, error)``; a camera's two errors are one measurement."""
    n = F.when(F.col("kind") == "camera", F.count("*") / 2).otherwise(F.count("*"))
    return residuals.groupBy("kind").agg(F.count("*").alias("n"), F.sqrt(F.sum(F.col("error") * F.col("error")) / n).alias("rms"))


def histogram(residuals: DataFrame, width: float = 0.1, most: float = 3.0) -> DataFrame:
    """Counts of errors in bins of a tenth of a standard deviation, within three of them."""
    inside = residuals.where(F.abs("error") <= most)
    return inside.groupBy("kind", F.floor(F.col("error") / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def insane(residuals: DataFrame, most_m: float = 100.0, most_px: float = 1000.0) -> DataFrame:
    """Seed residuals that no solve should start from."""
    limit = F.when(F.col("kind") == "camera", most_px / SIGMA_PX).otherwise(most_m / SIGMA_M)
    return residuals.where(F.abs("error") > limit)
