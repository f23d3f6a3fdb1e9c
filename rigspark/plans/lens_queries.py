"""Queries on distorting lenses and on ellipsoids of uncertainty, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lenses
from ..functions import vectors as v
from ..operators import calibration, views
from ..sources import fixtures as fx
from .catalogue import query

LENS = (800.0, 810.0, 640.0, 480.0, -0.2, 0.05, 0.001, -0.0005, 0.01, 0.02, 0.01, -0.003, 0.001, 0.002, -0.001, 0.0005)
_AHEAD = f"{fx.POINTS_SQL}, ahead AS (SELECT scan, ring, point_idx, x / (abs(z) + 5) AS a, y / (abs(z) + 5) AS b FROM points), radii AS (SELECT *, a * a + b * b AS r FROM ahead)"
_BENT = f"""{_AHEAD}, gains AS (SELECT *, (1 - 0.2::DOUBLE * r + 0.05::DOUBLE * r * r + 0.01::DOUBLE * r * r * r) / (1 + 0.02::DOUBLE * r + 0.01::DOUBLE * r * r - 0.003::DOUBLE * r * r * r) AS g FROM radii),
bent AS (SELECT scan, ring, point_idx,
  800 * (a * g + 0.002::DOUBLE * a * b - 0.0005::DOUBLE * (r + 2 * a * a) + 0.001::DOUBLE * r + 0.002::DOUBLE * r * r) + 640 AS u,
  810 * (b * g + 0.001::DOUBLE * (r + 2 * b * b) - 0.001::DOUBLE * a * b - 0.001::DOUBLE * r + 0.0005::DOUBLE * r * r) + 480 AS v FROM gains)"""


def _ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.points(spark, sf_dir).select("scan", "ring", "point_idx", "x", "y", (F.abs("z") + 5).alias("z"))


@query("lens_pixels", f"WITH {_BENT} SELECT scan, ring, point_idx, round(u, 5) AS u, round(v, 5) AS v FROM bent")
def lens_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of points through a lens with all twelve coefficients."""
    px, py = lenses.project(v.vec(), LENS)
    return _ahead(spark, sf_dir).select("scan", "ring", "point_idx", F.round(px, 5).alias("u"), F.round(py, 5).alias("v"))


@query("lens_rays", f"WITH {_AHEAD} SELECT scan, ring, point_idx, round(a, 7) + 0 AS a, round(b, 7) + 0 AS b FROM radii WHERE r < 1")
def lens_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays found back from the pixels that the lens gives."""
    px, py = lenses.project(v.vec(), LENS)
    a, b, _ = lenses.unproject(F.col("u"), F.col("v"), LENS)
    x, y = F.col("x") / F.col("z"), F.col("y") / F.col("z")
    rows = _ahead(spark, sf_dir).where(x * x + y * y < 1).withColumns({"u": px, "v": py})
    return rows.select("scan", "ring", "point_idx", (F.round(a, 7) + 0.0).alias("a"), (F.round(b, 7) + 0.0).alias("b"))


@query("uncertainty_ellipsoids", f"WITH {fx.POINTS_SQL} SELECT scan, ring, 50 AS places, round(covar_samp(x, x) + covar_samp(y, y) + covar_samp(z, z), 5) AS whole, 1.0::DOUBLE AS least, 1.0::DOUBLE AS most FROM points GROUP BY scan, ring")
def uncertainty_ellipsoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ellipsoids of each ring's points: every place on one has distance 1 by the inverse covariance."""
    sums = [F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    rows = fx.points(spark, sf_dir).groupBy("scan", "ring").agg(*sums).withColumns({c: F.lit(0.0) for c in "xyz"})
    out = calibration.ellipsoid_points(calibration.ellipsoid_axes(rows), views.sphere_grid(spark, 10, 5))
    xx, xy, xz, yy, yz, zz = (F.col("c" + k) for k in ("xx", "xy", "xz", "yy", "yz", "zz"))
    a, b, c = F.col("ex"), F.col("ey"), F.col("ez")
    inner = a * a * (yy * zz - yz * yz) + b * b * (xx * zz - xz * xz) + c * c * (xx * yy - xy * xy) + 2 * a * b * (xz * yz - xy * zz) + 2 * a * c * (xy * yz - xz * yy) + 2 * b * c * (xy * xz - xx * yz)
    whole = xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)
    square = F.col("s1") * F.col("s1") + F.col("s2") * F.col("s2") + F.col("s3") * F.col("s3")
    out = out.withColumn("d", F.round(inner / whole, 6))
    return out.groupBy("scan", "ring").agg(F.count("*").cast("int").alias("places"), F.round(F.max(square), 5).alias("whole"), F.min("d").alias("least"), F.max("d").alias("most"))
