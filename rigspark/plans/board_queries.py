"""Queries on synthetic boards and rigs; they have no SQL form, tests compare them with the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration, segmentation
from ..operators.parameters import SegmentationParameters
from ..sources import fixtures as fx
from ..sources import synthetic
from ..storage import Scratch
from .catalogue import query

SCANS = {0: ((3.0, 0.3, 0.1), (1.0, 0.2, 0.1), 1.0), 1: ((-2.5, 1.5, 0.0), (-1.0, 0.3, 0.2), 1.0), 2: ((12.0, 0.0, 0.0), (1.0, 0.0, 0.0), 1.0)}


@query("segment_planes")
def segment_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = {k: synthetic.board_scan(c, n, size=s) for k, (c, n, s) in SCANS.items()}
    return segmentation.segment_planes(synthetic.scans_table(spark, scans), SegmentationParameters(per_rotation=2048)).drop("points")


def rig_points(spark: SparkSession, **options) -> DataFrame:
    _, _, rows = synthetic.rig(**options)
    return spark.createDataFrame(rows, "snapshot int, sensor int, x double, y double, z double")


def _kept(points: DataFrame) -> DataFrame:
    """The rig's points as a table; a solve reads them several times."""
    with Scratch(points.sparkSession) as scratch:
        return scratch.stored(points, "points")


@query("calibrate")
def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses of a rig that saw a board for each vector."""
    return calibration.pose_table(calibration.calibrate(_kept(fx.rig_points(spark, sf_dir)), sensors=len(fx.LIDARS)), spark)


@query("sector_uncertainty")
def sector_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By direction: boards seen, the lidars that see it, the worst pair of these and its deviation."""
    points = _kept(fx.rig_points(spark, sf_dir))
    return calibration.sector_report(points, calibration.calibrate(points, sensors=len(fx.LIDARS)), 36, 10.0)


@query("calibrate_cameras")
def calibrate_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses of two lidars and two cameras, one with a distorting lens."""
    return calibration.pose_table(calibration.calibrate(_kept(fx.mixed_rig(spark, sf_dir)), fx.LENSES, sensors=len(fx.MIXED)), spark)


@query("replay_monte_carlo")
def replay_monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard deviations of the poses' numbers over 20 replays with fresh noise, beside those of the solve."""
    points = _kept(fx.rig_points(spark, sf_dir))
    first = calibration.calibrate(points, sensors=len(fx.LIDARS))
    sampled = calibration.replay_covariance(calibration.replayed(points, first, 20, sigma_m=0.01)).where("i = j")
    told = calibration.covariance_table(first, spark).where("i = j").select("i", F.sqrt("value").alias("solve_stdev"))
    return sampled.select("i", F.sqrt("value").alias("replay_stdev")).join(told, "i")
