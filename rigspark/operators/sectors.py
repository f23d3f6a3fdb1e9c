"""Reports by direction around the vehicle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lenses, poses
from ..functions import vectors as v

#: Columns of a lens; the coefficients of a distortion may be missing.
LENS = ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2", "k3", "k4", "k5", "k6", "s1", "s2", "s3", "s4")


def sector_frame(spark: SparkSession, sectors: int) -> DataFrame:
    return spark.range(sectors).select(F.col("id").cast("int").alias("sector"))


def query_points(spark: SparkSession, sectors: int, at: float) -> DataFrame:
    """``(sector, x, y, z)`` in the vehicle frame: the centre of each sector at a distance."""
    yaw = (F.col("sector") + 0.5) * (2 * math.pi / sectors)
    return sector_frame(spark, sectors).select("sector", (at * F.cos(yaw)).alias("x"), (at * F.sin(yaw)).alias("y"), F.lit(0.0).alias("z"))


def observations_per_sector(boards: DataFrame, sectors: int) -> DataFrame:
    """Boards ``(snapshot, x, y)`` in the vehicle frame by sector, zero for sectors without."""
    counts = boards.withColumn("sector", v.sector(F.col("x"), F.col("y"), sectors)).groupBy("sector").agg(F.count("*").alias("n"))
    return sector_frame(boards.sparkSession, sectors).join(counts, "sector", "left").select("sector", F.coalesce("n", F.lit(0)).alias("n"))


def board_centres(seen: DataFrame) -> DataFrame:
    """Mean board centre over the sensors that see it: ``seen(snapshot, sensor, x, y, z)``."""
    return seen.groupBy("snapshot").agg(*(F.avg(c).alias(c) for c in "xyz"))


def lidar_visibility(points: DataFrame, lidar: str, sectors: int, beyond: float, at_least: int) -> DataFrame:
    """``(lidar, sector, n, visible)``: enough returns from far enough in each sector; points in the vehicle frame."""
    far = points.where(v.norm(v.vec()) >= beyond).withColumn("sector", v.sector(F.col("x"), F.col("y"), sectors))
    counts = far.groupBy(lidar, "sector").agg(F.count("*").alias("n"))
    every = points.select(lidar).distinct().crossJoin(F.broadcast(sector_frame(points.sparkSession, sectors)))  # a fixed number of sectors
    n = F.coalesce("n", F.lit(0))
    return every.join(counts, [lidar, "sector"], "left").select(lidar, "sector", n.alias("n"), (n >= at_least).alias("visible"))


def camera_visibility(cameras: DataFrame, sectors: int, at: float) -> DataFrame:
    """``(camera, sector, visible)``: both edges of the sector, at a distance, lie in the image.

    ``cameras(camera, rx..rz, tx..tz, fx, fy, cx, cy, width, height)``; the
    pose takes camera points to the vehicle frame.
    """
    yaw = F.col("sector") * (2 * math.pi / sectors)
    edge = (at * F.cos(yaw), at * F.sin(yaw), F.lit(0.0))
    r, t = poses.inverse(v.vec("r"), v.vec("t"))
    rows = cameras.crossJoin(F.broadcast(sector_frame(cameras.sparkSession, sectors)))  # a fixed number of sectors
    rows = rows.withColumns({"_" + c: x for c, x in zip("xyz", poses.transform(r, t, edge), strict=True)})
    seen = rows.select("camera", "sector", lenses.in_view(v.vec("_"), [F.col(n) if n in cameras.columns else 0.0 for n in LENS], F.col("width"), F.col("height")).alias("edge"))
    after = seen.select("camera", ((F.col("sector") + sectors - 1) % sectors).alias("sector"), F.col("edge").alias("next"))
    return seen.join(after, ["camera", "sector"]).select("camera", "sector", (F.col("edge") & F.col("next")).alias("visible"))


def visible_pairs(visible: DataFrame) -> DataFrame:
    """``(sector, sensor0, sensor1)`` of sensors that both see a sector; ``visible(sensor, sector, visible)``."""
    seen = visible.where("visible").select("sector", "sensor")
    a, b = seen.alias("a"), seen.alias("b")
    return a.join(b, (F.col("a.sector") == F.col("b.sector")) & (F.col("a.sensor") < F.col("b.sensor"))).select("a.sector", F.col("a.sensor").alias("sensor0"), F.col("b.sensor").alias("sensor1"))


def worst_pairs(stdevs: DataFrame, sectors: int) -> DataFrame:
    """The pair with the largest ``stdev`` by sector, the first of equals; zero and no pair for sectors without."""
    order = F.struct("stdev", F.negate("sensor0"), F.negate("sensor1"))
    worst = stdevs.groupBy("sector").agg(F.max("stdev").alias("stdev"), F.max_by("sensor0", order).alias("sensor0"), F.max_by("sensor1", order).alias("sensor1"))
    return sector_frame(stdevs.sparkSession, sectors).join(worst, "sector", "left").select("sector", F.coalesce("stdev", F.lit(0.0)).alias("stdev"), "sensor0", "sensor1")
