"""Logs, solve bundles, camera models and pose files."""

from __future__ import annotations

import ast

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import poses
from ..functions.lenses import MODELS
from ..functions import vectors as v

POINTS = T.StructType([T.StructField("scan", T.LongType()), T.StructField("ring", T.IntegerType()), T.StructField("point_idx", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in "xyz")])


def read_log(spark: SparkSession, paths: list[str], topics: list[str] | None = None, start_us: int | None = None, stop_us: int | None = None) -> DataFrame:
    """Messages of Parquet logs with their ``bag``, the name of a log's folder, or of its file where it is not a part of one; filters reach the scan."""
    log = spark.read.parquet(*paths)
    if topics is not None:
        log = log.where(F.col("topic").isin(topics))
    if start_us is not None:
        log = log.where(F.col("time_us") >= start_us)
    if stop_us is not None:
        log = log.where(F.col("time_us") < stop_us)
    return log.withColumn("bag", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:/part-[^/]*|\.parquet)?$", 1))


def scans_from_arrays(spark: SparkSession, scans: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """A scan table from an (N, 3) array of points and an (N,) array of rings for each scan, checked, as columns all the way."""
    parts = []
    for scan, (points, rings) in scans.items():
        points, rings = np.asarray(points), np.asarray(rings)
        if points.ndim != 2 or points.shape[1] != 3 or not np.issubdtype(points.dtype, np.floating):
            raise ValueError(f"scan {scan}: points must be (N, 3) floats, not {points.shape} {points.dtype}")
        if rings.shape != points.shape[:1] or not np.issubdtype(rings.dtype, np.integer) or (len(rings) and rings.min() < 0):
            raise ValueError(f"scan {scan}: rings must be {len(points)} integers from 0, not {rings.shape} {rings.dtype}")
        parts.append(pa.table({"scan": np.full(len(points), scan, np.int64), "ring": rings.astype(np.int32), "point_idx": np.arange(len(points)), **{c: points[:, k].astype(np.float64) for k, c in enumerate("xyz")}}))
    return spark.createDataFrame(pa.concat_tables(parts), POINTS) if parts else spark.createDataFrame([], POINTS)


def camera_model(text: str) -> dict:
    """A camera model written as a Python literal: its lens, image size, and its pose if it has one; pinholes and their distortions are known."""
    model = ast.literal_eval(text)
    kind, values = model.get("lensmodel"), tuple(map(float, model["intrinsics"]))
    if kind not in MODELS:
        raise ValueError(f"lens model {kind!r} is not known")
    if len(values) != 4 + MODELS[kind]:
        raise ValueError(f"{kind} has {4 + MODELS[kind]} intrinsics, not {len(values)}")
    pose = model.get("extrinsics")
    return {"lens": values, "size": tuple(map(int, model["imagersize"])), "pose": None if pose is None else tuple(map(float, pose))}


def write_pose_files(pose_table: DataFrame, folder: str, names: dict[int, str]) -> None:
    """A small text file for each sensor with its pose, under the sensor's name; a failed write leaves none.

    Each sensor's line is a partition of its own, and Spark's committer moves
    the files when all are written.
    """
    name = F.create_map(*(F.lit(k) for item in names.items() for k in item))[F.col("sensor")]
    numbers = F.concat_ws(", ", *(F.col(k + c).cast("string") for k in "rt" for c in "xyz"))
    lines = pose_table.select(name.alias("name"), F.concat(F.lit("rt = ["), numbers, F.lit("]")).alias("value"))
    if lines.where("name is null").count():
        raise ValueError("a sensor has no name")
    lines.repartition("name").write.partitionBy("name").text(folder)


def agreed(values: DataFrame, column: str):
    """The one value that all rows share; several are an error."""
    found = [r[0] for r in values.select(column).distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{column} must be the same everywhere, found {found}")
    return found[0]


def write_bundle(folder: str, **tables: DataFrame) -> None:
    """The inputs or the result of a solve, a Parquet table each."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_bundle(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def transforms_yaml(pose_table: DataFrame, base: str, names: dict[int, str]) -> DataFrame:
    """A line of text for each sensor: its frame in ``base`` as translation and quaternion."""
    x, y, z, w = poses.quaternion(v.vec("r"))
    number = lambda c: F.format_string("%.9f", c)
    name = F.create_map(*(F.lit(k) for item in names.items() for k in item))[F.col("sensor")]
    line = F.concat(name, F.lit(f": {{parent: {base}, translation: ["), F.concat_ws(", ", *(number(F.col("t" + c)) for c in "xyz")), F.lit("], rotation: ["), F.concat_ws(", ", *map(number, (x, y, z, w))), F.lit("]}"))
    return pose_table.orderBy("sensor").select(line.alias("value"))


def static_transform(transforms: DataFrame, parent: str, child: str):
    """The first transform from ``child`` to ``parent`` among rows ``(time_us, transforms array<struct<parent, child, pose>>)``, or None."""
    rows = transforms.select("time_us", F.explode("transforms").alias("t")).where((F.col("t.parent") == parent) & (F.col("t.child") == child))
    found = rows.agg(F.min_by("t.pose", "time_us").alias("pose")).first()
    return found["pose"]
