"""Sensor tables derived from the generic tables: a point cloud from ``embeddings``, a log from ``events``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lenses, poses
from ..functions import vectors as v

RINGS = 21
SNAPSHOTS = 37


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(scan, ring, point_idx, x, y, z)``: each vector gives one point for each of 21 rings."""
    e = F.col("embedding")
    triple = F.transform(F.sequence(F.lit(0), F.lit(RINGS - 1)), lambda i: F.array(*(F.get(e, 3 * i + k).cast("double") * 10 for k in range(3))))
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("scan"), F.col("vec_id").alias("point_idx"), F.posexplode(triple).alias("ring", "p"))
    return rows.select("scan", "ring", "point_idx", *(F.get("p", F.lit(k)).alias(c) for k, c in enumerate("xyz")))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(topic, time_us, msg_id, value)``."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), us.alias("time_us"), F.col("event_id").alias("msg_id"), "value")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ``(snapshot, sensor)`` with a point above 0.9."""
    return points(spark, sf_dir).where("z > 0.9").select((F.col("point_idx") % SNAPSHOTS).alias("snapshot"), F.col("ring").alias("sensor")).distinct()


#: Poses of a rig's lidars, and of a rig's lidars and cameras: rotation and translation in the frame of sensor 0.
LIDARS = ((0.0,) * 6, (0.1, -0.2, 0.3, 0.4, -0.6, 0.2), (-0.3, 0.15, 0.5, -0.5, 0.3, -0.1))
_LOOK = (-1.2091995761561452, 1.2091995761561452, -1.2091995761561452)  # turns z to x and x to -y
MIXED = ((0.0,) * 6, (0.1, -0.05, 0.2, 0.3, -0.5, 0.2), (*_LOOK, 0.2, 0.1, -0.1), (_LOOK[0] + 0.05, _LOOK[1] - 0.04, _LOOK[2] + 0.03, 0.0, -0.3, 0.1))
#: Lenses of the cameras of ``MIXED``: one bends lines, one does not.
IMAGE = (1280, 960)
LENSES = {2: (800.0, 810.0, 640.0, 480.0, -0.2, 0.05, 0.001, -0.0005, 0.01), 3: (700.0, 700.0, 600.0, 500.0)}


def _numbers(k: int) -> Column:
    return F.get("embedding", F.lit(k)).cast("double")


def _frames(boards: DataFrame) -> DataFrame:
    """``boards(..., cx..cz, nx..nz)`` with unit normals and two axes ``ax..az, bx..bz`` in the board."""
    n = tuple(F.col("n" + c) / F.sqrt(v.dot(v.vec("n"), v.vec("n"))) for c in "xyz")
    boards = boards.withColumns({"n" + c: x for c, x in zip("xyz", n, strict=True)})
    side = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny"))
    boards = boards.withColumns({"ax": -F.col("ny") / side, "ay": F.col("nx") / side, "az": F.lit(0.0)})
    return boards.withColumns({"b" + c: x for c, x in zip("xyz", v.cross(v.vec("n"), v.vec("a")), strict=True)})


def _seen_from(rows: DataFrame, sensors: tuple) -> DataFrame:
    """Places ``wx..wz`` of the reference frame in each sensor's, as ``x, y, z``."""
    w, seen = v.vec("w"), []
    for k, pose in enumerate(sensors):
        m, t = poses.matrix(np.array(pose[:3])), pose[3:]
        place = [sum((float(m[j, i]) * (w[j] - float(t[j])) for j in (1, 2)), float(m[0, i]) * (w[0] - float(t[0]))) for i in range(3)]
        seen.append(F.struct(F.lit(k).alias("sensor"), *(x.alias(c) for c, x in zip("xyz", place, strict=True))))
    return rows.withColumn("s", F.explode(F.array(*seen))).select(*rows.columns, "s.sensor", "s.x", "s.y", "s.z")


def _noise(sigma: float, *keys: str) -> Column:
    """Noise with a given deviation that depends on the keys only: a sum of twelve even draws."""
    draws = [F.pmod(F.xxhash64(*keys, F.lit(k)), F.lit(1 << 20)) / float(1 << 20) for k in range(12)]
    return sigma * (sum(draws[1:], draws[0]) - 6.0)


def rig_points(spark: SparkSession, sf_dir: str, sigma: float = 0.01) -> DataFrame:
    """``(snapshot, sensor, x, y, z)``: a board of 16 points for each vector, around the rig ``LIDARS``, with noise along the rays."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null and vec_id is not null")
    yaw = F.col("vec_id") * 2.399963229728653
    centre = {"cx": 4 * F.cos(yaw), "cy": 4 * F.sin(yaw), "cz": 2 * _numbers(0)}
    normal = {"nx": F.cos(yaw) + 2 * _numbers(1), "ny": F.sin(yaw) + 2 * _numbers(2), "nz": 2 * _numbers(3)}
    boards = _frames(e.select(F.col("vec_id").alias("snapshot"), *(x.alias(k) for k, x in (centre | normal).items())))
    k = F.explode(F.sequence(F.lit(0), F.lit(15)))
    rows = boards.withColumn("k", k).withColumns({"i": (F.col("k") % 4 - 1.5) * 0.3, "j": (F.floor(F.col("k") / 4) - 1.5) * 0.3})
    rows = rows.withColumns({f"w{c}": F.col(f"c{c}") + F.col("i") * F.col(f"a{c}") + F.col("j") * F.col(f"b{c}") for c in "xyz"})
    rows = _seen_from(rows, LIDARS)
    far = 1 + _noise(sigma, "snapshot", "sensor", "k") / v.norm(v.vec())
    return rows.withColumn("far", far).select("snapshot", "sensor", *((F.col(c) * F.col("far")).alias(c) for c in "xyz"))


def mixed_rig(spark: SparkSession, sf_dir: str, sigma: float = 0.01, sigma_px: float = 0.1) -> DataFrame:
    """``(snapshot, sensor, x, y, z, u, v)``: a board of 4 x 4 corners for each vector ahead of the rig ``MIXED``, for cameras the corners in the board's frame and their pixels."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null and vec_id is not null")
    centre = {"cx": 3.2 + 2 * _numbers(0), "cy": 2 * _numbers(1), "cz": 2 * _numbers(2)}
    normal = {"nx": F.lit(1.0), "ny": 2 * _numbers(3), "nz": 2 * _numbers(4)}
    boards = _frames(e.select(F.col("vec_id").alias("snapshot"), *(x.alias(k) for k, x in (centre | normal).items())))
    rows = boards.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumns({"i": F.col("k") % 4 * 0.15, "j": F.floor(F.col("k") / 4) * 0.15})
    rows = rows.withColumns({f"w{c}": F.col(f"c{c}") + (F.col("i") - 0.225) * F.col(f"a{c}") + (F.col("j") - 0.225) * F.col(f"b{c}") for c in "xyz"})
    rows = _seen_from(rows, MIXED)
    lidars = rows.where("sensor < 2").withColumn("far", 1 + _noise(sigma, "snapshot", "sensor", "k") / v.norm(v.vec()))
    none = F.lit(None).cast("double")
    out = lidars.select("snapshot", "sensor", *((F.col(c) * F.col("far")).alias(c) for c in "xyz"), none.alias("u"), none.alias("v"))
    for s, lens in LENSES.items():
        px, py = lenses.project(v.vec(), lens)
        own = rows.where((F.col("sensor") == s) & (F.col("z") > 0.2)).withColumns({"u": px, "v": py}).where(F.col("u").between(0, IMAGE[0] - 1) & F.col("v").between(0, IMAGE[1] - 1))
        own = own.withColumns({"u": F.col("u") + _noise(sigma_px, "snapshot", "sensor", "k"), "v": F.col("v") + _noise(sigma_px, "k", "sensor", "snapshot")})
        out = out.unionByName(own.select("snapshot", "sensor", F.col("i").alias("x"), F.col("j").cast("double").alias("y"), F.lit(0.0).alias("z"), "u", "v"))
    return out


#: Common table expressions of the same tables for other SQL engines.
POINTS_SQL = f"""points AS (
  SELECT label AS scan, r.i::INT AS ring, vec_id AS point_idx, embedding[3 * r.i + 1]::DOUBLE * 10 AS x, embedding[3 * r.i + 2]::DOUBLE * 10 AS y, embedding[3 * r.i + 3]::DOUBLE * 10 AS z
  FROM embeddings, range({RINGS}) r(i))"""
MESSAGES_SQL = "messages AS (SELECT event_type AS topic, epoch_us(ts) AS time_us, event_id AS msg_id, value FROM events)"
OBSERVATIONS_SQL = f"{POINTS_SQL}, observations AS (SELECT DISTINCT point_idx % {SNAPSHOTS} AS snapshot, ring AS sensor FROM points WHERE z > 0.9)"
