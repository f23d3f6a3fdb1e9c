"""Queries on message logs, co-observations, sectors and residuals, with their SQL."""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import poses
from ..functions import vectors as v
from ..operators import links, residuals, sectors, snapshots, views
from ..sources import fixtures as fx
from .catalogue import query

PI = repr(math.pi)
#: 2024-01-01 and 2024-01-11 in microseconds, and an hour.
T0, T1, HOUR = 1704067200000000, 1704931200000000, 3600000000
SEGMENT = 10 * 60 * 1000000
PERIODS = [(T0 + 5 * HOUR, T0 + 9 * HOUR), (T0 + 30 * HOUR, T0 + 31 * HOUR), (T0 + 30 * HOUR + 1000, T0 + 40 * HOUR)]

_PERIODS = "periods(t0, t1) AS (VALUES " + ", ".join(f"({a}, {b})" for a, b in PERIODS) + ")"
_SEGMENTS = f"{fx.MESSAGES_SQL}, segments AS (SELECT *, (time_us - {T0}) // {SEGMENT} AS segment FROM messages WHERE time_us >= {T0})"
_DECIMATED = f"{_SEGMENTS}, decimated AS (SELECT segment, topic, time_us, msg_id, value FROM (SELECT *, row_number() OVER (PARTITION BY segment, topic ORDER BY time_us, msg_id) AS place FROM segments) WHERE place = 1)"


def _decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.decimated(fx.messages(spark, sf_dir), SEGMENT, T0)


@query("bag_info", f"WITH {fx.MESSAGES_SQL} SELECT min(time_us) AS t0, max(time_us) AS t1, count(*) AS n, (SELECT string_agg(topic, ',' ORDER BY topic) FROM (SELECT DISTINCT topic FROM messages)) AS topics FROM messages")
def bag_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.info(fx.messages(spark, sf_dir))


@query("bag_topics", f"WITH {fx.MESSAGES_SQL} SELECT DISTINCT topic FROM messages")
def bag_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.topics(fx.messages(spark, sf_dir))


@query("messages_window", f"WITH {fx.MESSAGES_SQL} SELECT topic, time_us, msg_id FROM messages WHERE time_us >= {T0 + HOUR} AND time_us < {T1} AND topic IN ('view', 'click')")
def messages_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.in_window(fx.messages(spark, sf_dir).where(F.col("topic").isin("view", "click")), T0 + HOUR, T1).select("topic", "time_us", "msg_id")


@query("topic_exclusion", f"WITH {fx.MESSAGES_SQL} SELECT topic, count(*) AS n FROM messages WHERE NOT regexp_matches(topic, 'i[ce]') GROUP BY topic")
def topic_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.messages(spark, sf_dir).where(~F.col("topic").rlike("i[ce]")).groupBy("topic").agg(F.count("*").alias("n"))


@query("first_per_topic", f"WITH {fx.MESSAGES_SQL} SELECT topic, time_us, msg_id, value FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY time_us, msg_id) AS place FROM messages) WHERE place = 1")
def first_per_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.first_messages(fx.messages(spark, sf_dir), ["topic"])


@query("decimate_first", f"WITH {_DECIMATED} SELECT * FROM decimated")
def decimate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decimated(spark, sf_dir)


@query("snapshot_usable", f"WITH {_DECIMATED} SELECT segment, count(DISTINCT topic) AS n_topics FROM decimated GROUP BY segment HAVING count(DISTINCT topic) >= 2")
def snapshot_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.usable(_decimated(spark, sf_dir))


@query("snapshot_spread", f"WITH {_DECIMATED} SELECT * FROM decimated SEMI JOIN (SELECT segment FROM decimated GROUP BY segment HAVING max(time_us) - min(time_us) <= 240000000) USING (segment)")
def snapshot_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.tight(_decimated(spark, sf_dir), 240_000_000)


@query("last_snapshot", f"WITH {_DECIMATED} SELECT topic, max(segment) AS segment, arg_max(msg_id, time_us) AS msg_id FROM decimated GROUP BY topic")
def last_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.last_snapshot(_decimated(spark, sf_dir), ["topic"])


@query("exclude_periods", f"WITH {fx.MESSAGES_SQL}, {_PERIODS} SELECT topic, time_us, msg_id, value FROM messages m WHERE NOT EXISTS (SELECT 1 FROM periods p WHERE m.time_us BETWEEN p.t0 AND p.t1)")
def exclude_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.without_periods(fx.messages(spark, sf_dir), spark.createDataFrame(PERIODS, "t0 long, t1 long"))


@query("missing_topics", f"WITH {fx.MESSAGES_SQL}, wanted(topic) AS (VALUES ('view'), ('lidar0'), ('click'), ('camera0')) SELECT topic FROM wanted ANTI JOIN messages USING (topic)")
def missing_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.missing_topics(fx.messages(spark, sf_dir), spark.createDataFrame([("view",), ("lidar0",), ("click",), ("camera0",)], "topic string"))


_POINTED = f"{fx.MESSAGES_SQL}, pointed AS (SELECT *, CASE WHEN topic IN ('click', 'signup') THEN value END AS payload FROM messages)"
_KINDS = f"{_POINTED}, kinds AS (SELECT topic, CASE WHEN bool_and(payload IS NOT NULL) THEN 'lidar' WHEN NOT bool_or(payload IS NOT NULL) THEN 'camera' ELSE 'mixed' END AS kind FROM pointed GROUP BY topic)"


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.messages(spark, sf_dir).withColumn("payload", F.when(F.col("topic").isin("click", "signup"), F.col("value")))
    return snapshots.classified(log, "payload")


@query("sensor_kinds", f"WITH {_KINDS} SELECT topic, kind FROM kinds")
def sensor_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, sf_dir)


@query("sensor_order", f"WITH {_KINDS}, places(topic, place) AS (VALUES ('view', 0), ('signup', 1), ('purchase', 2), ('click', 3), ('error', 4)) SELECT (row_number() OVER (ORDER BY kind <> 'lidar', place) - 1)::INT AS sensor, topic, kind FROM kinds JOIN places USING (topic)")
def sensor_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = spark.createDataFrame([(t, i) for i, t in enumerate(("view", "signup", "purchase", "click", "error"))], "topic string, place int")
    return snapshots.lidars_first(_kinds(spark, sf_dir), places).withColumn("sensor", F.col("sensor").cast("int"))


@query("timeline", f"WITH {fx.MESSAGES_SQL} SELECT topic, msg_id, time_us - (SELECT min(time_us) FROM messages) AS since_us FROM messages WHERE time_us - (SELECT min(time_us) FROM messages) <= {24 * HOUR}")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.timeline(fx.messages(spark, sf_dir), 24 * HOUR).select("topic", "msg_id", "since_us")


_LINKS = f"{fx.OBSERVATIONS_SQL}, links AS (SELECT a.sensor AS sensor0, b.sensor AS sensor1, count(*) AS n FROM observations a JOIN observations b ON a.snapshot = b.snapshot AND a.sensor < b.sensor GROUP BY ALL)"


@query("sensor_links", f"WITH {_LINKS} SELECT * FROM links")
def sensor_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.co_observations(fx.observations(spark, sf_dir))


@query("links_pruned", f"WITH {_LINKS} SELECT * FROM links WHERE n >= 18")
def links_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.pruned(links.co_observations(fx.observations(spark, sf_dir)), 18)


@query("selected_snapshots", f"WITH {fx.OBSERVATIONS_SQL} SELECT snapshot, count(DISTINCT sensor) AS n_sensors FROM observations GROUP BY snapshot HAVING count(DISTINCT sensor) >= 2")
def selected_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.selected_snapshots(fx.observations(spark, sf_dir))


@query("sensor_counts_guard", f"WITH {fx.OBSERVATIONS_SQL} SELECT s.i::INT AS sensor, CASE WHEN s.i < 12 THEN 'lidar' ELSE 'camera' END AS kind, count(DISTINCT snapshot) AS n, count(DISTINCT snapshot) >= CASE WHEN s.i < 12 THEN 3 ELSE 1 END AS enough FROM range(24) s(i) LEFT JOIN observations ON sensor = s.i GROUP BY s.i")
def sensor_counts_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.range(24).select(F.col("id").cast("int").alias("sensor"), F.when(F.col("id") < 12, "lidar").otherwise("camera").alias("kind"))
    return links.observation_counts(fx.observations(spark, sf_dir), kinds)


_HOPS = f"{_LINKS}, strong AS (SELECT sensor0 AS a, sensor1 AS b FROM links WHERE n >= 26 UNION ALL SELECT sensor1, sensor0 FROM links WHERE n >= 26)"


@query("reachable_sensors", f"WITH RECURSIVE {_HOPS}, hop(sensor, steps) AS (SELECT 0, 0 UNION SELECT b, steps + 1 FROM hop JOIN strong ON a = sensor WHERE steps < 24) SELECT sensor, min(steps) AS steps FROM hop GROUP BY sensor")
def reachable_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.reachable(links.pruned(links.co_observations(fx.observations(spark, sf_dir)), 26))


@query("rig_alignments", f"""WITH {fx.POINTS_SQL}, planes AS (SELECT scan AS rig, point_idx AS snapshot, ring AS sensor, x, y, z FROM points WHERE ring < 3)
SELECT rig, 0 AS sensor0, k AS sensor1, count(*) AS n, 0.0::DOUBLE AS rx, 0.0::DOUBLE AS ry, round(k * {PI} / 6, 5) AS rz, round(1.5::DOUBLE * k, 4) AS tx, round(-0.5::DOUBLE, 4) AS ty, round(2.0::DOUBLE, 4) AS tz
FROM planes, range(1, 3) r(k) WHERE sensor = 0 GROUP BY ALL""")
def rig_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rig for each scan: sensor k sees what sensor 0 sees, from a frame turned by k times 30 degrees about z and shifted."""
    p = fx.points(spark, sf_dir).where("ring IN (0, 1)")
    own = p.groupBy(F.col("scan").alias("rig"), F.col("point_idx").alias("snapshot")).pivot("ring", [0, 1]).agg(F.struct(F.first("x").alias("x"), F.first("y").alias("y"), F.first("z").alias("z")).alias("p"))
    size = F.sqrt(F.col("`1`.x") * F.col("`1`.x") + F.col("`1`.y") * F.col("`1`.y") + F.col("`1`.z") * F.col("`1`.z"))
    first = own.select("rig", "snapshot", *(F.col(f"`0`.{c}").alias("p" + c) for c in "xyz"), *((F.col(f"`1`.{c}") / size).alias("n" + c) for c in "xyz"))
    seen = first.select("rig", "snapshot", F.lit(0).alias("sensor"), *(a + c for a in "pn" for c in "xyz"))
    for k, (c, s) in ((1, (math.sqrt(3) / 2, 0.5)), (2, (0.5, math.sqrt(3) / 2))):
        x, y, z = F.col("px") - 1.5 * k, F.col("py") + 0.5, F.col("pz") - 2
        seen = seen.unionByName(first.select("rig", "snapshot", F.lit(k).alias("sensor"), (c * x + s * y).alias("px"), (c * y - s * x).alias("py"), z.alias("pz"), (c * F.col("nx") + s * F.col("ny")).alias("nx"), (c * F.col("ny") - s * F.col("nx")).alias("ny"), "nz"))
    found = links.alignments(links.pair_sums(seen, ("rig",))).where("sensor0 = 0")
    return found.select("rig", "sensor0", "sensor1", "n", *((F.round(k, 5) + 0.0).alias(k) for k in ("rx", "ry", "rz")), *(F.round(k, 4).alias(k) for k in ("tx", "ty", "tz")))


_YAW = "least(floor((CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * {pi} ELSE atan2(y, x) END) / (2 * {pi} / 36)), 35)::INT".format(pi=PI)


@query("sector_hist", f"WITH {fx.POINTS_SQL} SELECT s.i::INT AS sector, coalesce(n, 0) AS n FROM range(36) s(i) LEFT JOIN (SELECT {_YAW} AS sector, count(*) AS n FROM points GROUP BY 1) c ON c.sector = s.i")
def sector_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sectors.observations_per_sector(fx.points(spark, sf_dir), 36)


@query("board_sectors", f"WITH {fx.POINTS_SQL}, boards AS (SELECT point_idx, avg(x) AS x, avg(y) AS y FROM points GROUP BY point_idx) SELECT s.i::INT AS sector, coalesce(n, 0) AS n FROM range(36) s(i) LEFT JOIN (SELECT {_YAW} AS sector, count(*) AS n FROM boards GROUP BY 1) c ON c.sector = s.i")
def board_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = fx.points(spark, sf_dir).select(F.col("point_idx").alias("snapshot"), F.col("ring").alias("sensor"), *"xyz")
    return sectors.observations_per_sector(sectors.board_centres(seen), 36)


@query("lidar_visibility", f"WITH {fx.POINTS_SQL} SELECT scan, s.i::INT AS sector, coalesce(n, 0) AS n, coalesce(n, 0) >= 5 AS visible FROM (SELECT DISTINCT scan FROM points) CROSS JOIN range(36) s(i) LEFT JOIN (SELECT scan, {_YAW} AS sector, count(*) AS n FROM points WHERE sqrt(x * x + y * y + z * z) >= 1 GROUP BY 1, 2) c USING (scan) WHERE c.sector = s.i UNION ALL SELECT scan, s.i::INT, 0, false FROM (SELECT DISTINCT scan FROM points) CROSS JOIN range(36) s(i) WHERE (scan, s.i) NOT IN (SELECT scan, {_YAW} FROM points WHERE sqrt(x * x + y * y + z * z) >= 1)")
def lidar_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sectors.lidar_visibility(fx.points(spark, sf_dir), "scan", 36, 1.0, 5)


@query("sector_query_points", f"SELECT i::INT AS sector, round(10 * cos((i + 0.5) * (2 * {PI} / 36)), 9) AS x, round(10 * sin((i + 0.5) * (2 * {PI} / 36)), 9) AS y, 0.0::DOUBLE AS z FROM range(36) r(i)")
def sector_query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sectors.query_points(spark, 36, 10.0).select("sector", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "z")


@query("worst_pairs", f"WITH {fx.POINTS_SQL}, s AS (SELECT (scan + ring) % 20 AS sector, scan AS sensor0, ring + 10 AS sensor1, round(stddev_pop(x), 6) AS stdev FROM points GROUP BY ALL) SELECT r.i::INT AS sector, coalesce(max(stdev), 0) AS stdev, arg_max(sensor0, (stdev, -sensor0, -sensor1)) AS sensor0, arg_max(sensor1, (stdev, -sensor0, -sensor1)) AS sensor1 FROM range(24) r(i) LEFT JOIN s ON s.sector = r.i GROUP BY r.i")
def worst_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.points(spark, sf_dir).groupBy("scan", "ring").agg(F.round(F.stddev_pop("x"), 6).alias("stdev"))
    pairs = rows.select(((F.col("scan") + F.col("ring")) % 20).alias("sector"), F.col("scan").alias("sensor0"), (F.col("ring") + 10).alias("sensor1"), "stdev")
    return sectors.worst_pairs(pairs, 24)


@query("visible_pairs", f"WITH {fx.POINTS_SQL}, seen AS (SELECT DISTINCT scan AS sensor, {_YAW} AS sector FROM points) SELECT a.sector, a.sensor AS sensor0, b.sensor AS sensor1 FROM seen a JOIN seen b ON a.sector = b.sector AND a.sensor < b.sensor")
def visible_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = fx.points(spark, sf_dir).select(F.col("scan").alias("sensor"), v.sector(F.col("x"), F.col("y"), 36).alias("sector"), F.lit(True).alias("visible")).distinct()
    return sectors.visible_pairs(seen)


@query("board_grid", "SELECT (i // 9)::INT AS i, (i % 9)::INT AS j, round((i % 9) * 0.1::DOUBLE, 9) AS x, round((i // 9) * 0.1::DOUBLE, 9) AS y, 0.0::DOUBLE AS z FROM range(90) r(i)")
def board_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residuals.board_grid(spark, 10, 9, 0.1).select("i", "j", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "z")


#: Literal poses of two sensors and a board: rotation and translation.
_A, _B, _BOARD = (0.1, -0.2, 0.3, 1.0, 2.0, -0.5), (-0.4, 0.15, 0.05, 0.2, -1.0, 0.4), (0.3, 0.2, -0.1, 2.5, 0.5, 0.2)


def _pose(numbers: tuple[float, ...]) -> tuple[v.Vec, v.Vec]:
    return tuple(F.lit(x) for x in numbers[:3]), tuple(F.lit(x) for x in numbers[3:])


def _matrix_sql(numbers: tuple[float, ...], p: tuple[str, str, str]) -> list[str]:
    m = poses.matrix(list(numbers[:3]))
    return [f"({' + '.join(f'({m[i, j]!r}) * ({p[j]})' for j in range(3))} + ({numbers[3 + i]!r}))".replace("np.float64(", "(") for i in range(3)]


@query("transform_points", f"WITH {fx.POINTS_SQL} SELECT scan, ring, point_idx, {', '.join(f'round({e}, 5) AS {c}' for e, c in zip(_matrix_sql(_A, ('x', 'y', 'z')), 'xyz', strict=True))} FROM points")
def transform_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = poses.transform(*_pose(_A), v.vec())
    return fx.points(spark, sf_dir).select("scan", "ring", "point_idx", *(F.round(x, 5).alias(c) for x, c in zip(p, "xyz", strict=True)))


@query("inverse_transform", f"WITH {fx.POINTS_SQL} SELECT scan, ring, point_idx, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM points")
def inverse_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = poses.transform(*_pose(_B), v.vec())
    back = poses.transform(*poses.inverse(*_pose(_B)), there)
    return fx.points(spark, sf_dir).select("scan", "ring", "point_idx", *(F.round(x, 5).alias(c) for x, c in zip(back, "xyz", strict=True)))


@query("quaternion_roundtrip", f"WITH {fx.POINTS_SQL} SELECT scan, ring, point_idx, round(x / 4, 6) AS rx, round(y / 4, 6) AS ry, round(z / 4, 6) AS rz, round(cos(sqrt(x * x + y * y + z * z) / 8), 6) AS w FROM points")
def quaternion_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = poses.quaternion(v.scale(v.vec(), 0.25))
    r = poses.from_quaternion(*q)
    return fx.points(spark, sf_dir).select("scan", "ring", "point_idx", *(F.round(x, 6).alias("r" + c) for x, c in zip(r, "xyz", strict=True)), F.round(q[3], 6).alias("w"))


def _with_pose(df: DataFrame, prefix: str, numbers: tuple[float, ...]) -> DataFrame:
    return df.withColumns({prefix + k + c: F.lit(numbers[i * 3 + j]) for i, k in enumerate("rt") for j, c in enumerate("xyz")})


_N = [float(x) for x in poses.matrix(list(_BOARD[:3]))[:, 2]]
_D = sum(a * b for a, b in zip(_N, _BOARD[3:], strict=True))


def _along(p: list[str]) -> str:
    return " + ".join(f"({n!r}) * ({e})" for n, e in zip(_N, p, strict=True))


_TURNED = _matrix_sql((*_A[:3], 0.0, 0.0, 0.0), ("x", "y", "z"))
_RESIDUAL = f"""{fx.POINTS_SQL}, errors AS (SELECT scan, ring, point_idx, (({_D!r}) - ({_along(_matrix_sql(_A, ('x', 'y', 'z')))})) / 0.03 AS plane_error,
  sqrt(x * x + y * y + z * z) * (1 - (({_D!r}) - ({sum(n * t for n, t in zip(_N, _A[3:], strict=True))!r})) / nullif({_along(_TURNED)}, 0)) / 0.03 AS range_error FROM points)"""


def _lidar_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residuals.lidar_residuals(_with_pose(_with_pose(fx.points(spark, sf_dir), "l", _A), "b", _BOARD))


@query("lidar_residuals", f"WITH {_RESIDUAL} SELECT scan, ring, point_idx, round(plane_error, 4) AS plane_error FROM errors")
def lidar_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lidar_residuals(spark, sf_dir).select("scan", "ring", "point_idx", F.round("plane_error", 4).alias("plane_error"))


@query("residual_rms", f"WITH {_RESIDUAL} SELECT 'lidar' AS kind, count(*) AS n, round(sqrt(sum(plane_error * plane_error) / count(*)), 5) AS rms FROM errors")
def residual_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lidar_residuals(spark, sf_dir).select(F.lit("lidar").alias("kind"), F.col("plane_error").alias("error"))
    return residuals.rms(rows).withColumn("rms", F.round("rms", 5))


@query("residual_hist", f"WITH {_RESIDUAL} SELECT 'lidar' AS kind, floor(e / 0.1)::INT AS bin, count(*) AS n FROM (SELECT round(plane_error / 50, 6) AS e FROM errors) WHERE abs(e) <= 3 GROUP BY ALL")
def residual_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lidar_residuals(spark, sf_dir).select(F.lit("lidar").alias("kind"), F.round(F.col("plane_error") / 50, 6).alias("error"))
    return residuals.histogram(rows)


@query("insane_residuals", f"WITH {_RESIDUAL} SELECT scan, ring, point_idx FROM errors WHERE abs(range_error) > 100 / 0.03")
def insane_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lidar_residuals(spark, sf_dir).select("scan", "ring", "point_idx", F.lit("lidar").alias("kind"), F.col("range_error").alias("error"))
    return residuals.insane(rows).select("scan", "ring", "point_idx")


@query("sphere_grid", f"SELECT (k // 20)::INT AS i, (k % 20)::INT AS j, round(cos((k % 20 + 0.5) * ({PI} / 20) - {PI} / 2) * cos((k // 20) * (2 * {PI} / 40)), 9) + 0 AS x, round(cos((k % 20 + 0.5) * ({PI} / 20) - {PI} / 2) * sin((k // 20) * (2 * {PI} / 40)), 9) + 0 AS y, round(sin((k % 20 + 0.5) * ({PI} / 20) - {PI} / 2), 9) + 0 AS z FROM range(800) r(k)")
def sphere_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sphere_grid(spark).select("i", "j", *((F.round(c, 9) + 0.0).alias(c) for c in "xyz"))


@query("mesh_grid", "SELECT (k // 21)::INT AS i, (k % 21)::INT AS j, round((k % 21) * (2 * 5.0::DOUBLE / 20) - 5, 9) AS x, round((k // 21) * (2 * 5.0::DOUBLE / 20) - 5, 9) AS y FROM range(441) r(k)")
def mesh_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.mesh_grid(spark, 21, 5.0).select("i", "j", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


#: A rig: (sensor, kind, pose).
_RIG = [(k, "lidar" if k < 7 else "camera", *(0.1 * k * p for p in _A[:3]), *(p + k for p in _A[3:])) for k in range(10)]
_RIG_COLUMNS = "sensor int, kind string, rx double, ry double, rz double, tx double, ty double, tz double"


def _ahead(row: tuple) -> tuple:
    d = poses.matrix(list(row[2:5]))[:, 0 if row[1] == "lidar" else 2]
    size = math.hypot(d[0], d[1])
    return row[0], row[1], row[5], row[6], *((float(d[0] / size), float(d[1] / size)) if size > 1e-12 else (0.0, 0.0))


@query("forward_vectors", "SELECT sensor, kind, x::DOUBLE AS x, y::DOUBLE AS y, round(dx::DOUBLE, 6) AS dx, round(dy::DOUBLE, 6) AS dy FROM (VALUES " + ", ".join(map(str, map(_ahead, _RIG))) + ") t(sensor, kind, x, y, dx, dy)")
def forward_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.forward_vectors(spark.createDataFrame(_RIG, _RIG_COLUMNS)).select("sensor", "kind", "x", "y", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


@query("common_frame_cloud", f"WITH {fx.POINTS_SQL}, near AS (SELECT * FROM points WHERE sqrt(x * x + y * y + z * z) < 2) " + " UNION ALL ".join(f"SELECT scan AS sensor, ring, point_idx, {', '.join(f'round({e}, 5) AS {c}' for e, c in zip(_matrix_sql(row[2:], ('x', 'y', 'z')), 'xyz', strict=True))} FROM near WHERE scan = {row[0]}" for row in _RIG))
def common_frame_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fx.points(spark, sf_dir).select(F.col("scan").alias("sensor"), "ring", "point_idx", *"xyz")
    moved = views.in_common_frame(points, spark.createDataFrame(_RIG, _RIG_COLUMNS).drop("kind"), 2.0)
    return moved.select("sensor", "ring", "point_idx", *(F.round(c, 5).alias(c) for c in "xyz"))


@query("frame_axes", "SELECT sensor, axis, round(x::DOUBLE, 6) AS x, round(dx::DOUBLE, 6) + 0 AS dx, round(dy::DOUBLE, 6) + 0 AS dy, round(dz::DOUBLE, 6) + 0 AS dz FROM (VALUES " + ", ".join(str((row[0], axis, row[5], *map(float, poses.matrix(list(row[2:5]))[:, k]))) for row in _RIG for k, axis in enumerate("xyz")) + ") t(sensor, axis, x, dx, dy, dz)")
def frame_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.axes(spark.createDataFrame(_RIG, _RIG_COLUMNS))
    return rows.select("sensor", "axis", F.round("x", 6).alias("x"), *((F.round("d" + c, 6) + 0.0).alias("d" + c) for c in "xyz"))


def _seen_edges() -> str:
    """Sectors of a level camera that looks along x with a 90 degree view, by the yaw of both edges."""
    return f"SELECT 0 AS camera, i::INT AS sector, bool_and(abs(atan2(sin(e), cos(e))) <= {PI} / 4 + 1e-9) AS visible FROM (SELECT i, unnest([i, i + 1]) * (2 * {PI} / 36) AS e FROM range(36) r(i)) GROUP BY i"


@query("camera_visibility", _seen_edges())
def camera_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    look = [float(x) for x in poses.rodrigues(np.array([[0, 0, 1.0], [-1, 0, 0], [0, -1, 0]]))]
    camera = spark.createDataFrame([(0, *look, 0.0, 0.0, 0.0, 500.0, 500.0, 500.0, 500.0, 1001, 1001)], "camera int, rx double, ry double, rz double, tx double, ty double, tz double, fx double, fy double, cx double, cy double, width int, height int")
    return sectors.camera_visibility(camera, 36, 10.0)
