"""Queries on checks of a rig, observations and solver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly, residuals
from ..sources import fixtures as fx
from .catalogue import query
from .log_queries import _DECIMATED, SEGMENT, T0

_KINDS = "kinds(topic, kind) AS (VALUES ('view', 'lidar'), ('click', 'lidar'), ('signup', 'camera'), ('purchase', 'camera'))"
_MODELS = "models(topic) AS (VALUES ('signup'), ('error'))"


@query("topic_problems", f"WITH {_KINDS}, {_MODELS} SELECT 'camera without model' AS problem, topic FROM kinds WHERE kind = 'camera' AND topic NOT IN (SELECT topic FROM models) UNION ALL SELECT 'model without camera', topic FROM models WHERE topic NOT IN (SELECT topic FROM kinds WHERE kind = 'camera') UNION ALL SELECT 'no lidar', NULL WHERE NOT EXISTS (SELECT 1 FROM kinds WHERE kind = 'lidar')")
def topic_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([("view", "lidar"), ("click", "lidar"), ("signup", "camera"), ("purchase", "camera")], "topic string, kind string")
    return assembly.topic_problems(kinds, spark.createDataFrame([("signup",), ("error",)], "topic string"))


@query("snapshots_excluded", f"WITH {fx.OBSERVATIONS_SQL} SELECT snapshot, sensor FROM observations WHERE snapshot NOT IN (3, 5, 36)")
def snapshots_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.without_snapshots(fx.observations(spark, sf_dir), spark.createDataFrame([(3,), (5,), (5,), (36,)], "snapshot long"))


@query("any_lidar", f"WITH {fx.OBSERVATIONS_SQL} SELECT snapshot, bool_or(sensor < 2) AS any_lidar FROM observations WHERE (snapshot + sensor) % 5 > 1 GROUP BY snapshot")
def any_lidar(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.range(fx.RINGS).select(F.col("id").cast("int").alias("sensor"), F.when(F.col("id") < 2, "lidar").otherwise("camera").alias("kind"))
    return assembly.any_lidar(fx.observations(spark, sf_dir).where("(snapshot + sensor) % 5 > 1"), kinds)


@query("first_images", f"WITH {fx.MESSAGES_SQL} SELECT topic, time_us, msg_id FROM messages WHERE topic = 'view' ORDER BY time_us, msg_id LIMIT 12")
def first_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.first_messages_of(fx.messages(spark, sf_dir), "view", 12).select("topic", "time_us", "msg_id")


@query("gathered_points", f"WITH {fx.POINTS_SQL}, chosen AS (SELECT scan, ring AS plane, list(point_idx ORDER BY point_idx) AS ids FROM points WHERE z > 2 GROUP BY ALL), places AS (SELECT scan, plane, unnest(range(len(ids)))::INT AS place, unnest(ids) AS point_idx FROM chosen) SELECT p.scan, p.plane, p.place, p.point_idx, q.x FROM places p JOIN points q ON p.scan = q.scan AND p.plane = q.ring AND p.point_idx = q.point_idx")
def gathered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fx.points(spark, sf_dir)
    chosen = points.where("z > 2").groupBy("scan", F.col("ring").alias("plane")).agg(F.array_sort(F.collect_list("point_idx")).alias("points"))
    return assembly.gathered(points, chosen).where("ring = plane").select("scan", "plane", "place", "point_idx", "x")


_C = (800.0, 810.0, 640.0, 480.0)


@query("camera_residuals", f"""WITH {fx.OBSERVATIONS_SQL}, seen AS (SELECT snapshot, sensor, 2 + sensor * 0.25::DOUBLE AS depth, snapshot * 0.01::DOUBLE AS side FROM observations)
SELECT snapshot, sensor, k // 4 AS i, k % 4 AS j, round((((k % 4) * 0.1::DOUBLE + side) / depth * {_C[0]} + {_C[2]} - (600 + 10 * (k % 4))) / 0.15, 4) AS eu, round((((k // 4) * 0.1::DOUBLE) / depth * {_C[1]} + {_C[3]} - (450 + 10 * (k // 4))) / 0.15, 4) AS ev
FROM seen, range(12) g(k)""")
def camera_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards parallel to cameras that look along z: a corner's pixel follows from its place over the depth."""
    seen = fx.observations(spark, sf_dir).select("snapshot", F.col("sensor").alias("camera"))
    zero = [F.lit(0.0).alias(c) for c in ("brx", "bry", "brz", "bty", "btz")]
    boards = spark.range(fx.SNAPSHOTS).select(F.col("id").alias("snapshot"), *zero, (F.col("id") * 0.01).alias("btx"))
    cameras = spark.range(fx.RINGS).select(F.col("id").cast("int").alias("camera"), *(F.lit(0.0).alias("cr" + c) for c in "xyz"), F.lit(0.0).alias("ctx"), F.lit(0.0).alias("cty"), (-(2 + F.col("id") * 0.25)).alias("ctz"), *(F.lit(x).alias(n) for n, x in zip(("fx", "fy", "cx", "cy"), _C, strict=True)))
    rows = assembly.seen_corners(residuals.board_grid(spark, 3, 4, 0.1), boards, cameras, seen)
    rows = rows.withColumns({"u": 600.0 + 10 * F.col("j"), "v": 450.0 + 10 * F.col("i")})
    found = residuals.camera_residuals(rows)
    return found.select("snapshot", F.col("camera").alias("sensor"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("eu", 4).alias("eu"), F.round("ev", 4).alias("ev"))


@query("board_regularisation", f"WITH {fx.POINTS_SQL} SELECT point_idx AS snapshot, k::INT AS k, CASE k WHEN 0 THEN x / 100 WHEN 1 THEN y / 100 WHEN 2 THEN z / 100 WHEN 3 THEN y / 10000 WHEN 4 THEN z / 10000 ELSE x / 10000 END AS error FROM points, range(6) r(k) WHERE ring = 0")
def board_regularisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = fx.points(spark, sf_dir).where("ring = 0").select(F.col("point_idx").alias("snapshot"), F.col("x").alias("brx"), F.col("y").alias("bry"), F.col("z").alias("brz"), F.col("y").alias("btx"), F.col("z").alias("bty"), F.col("x").alias("btz"))
    return residuals.regularisation(boards)


@query("observations_one_schema", f"WITH {fx.POINTS_SQL} SELECT point_idx AS snapshot, ring AS sensor, 'scan' AS source, x, y, z, NULL::DOUBLE AS u, NULL::DOUBLE AS v FROM points WHERE ring < 3 UNION ALL SELECT point_idx, ring, 'board', x, y, z, NULL, NULL FROM points WHERE ring = 3 UNION ALL SELECT point_idx, ring, 'corner', x, y, z, x * 2, y * 2 FROM points WHERE ring = 4 UNION ALL SELECT point_idx, ring, 'pose', z, y, x, NULL, NULL FROM points WHERE ring = 5")
def observations_one_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.points(spark, sf_dir).select(F.col("point_idx").alias("snapshot"), F.col("ring").alias("sensor"), *"xyz")
    corners = rows.where("sensor = 4").withColumns({"u": F.col("x") * 2, "v": F.col("y") * 2})
    boards = rows.where("sensor = 5").select("snapshot", "sensor", F.col("z").alias("tx"), F.col("y").alias("ty"), F.col("x").alias("tz"))
    return assembly.one_schema(rows.where("sensor < 3"), rows.where("sensor = 3"), corners, boards)


@query("state_index", f"WITH {fx.POINTS_SQL} SELECT 'board' AS kind, point_idx AS number, 24 + 6 * (row_number() OVER (ORDER BY point_idx) - 1) AS first FROM (SELECT DISTINCT point_idx FROM points WHERE z > 2) UNION ALL SELECT 'sensor', i, 6 * (i - 1) FROM range(1, 5) r(i)")
def state_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.state_index(5, fx.points(spark, sf_dir).where("z > 2").select(F.col("point_idx").alias("snapshot")), bucket=64)


@query("scaled_poses", f"WITH {fx.POINTS_SQL} SELECT scan, ring, point_idx, round(x / (0.1 * pi() / 180), 5) AS rx, round(y / (0.1 * pi() / 180), 5) AS ry, round(z / (0.1 * pi() / 180), 5) AS rz, round(y, 6) AS tx, round(z, 6) AS ty, round(x, 6) AS tz FROM points")
def scaled_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.points(spark, sf_dir).select("scan", "ring", "point_idx", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("z").alias("rz"), F.col("y").alias("tx"), F.col("z").alias("ty"), F.col("x").alias("tz"))
    packed = rows.select("scan", "ring", "point_idx", *assembly.scaled("sensor"))
    return packed.select("scan", "ring", "point_idx", *(F.round(c, 5).alias(c) for c in ("rx", "ry", "rz")), *(F.round(c, 6).alias(c) for c in ("tx", "ty", "tz")))


@query("places_in_vehicle", f"WITH {fx.POINTS_SQL} SELECT point_idx AS sensor, round(1.5 - y, 6) AS x, round(x - 0.5, 6) AS y, round(z + 2, 6) AS z FROM points WHERE ring = 0")
def places_in_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter turn about z, then a shift."""
    rows = fx.points(spark, sf_dir).where("ring = 0").select(F.col("point_idx").alias("sensor"), *(F.col(c).alias("t" + c) for c in "xyz"))
    return assembly.places_in_vehicle(rows, (0.0, 0.0, 1.5707963267948966, 1.5, -0.5, 2.0)).select("sensor", *(F.round(c, 6).alias(c) for c in "xyz"))


@query("fixture_lines", f"WITH {fx.POINTS_SQL} SELECT scan, printf('plane_p = (%.3f, %.3f, %.3f), plane_n = (%.3f, %.3f, %.3f)', x, y, z, z, x, y) AS line FROM points WHERE ring = 0")
def fixture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.points(spark, sf_dir).where("ring = 0").select("scan", *(F.col(c).alias("p" + c) for c in "xyz"), F.col("z").alias("nx"), F.col("x").alias("ny"), F.col("y").alias("nz"))
    return assembly.fixture_lines(rows)


@query("assembled_snapshots", f"WITH {_DECIMATED}, narrow AS (SELECT * FROM decimated SEMI JOIN (SELECT segment FROM decimated GROUP BY segment HAVING max(time_us) - min(time_us) <= {SEGMENT // 2}) USING (segment)) SELECT segment AS snapshot, topic, time_us, msg_id FROM narrow SEMI JOIN (SELECT segment FROM narrow GROUP BY segment HAVING count(DISTINCT topic) >= 2) USING (segment)")
def assembled_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.assembled(fx.messages(spark, sf_dir), SEGMENT, T0, spread_us=SEGMENT // 2)
