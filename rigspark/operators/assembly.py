"""From message logs to calibration: snapshots, checks, boards in them, and one schema for all observations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import poses
from ..functions import vectors as v
from ..storage import Scratch
from . import background, calibration, segmentation, snapshots
from .cameras import Intrinsics
from .parameters import SegmentationParameters

#: Sizes of a step of one in the solver's units: rotations of sensors and boards in degrees, places in metres.
SENSOR_DEGREES, BOARD_DEGREES, METRES = 0.1, 15.0, 1.0
#: Rings of one sensor have numbers from this times the sensor's.
RINGS_APART = 4096


def topic_problems(kinds: DataFrame, models: DataFrame) -> DataFrame:
    """``(problem, topic)``: cameras without a model, models without a camera, and a log without lidars; ``kinds(topic, kind)``, ``models(topic)``."""
    cameras = kinds.where("kind = 'camera'").select("topic")
    lacking = cameras.join(models, "topic", "left_anti").select(F.lit("camera without model").alias("problem"), "topic")
    unused = models.select("topic").join(cameras, "topic", "left_anti").select(F.lit("model without camera").alias("problem"), "topic")
    blind = kinds.agg(F.count(F.when(F.col("kind") == "lidar", 1)).alias("n")).where("n = 0").select(F.lit("no lidar").alias("problem"), F.lit(None).cast("string").alias("topic"))
    return lacking.unionAll(unused).unionAll(blind)


def without_snapshots(rows: DataFrame, exclude: DataFrame) -> DataFrame:
    """Rows whose ``snapshot`` is not listed."""
    return rows.join(exclude.select("snapshot").distinct(), "snapshot", "left_anti")


def any_lidar(observations: DataFrame, kinds: DataFrame) -> DataFrame:
    """``(snapshot, any_lidar)`` of ``observations(snapshot, sensor)`` and ``kinds(sensor, kind)``."""
    return observations.join(kinds, "sensor").groupBy("snapshot").agg(F.bool_or(F.col("kind") == "lidar").alias("any_lidar"))


def first_messages_of(log: DataFrame, topic: str, n: int) -> DataFrame:
    """The first ``n`` messages of a topic in time; the order is a top-n of each partition first."""
    return log.where(F.col("topic") == topic).orderBy("time_us", "msg_id").limit(n)


def gathered(points: DataFrame, chosen: DataFrame) -> DataFrame:
    """The points that ``chosen(scan, plane, points array<long>)`` lists by ``point_idx``, with their place in the list."""
    places = chosen.select("scan", "plane", F.posexplode("points").alias("place", "point_idx"))
    return places.join(points, ["scan", "point_idx"])


def seen_corners(grid: DataFrame, boards: DataFrame, cameras: DataFrame, seen: DataFrame) -> DataFrame:
    """Every corner of ``grid(i, j, x, y, z)`` for each ``seen(snapshot, camera)``, with the poses and lens that ``residuals.camera_residuals`` needs.

    ``boards(snapshot, br?, bt?)`` and ``cameras(camera, cr?, ct?, fx, fy, cx, cy)``; a grid has a fixed number of corners.
    """
    return seen.join(boards, "snapshot").join(cameras, "camera").crossJoin(F.broadcast(grid))


def one_schema(lidar_points: DataFrame | None = None, board_points: DataFrame | None = None, corners: DataFrame | None = None, board_poses: DataFrame | None = None) -> DataFrame:
    """Observations of four kinds as ``(snapshot, sensor, source, x, y, z, u, v)``.

    Whole scans, points already on boards, corners (board place and pixel), and
    boards' poses ``(snapshot, sensor, tx, ty, tz)``, of which the place counts.
    """
    made = []
    for name, rows in (("scan", lidar_points), ("board", board_points), ("corner", corners), ("pose", board_poses)):
        if rows is None:
            continue
        if name == "pose":
            rows = rows.select("snapshot", "sensor", *(F.col("t" + c).alias(c) for c in "xyz"))
        uv = [F.col(c).cast("double").alias(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in "uv"]
        made.append(rows.select("snapshot", "sensor", F.lit(name).alias("source"), *(F.col(c).cast("double").alias(c) for c in "xyz"), *uv))
    if not made:
        raise ValueError("no observations")
    out = made[0]
    for more in made[1:]:
        out = out.unionAll(more)
    return out


def state_index(sensors: int, boards: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """``(kind, number, first)``: where the six unknowns of each sensor but the first and of each board's ``snapshot`` begin.

    Boards are numbered within buckets of snapshots, whose offsets are sums of
    one row a bucket.
    """
    base = 6 * (sensors - 1)
    own = boards.select("snapshot").distinct().withColumn("bucket", F.floor(F.col("snapshot") / bucket))
    before = own.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))  # one row for each bucket
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("snapshot")) - 1
    numbered = own.withColumn("rank", rank).join(before, "bucket").select(F.lit("board").alias("kind"), F.col("snapshot").cast("long").alias("number"), (base + 6 * (F.col("before") + F.col("rank"))).cast("long").alias("first"))
    fixed = boards.sparkSession.range(1, sensors).select(F.lit("sensor").alias("kind"), F.col("id").alias("number"), (6 * (F.col("id") - 1)).alias("first"))
    return fixed.unionAll(numbered)


def scaled(kind: str, names: tuple[str, ...] = ("rx", "ry", "rz", "tx", "ty", "tz"), *, back: bool = False) -> list[Column]:
    """A pose's numbers in the solver's units, or ``back`` from them."""
    turn = math.radians(SENSOR_DEGREES if kind == "sensor" else BOARD_DEGREES)
    sizes = [turn] * 3 + [METRES] * 3
    return [(F.col(c) * k if back else F.col(c) / k).alias(c) for c, k in zip(names, sizes, strict=True)]


def places_in_vehicle(sensor_poses: DataFrame, vehicle: tuple[float, ...]) -> DataFrame:
    """``(sensor, x, y, z)`` in the vehicle's frame, to which the pose ``vehicle`` takes the reference frame."""
    r, t = tuple(map(F.lit, vehicle[:3])), tuple(map(F.lit, vehicle[3:]))
    return sensor_poses.select("sensor", *(c.alias(n) for c, n in zip(poses.transform(r, t, v.vec("t")), "xyz", strict=True)))


def fixture_lines(planes: DataFrame) -> DataFrame:
    """``(scan, line)``: each plane as text that a test table can hold."""
    three = lambda p: F.concat(F.lit("("), F.concat_ws(", ", *(F.format_string("%.3f", F.col(p + c)) for c in "xyz")), F.lit(")"))
    return planes.select("scan", F.concat(F.lit("plane_p = "), three("p"), F.lit(", plane_n = "), three("n")).alias("line"))


def assembled(log: DataFrame, period_us: int, start_us: int, *, periods: DataFrame | None = None, spread_us: int | None = None, at_least: int = 2) -> DataFrame:
    """``(snapshot, topic, time_us, msg_id)``: the first message of each topic in each span of time, of the snapshots that are usable."""
    if periods is not None:
        log = snapshots.without_periods(log, periods)
    rows = snapshots.decimated(log, period_us, start_us)
    if spread_us is not None:
        rows = snapshots.tight(rows, spread_us)
    rows = rows.join(snapshots.usable(rows, at_least).select("segment"), "segment", "left_semi")
    return rows.select(F.col("segment").alias("snapshot"), "topic", "time_us", "msg_id")


def moving_points(points: DataFrame, static_least: int) -> DataFrame:
    """``points(snapshot, sensor, scan, ring, ...)`` without what stands in the same cell of a sensor in most snapshots."""
    keyed = points.withColumn("ring", F.col("sensor") * RINGS_APART + F.col("ring"))
    modes = background.robust_mode(background.range_image(keyed, "snapshot"), ["ring", "column"], "r", static_least)
    return background.without_static(keyed, modes).withColumn("ring", F.col("ring") - F.col("sensor") * RINGS_APART)


def boards_seen(messages: DataFrame, points: DataFrame, sensors: DataFrame, par: SegmentationParameters, *, static_least: int = 0) -> DataFrame:
    """``(snapshot, sensor, x, y, z)``: the points of the one board in each message; messages with none or several give none.

    ``messages`` is of ``assembled``; ``points(msg_id, ring, point_idx, x, y,
    z)``; ``sensors(topic, sensor)``.  ``static_least`` snapshots make a cell's
    mode, 0 keeps the static scene.
    """
    own = messages.join(sensors.select("topic", "sensor"), "topic").select("snapshot", "sensor", F.col("msg_id").alias("scan"))
    cloud = points.withColumnRenamed("msg_id", "scan").join(own, "scan")
    if static_least:
        cloud = moving_points(cloud, static_least)
    cloud = cloud.select("snapshot", "sensor", F.col("scan").cast("long").alias("scan"), "ring", "point_idx", *"xyz")
    with Scratch(points.sparkSession) as scratch:
        cloud = scratch.stored(cloud, "cloud")  # what the boards are found in, and taken from
    planes = segmentation.observed_boards(segmentation.segment_planes(cloud.drop("snapshot", "sensor"), par))
    return gathered(cloud, planes.select("scan", "plane", "points")).select("snapshot", "sensor", *"xyz")


def check_arguments(sensors: DataFrame, lenses: Intrinsics | None, seed: np.ndarray | None) -> int:
    """The number of sensors, or an error that names what does not fit; ``sensors(topic, sensor, kind)``."""
    rows = sensors.select("topic", "sensor", "kind").collect()  # one row for each sensor of the rig
    kinds = {r["sensor"]: r["kind"] for r in rows}
    if sorted(kinds) != list(range(len(rows))):
        raise ValueError(f"sensors must be numbered from 0, found {sorted(kinds)}")
    if "lidar" not in kinds.values() or kinds[0] != "lidar":
        raise ValueError("sensor 0 must be a lidar")
    cameras = {k for k, kind in kinds.items() if kind == "camera"}
    if cameras != set(lenses or {}):
        raise ValueError(f"cameras {sorted(cameras)} and lenses {sorted(lenses or {})} differ")
    if len(rows) < 2:
        raise ValueError("two sensors at least are needed")
    if seed is not None and np.shape(seed) != (len(rows), 6):
        raise ValueError(f"seed must be {len(rows)} poses of 6 numbers, not {np.shape(seed)}")
    return len(rows)


def assembled_by_bag(log: DataFrame, *, periods: DataFrame | None = None, spread_us: int | None = None, at_least: int = 2) -> DataFrame:
    """As ``assembled``, where each bag of ``log(bag, topic, time_us, msg_id, value)`` is a snapshot; a snapshot's number is a hash of its bag's name."""
    if periods is not None:
        log = snapshots.without_periods(log, periods)
    rows = snapshots.first_messages(log, ["bag", "topic"]).withColumn("segment", F.xxhash64("bag"))
    if spread_us is not None:
        rows = snapshots.tight(rows, spread_us)
    rows = rows.join(snapshots.usable(rows, at_least).select("segment"), "segment", "left_semi")
    return rows.select(F.col("segment").alias("snapshot"), "topic", "time_us", "msg_id")


def observed(log: DataFrame, points: DataFrame, sensors: DataFrame, par: SegmentationParameters, *, period_us: int | None = None, start_us: int = 0, corners: DataFrame | None = None, periods: DataFrame | None = None, spread_us: int | None = None, static_least: int = 0) -> DataFrame:
    """What the sensors see of boards, ``(snapshot, sensor, x, y, z[, u, v])``.

    Without ``period_us`` each bag of the log is a snapshot.  Cameras among
    ``sensors`` need ``corners(msg_id, x, y, z, u, v)``.
    """
    if corners is None and not sensors.where("kind = 'camera'").isEmpty():
        raise ValueError("cameras need a table of corners")
    log = log.join(sensors.select("topic"), "topic", "left_semi")
    if period_us is None:
        messages = assembled_by_bag(log, periods=periods, spread_us=spread_us)
    else:
        messages = assembled(log, period_us, start_us, periods=periods, spread_us=spread_us)
    seen = boards_seen(messages, points, sensors.where("kind = 'lidar'"), par, static_least=static_least)
    with Scratch(log.sparkSession) as scratch:
        seen = scratch.stored(seen, "observed")  # the solve reads it several times
    if corners is None:
        return seen
    own = messages.join(sensors.select("topic", "sensor"), "topic").select("snapshot", "sensor", "msg_id")
    return one_schema(board_points=seen, corners=corners.join(own, "msg_id").select("snapshot", "sensor", *"xyzuv")).drop("source")


def calibrate_log(log: DataFrame, points: DataFrame, sensors: DataFrame, period_us: int | None, start_us: int, par: SegmentationParameters, *, lenses: Intrinsics | None = None, seed: np.ndarray | None = None, exclude: DataFrame | None = None, **selection) -> calibration.Solution:
    """Poses of the sensors from a log of messages.

    ``log(topic, time_us, msg_id, value)``, ``points`` of the lidars' messages;
    ``selection`` is that of ``observed``.  A sensor of ``sensors`` with too
    few boards is an error that names its topic.
    """
    number = check_arguments(sensors, lenses, seed)
    seen = observed(log, points, sensors, par, period_us=period_us, start_us=start_us, **selection)
    return calibration.calibrate(seen, lenses, seed=seed, exclude=exclude, sensors=number, names=topic_names(sensors))


def topic_names(sensors: DataFrame) -> dict[int, str]:
    return {r["sensor"]: r["topic"] for r in sensors.select("sensor", "topic").collect()}  # one row for each sensor of the rig


def diagnostics(points: DataFrame, par: SegmentationParameters, per_rotation: int) -> DataFrame:
    """``(scan, tag, ring, x, y, z, dx, dy, dz)``: what each step of the segmentation made of the scans."""
    from . import scans

    none = [F.lit(None).cast("double").alias("d" + c) for c in "xyz"]
    pieces = scans.stage1_segments(points, per_rotation, par)
    seeds = scans.adjacent_pairs(pieces, par)
    planes = segmentation.segment_planes(points, par)
    place = lambda rows, tag, p, d: rows.select(F.col("scan").cast("long").alias("scan"), F.lit(tag).alias("tag"), (F.col("ring") if "ring" in rows.columns else F.lit(None)).cast("int").alias("ring"), *(F.col(p + c).alias(c) for c in "xyz"), *([F.col(d + c).alias("d" + c) for c in "xyz"] if d else none))
    return place(points, "point", "", None).unionAll(place(pieces, "segment", "p", "v")).unionAll(place(seeds, "seed", "c", "n")).unionAll(place(planes, "plane", "p", "n"))
