"""Poses of rigidly mounted lidars and cameras from boards that several of them see.

``points(snapshot, sensor, x, y, z)`` are board points in lidar frames; for
cameras, which come after the lidars, they are corners in the board's frame
with the pixels ``u, v`` where they are seen.  Sensor 0, a lidar, is the
reference.  Seeds and the rejection of what does not fit them are expressions
over tables keyed by snapshot; the solve is that of ``adjustment``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lenses as lens_functions
from ..functions import poses
from ..functions import vectors as v
from ..storage import Scratch
from . import adjustment, links, scans, sectors
from .cameras import Intrinsics, boards_in_cameras
from .residuals import SIGMA_M, SIGMA_PX


@dataclass
class Solution:
    """Poses of sensors (rows; sensor 0 is zero), boards ``(snapshot, board array<double>)``, and the sensors' covariance without sensor 0."""

    sensors: np.ndarray
    boards: DataFrame
    covariance: np.ndarray
    rms: float
    iterations: int


def board_planes(points: DataFrame) -> DataFrame:
    """``(snapshot, sensor, px..pz, nx..nz)``: the plane of each sensor's points on each board."""
    sums = scans.scatter(points, ["snapshot", "sensor"]).where("n >= 3")
    return scans.fitted_planes(sums).select("snapshot", "sensor", *(F.col("m" + c).alias("p" + c) for c in "xyz"), *("n" + c for c in "xyz"))


def seed_sensors(pairs: list, sensors: int, least: int = links.LEAST_SHARED) -> np.ndarray:
    """Poses along the paths of fewest links from sensor 0, of these the best shared; all must be reached.

    ``pairs`` are the rows of ``links.alignments``.
    """
    edges: dict[int, list] = {k: [] for k in range(sensors)}
    for row in pairs:
        if row["n"] >= least:
            pose = np.array([row[k + c] for k in "rt" for c in "xyz"])
            edges[row["sensor0"]].append((row["sensor1"], row["n"], pose))
            edges[row["sensor1"]].append((row["sensor0"], row["n"], poses.inverted(pose)))
    found, todo = {}, [(0, 0, 0, np.zeros(6))]
    count = 0
    while todo:
        cost, _, k, pose = heapq.heappop(todo)
        if k in found:
            continue
        found[k] = pose
        for other, n, step in edges[k]:
            count += 1
            heapq.heappush(todo, (cost + 1_000_000 - n, count, other, poses.compose(pose, step)))
    missing = sorted(set(range(sensors)) - found.keys())
    if missing:
        raise ValueError(f"no chain of shared boards from sensor 0 to {missing}")
    return np.array([found[k] for k in range(sensors)])


def _posed(rows: DataFrame, sensors: np.ndarray) -> DataFrame:
    """``rows`` with their sensor's pose, as a matrix ``sm??``, a quaternion ``sq?`` and a shift ``st?``; a rig's poses are a few rows."""
    found = []
    for k, pose in enumerate(sensors):
        angle = float(np.linalg.norm(pose[:3]))
        around = np.asarray(pose[:3]) * (np.sin(angle / 2) / angle if angle > poses.SMALL else 0.5)
        found.append((k, *map(float, poses.matrix(pose[:3]).ravel()), *map(float, around), float(np.cos(angle / 2)), *map(float, pose[3:])))
    names = [f"sm{i}{j}" for i in range(3) for j in range(3)] + ["sq" + c for c in "xyzw"] + ["st" + c for c in "xyz"]
    table = rows.sparkSession.createDataFrame(found, "sensor int, " + ", ".join(f"{n} double" for n in names))
    return rows.join(F.broadcast(table), "sensor")


def _turned(p: v.Vec, matrix: str = "sm") -> v.Vec:
    return tuple(v.dot(tuple(F.col(f"{matrix}{i}{j}") for j in range(3)), p) for i in range(3))


def _moved(p: v.Vec) -> v.Vec:
    """From the sensor's frame to the reference's."""
    return v.add(_turned(p), v.vec("st"))


def _seen(p: v.Vec) -> v.Vec:
    """From the reference frame to the sensor's."""
    apart = v.sub(p, v.vec("st"))
    return tuple(v.dot(tuple(F.col(f"sm{j}{i}") for j in range(3)), apart) for i in range(3))


def _boards(r: v.Vec, t: v.Vec, centre: v.Vec) -> list:
    """Columns of a board: its pose, and its centre in the reference frame."""
    return [F.array(*r, *t).alias("board"), F.array(*centre).alias("centre")]


def seed_boards(planes: DataFrame, sensors: np.ndarray) -> DataFrame:
    """``(snapshot, board, centre)`` from the first sensor that sees each board, without turn about the normal."""
    first = planes.groupBy("snapshot").agg(*(F.min_by(c, "sensor").alias(c) for c in ("px", "py", "pz", "nx", "ny", "nz")), F.min("sensor").alias("sensor"))
    at = _moved(v.vec("p"))
    # each step is a column, so that the next one does not repeat it
    rows = _posed(first, sensors).select("snapshot", *(c.alias("w" + k) for k, c in zip("xyz", _turned(v.vec("n")), strict=True)), *(c.alias("at" + k) for k, c in zip("xyz", at, strict=True)))
    return rows.select("snapshot", *_boards(poses.rotation_to(v.vec("w")), v.vec("at"), v.vec("at")))


def boards_by_camera(seen: DataFrame, sensors: np.ndarray) -> DataFrame:
    """``(snapshot, board, centre)`` from the first camera that sees each board; ``seen`` is of ``boards_in_cameras``."""
    first = seen.groupBy("snapshot").agg(*(F.min_by(k + c, "sensor").alias(k + c) for k in "rtp" for c in "xyz"), F.min("sensor").alias("sensor"))
    # each step is a column, so that the next one does not repeat it
    rows = _posed(first, sensors).withColumn("q1", F.array(*poses.quaternion(v.vec("r"))))
    four = lambda name: tuple(F.get(name, F.lit(k)) for k in range(4))
    rows = rows.withColumn("q", F.array(*poses.quaternion_product(v.vec("sq", "xyzw"), four("q1"))))
    return rows.select("snapshot", *_boards(poses.from_quaternion(*four("q")), _moved(v.vec("t")), _moved(v.vec("p"))))


def _board() -> tuple[v.Vec, v.Vec, v.Vec]:
    at = lambda name, k: tuple(F.get(name, F.lit(k + i)) for i in range(3))
    return at("board", 0), at("board", 3), at("centre", 0)


def seed_outliers(planes: DataFrame, sensors: np.ndarray, boards: DataFrame, most: float = 0.5, cos_least: float = 0.984807753012208) -> DataFrame:
    """``(snapshot)`` in which some sensor's board has its centre further from the board's than ``most``, or its normal at a wider angle."""
    r, _, centre = _board()
    n, normal = _turned(v.vec("n")), poses.rotate(r, (F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    off = v.sub(_moved(v.vec("p")), centre)
    away = (v.dot(off, off) > most * most) | (F.abs(v.dot(n, normal)) < cos_least)
    return _posed(planes.join(boards, "snapshot"), sensors).where(away).select("snapshot").distinct()


def corner_outliers(corners: DataFrame, sensors: np.ndarray, boards: DataFrame, lenses: Intrinsics, most_px: float = 50.0) -> DataFrame:
    """``(snapshot)`` in which some corner is seen further than ``most_px`` from where the seed puts it, or lies behind its camera."""
    r, t, _ = _board()
    axes = [poses.rotate(r, tuple(F.lit(float(i == k)) for i in range(3))) for k in range(3)]
    # a board's matrix is made before its corners meet it, so that no corner repeats it
    placed = boards.select("snapshot", *(axes[j][i].alias(f"bm{i}{j}") for i in range(3) for j in range(3)), *(c.alias("bt" + k) for k, c in zip("xyz", t, strict=True)))
    rows = _posed(corners.join(placed, "snapshot"), sensors)
    p = _seen(v.add(_turned(v.vec(), "bm"), v.vec("bt")))
    away = F.lit(False)
    for s, lens in lenses.items():  # a rig's cameras are few
        far = F.hypot(*(a - F.col(c) for a, c in zip(lens_functions.project((F.col("p.x"), F.col("p.y"), F.when(F.col("p.z") > 0, F.col("p.z"))), lens), "uv", strict=True))) > most_px
        away |= (F.col("sensor") == s) & F.coalesce(far, F.lit(True))
    rows = rows.select("snapshot", "sensor", "u", "v", F.struct(*(c.alias(k) for c, k in zip(p, "xyz", strict=True))).alias("p"))
    return rows.where(away).select("snapshot").distinct()


def _enough(planes: DataFrame, boards: DataFrame, sensors: int, lenses: Intrinsics, names: dict[int, str]) -> None:
    """An error that names the sensors with too few boards left."""
    kinds = planes.sparkSession.createDataFrame([(k, "camera" if k in lenses else "lidar") for k in range(sensors)], "sensor int, kind string")
    counts = links.observation_counts(planes.join(boards.select("snapshot"), "snapshot", "left_semi"), kinds)
    few = [f"{r['kind']} {names.get(r['sensor'], r['sensor'])} has {r['n']}" for r in counts.where(~F.col("enough")).orderBy("sensor").collect()]
    if few:
        raise ValueError("too few boards that fit: " + ", ".join(few) + "; a lidar needs 3, a camera 1")


def calibrate(points: DataFrame, lenses: Intrinsics | None = None, *, seed: np.ndarray | None = None, exclude: DataFrame | None = None, sensors: int | None = None, names: dict[int, str] | None = None) -> Solution:
    """Seed, rejection of snapshots that do not fit it, and solve.

    ``lenses`` are the cameras' intrinsics by sensor; ``seed`` gives the
    sensors' rough poses in any common frame, if they are known;
    ``exclude(snapshot)`` lists snapshots that are not to be used; ``sensors``
    is the rig's number of sensors, without it that of the highest one seen,
    and ``names`` is what errors call them.
    """
    spark, lenses = points.sparkSession, lenses or {}
    if exclude is not None:
        points = points.join(exclude.select("snapshot"), "snapshot", "left_anti")
    seen_by_camera = F.col("sensor").isin(list(lenses))
    with Scratch(spark) as scratch:
        planes = board_planes(points.where(~seen_by_camera) if lenses else points)
        cameras = None
        if lenses:
            cameras = scratch.stored(boards_in_cameras(points.where(seen_by_camera), lenses), "cameras")
            planes = planes.unionByName(cameras.select(planes.columns))
        planes = scratch.stored(planes, "planes")
        used = planes.join(links.selected_snapshots(planes.select("snapshot", "sensor")).select("snapshot"), "snapshot", "left_semi")
        if sensors is None:
            last = used.agg(F.max("sensor")).first()[0]
            if last is None:
                raise ValueError("no snapshot in which two sensors see the board")
            sensors = int(last) + 1
        at = seed_from_vehicle(np.asarray(seed, float)) if seed is not None else seed_sensors(links.alignments(links.pair_sums(used)).collect(), sensors)  # one row for each pair of sensors
        boards = seed_boards(used, at)
        if cameras is not None:  # a camera also sees how the board is turned
            turned = boards_by_camera(cameras, at).select("snapshot", F.col("board").alias("b"), F.col("centre").alias("c"))
            boards = boards.join(turned, "snapshot", "left").select("snapshot", F.coalesce("b", "board").alias("board"), F.coalesce("c", "centre").alias("centre"))
        boards = scratch.stored(boards, "boards")
        bad = seed_outliers(used, at, boards)
        if cameras is not None:
            bad = bad.union(corner_outliers(points.where(seen_by_camera), at, boards, lenses))
        boards = scratch.stored(boards.join(bad, "snapshot", "left_anti"), "seeds")
        _enough(planes, boards, sensors, lenses, names or {})
        data = scratch.stored(adjustment.gathered(points, boards), "data")
        solution = _solved(data, at, lenses, scratch)
        scratch.drop("planes", "cameras", "boards", "seeds", "data")
    return solution


def _solved(data: DataFrame, sensors: np.ndarray, lenses: Intrinsics, scratch: Scratch, **limits: float) -> Solution:
    own = adjustment.adjust(data, {0: sensors}, lenses, **limits)[0]
    boards = scratch.stored(adjustment.boards_at(data, {0: own.sensors}, lenses, adjustment.Noise()).drop("replay"), "solved")
    return Solution(own.sensors, boards, np.linalg.inv(own.now.h), float(np.sqrt(own.now.cost / own.now.points)), own.steps)


def solve(points: DataFrame, sensors: np.ndarray, boards: DataFrame, lenses: Intrinsics | None = None, **limits: float) -> Solution:
    """Solve from given poses and ``boards(snapshot, board)``; see ``adjustment.adjust``.  Points of snapshots without a board are not used."""
    with Scratch(points.sparkSession) as scratch:
        data = scratch.stored(adjustment.gathered(points, boards), "data")
        solution = _solved(data, sensors, lenses or {}, scratch, **limits)
        scratch.drop("data")
    return solution


def replayed(points: DataFrame, solution: Solution, replays: int, lenses: Intrinsics | None = None, *, seed: int = 0, sigma_m: float = SIGMA_M, sigma_px: float = SIGMA_PX) -> DataFrame:
    """``(replay, sensor, rx..tz)``: poses solved again from a solution, for replays 1 to ``replays`` each with noise of its own.

    All replays take their steps in the same jobs.  The same ``seed`` gives the
    same noise, wherever the points lie.
    """
    spark = points.sparkSession
    with Scratch(spark) as scratch:
        data = scratch.stored(adjustment.gathered(points, solution.boards), "data")
        found = adjustment.adjust(data, {k: solution.sensors for k in range(1, replays + 1)}, lenses or {}, noise=adjustment.Noise(seed, sigma_m, sigma_px), solved=True)
        scratch.drop("data")
    rows = [(k, s, *map(float, pose)) for k, own in found.items() for s, pose in enumerate(own.sensors)]
    return spark.createDataFrame(rows, "replay int, sensor int, rx double, ry double, rz double, tx double, ty double, tz double")


def replay_covariance(replays: DataFrame) -> DataFrame:
    """``(i, j, value)``: sample covariance over replays of the poses' numbers, without sensor 0; in the order of ``covariance_table``."""
    numbers = F.array(*(k + c for k in "rt" for c in "xyz"))
    state = replays.where("sensor > 0").select("replay", "sensor", F.posexplode(numbers).alias("k", "x")).select("replay", (6 * (F.col("sensor") - 1) + F.col("k")).alias("i"), "x")
    pairs = state.join(state.select("replay", F.col("i").alias("j"), F.col("x").alias("y")), "replay")
    return pairs.groupBy("i", "j").agg(F.covar_samp("x", "y").alias("value"))


def in_vehicle(solution: Solution, vehicle: np.ndarray) -> np.ndarray:
    """Poses of the sensors in the vehicle's frame; ``vehicle`` takes sensor 0's frame to it."""
    return np.array([poses.compose(vehicle, pose) for pose in solution.sensors])


def seed_from_vehicle(in_vehicle: np.ndarray) -> np.ndarray:
    """Seed poses in sensor 0's frame from poses in the vehicle's."""
    back = poses.inverted(in_vehicle[0])
    return np.array([poses.compose(back, pose) for pose in in_vehicle])


def position_stdevs(solution: Solution) -> list[tuple[int, float, float, float, float]]:
    """``(sensor, x, y, z, worst)``: standard deviations of each sensor's place along the axes and in the worst direction; sensor 0 is fixed."""
    out = [(0, 0.0, 0.0, 0.0, 0.0)]
    for s in range(1, len(solution.sensors)):
        at = 6 * (s - 1) + 3
        own = solution.covariance[at : at + 3, at : at + 3]
        out.append((s, *np.sqrt(np.maximum(np.diag(own), 0)).tolist(), float(np.sqrt(max(np.linalg.eigvalsh(own)[-1], 0)))))
    return out


def _sensitivity(solution: Solution, sensor0: int, sensor1: int, at: np.ndarray) -> np.ndarray:
    """How a point of the reference frame, seen by sensor0 and taken over by sensor1's pose, moves with the sensors' numbers."""
    m = np.zeros((3, 6 * len(solution.sensors)))
    for s, sign in ((sensor0, -1.0), (sensor1, 1.0)):
        if s:
            pose = solution.sensors[s]
            m[:, 6 * s : 6 * s + 6] = sign * np.concatenate([-poses.skew(at - pose[3:]) @ poses.left_jacobian(pose[:3]), np.eye(3)], 1)
    return m[:, 6:]


def transform_covariance(solution: Solution, sensor0: int, sensor1: int, at: np.ndarray) -> np.ndarray:
    """Covariance of a point of the reference frame, seen by sensor0 and taken over by sensor1's pose."""
    m = _sensitivity(solution, sensor0, sensor1, at)
    return m @ solution.covariance @ m.T


def sector_stdevs(points: DataFrame, visible: DataFrame, solution: Solution) -> DataFrame:
    """``(sector, sensor0, sensor1, stdev)`` at query ``points(sector, x, y, z)``, for pairs that both see the sector."""
    rows = visible.join(points, "sector")
    sent = rows.sparkSession.sparkContext.broadcast(Solution(solution.sensors, None, solution.covariance, solution.rms, solution.iterations))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            worst = [float(np.sqrt(max(np.linalg.eigvalsh(transform_covariance(sent.value, a, b, np.array(p)))[-1], 0))) for a, b, *p in zip(part.sensor0, part.sensor1, part.x, part.y, part.z, strict=True)]
            yield part[["sector", "sensor0", "sensor1"]].assign(stdev=worst)

    return rows.select("sector", "sensor0", "sensor1", "x", "y", "z").mapInPandas(run, "sector int, sensor0 int, sensor1 int, stdev double")


def _placed(p: v.Vec, pose: np.ndarray) -> v.Vec:
    """A place moved by a known pose: nine constants."""
    m = poses.matrix(pose[:3])
    return tuple(sum((float(m[i, j]) * p[j] for j in range(3)), F.lit(float(pose[3 + i]))) for i in range(3))


def sector_report(points: DataFrame, solution: Solution, sectors_: int, at: float, *, vehicle: np.ndarray | None = None, beyond: float = 1.0, at_least: int = 1, lenses: Intrinsics | None = None, sizes: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """``(sector, n_boards, sensors, stdev, sensor0, sensor1)`` around the vehicle.

    ``n_boards`` of the solution lie in the sector, ``sensors`` see it: lidars
    with ``at_least`` points beyond a distance, cameras whose image, of
    ``sizes`` pixels, holds both of its edges at distance ``at``.  ``stdev`` is
    the worst disagreement of two of these in the sector's middle, that of
    ``sensor0`` and ``sensor1``; 0 and null where no two see it.  ``vehicle``
    takes sensor 0's frame to the vehicle's, in which sectors are.
    """
    spark, lenses = points.sparkSession, lenses or {}
    vehicle = np.zeros(6) if vehicle is None else np.asarray(vehicle, float)
    place = tuple(F.get("board", F.lit(k)) for k in (3, 4, 5))
    boards = solution.boards.select("snapshot", *(c.alias(k) for c, k in zip(_placed(place, vehicle), "xyz", strict=True)))
    counts = sectors.observations_per_sector(boards, sectors_)
    placed = [poses.compose(vehicle, p) for p in solution.sensors]
    moved = _posed(points.where(~F.col("sensor").isin(list(lenses))), np.array(placed))
    cloud = moved.select("sensor", *(c.alias(k) for c, k in zip(_moved(v.vec()), "xyz", strict=True)))
    visible = sectors.lidar_visibility(cloud, "sensor", sectors_, beyond, at_least).select("sensor", "sector", "visible")
    if lenses:
        rows = [(s, *map(float, placed[s]), *map(float, (*lens[:4], *lens_functions.coefficients(lens))), *sizes[s]) for s, lens in lenses.items()]
        kind = "camera int, " + ", ".join(f"{k}{c} double" for k in "rt" for c in "xyz") + ", " + ", ".join(f"{c} double" for c in sectors.LENS) + ", width int, height int"
        visible = visible.unionByName(sectors.camera_visibility(spark.createDataFrame(rows, kind), sectors_, at).select(F.col("camera").alias("sensor"), "sector", "visible"))
    visible = visible.where("visible")
    seers = visible.groupBy("sector").agg(F.array_sort(F.collect_set("sensor")).alias("sensors"))
    middles = sectors.query_points(spark, sectors_, at).select("sector", *(c.alias(k) for c, k in zip(_placed(v.vec(), poses.inverted(vehicle)), "xyz", strict=True)))
    worst = sectors.worst_pairs(sector_stdevs(middles, sectors.visible_pairs(visible), solution), sectors_)
    return counts.select("sector", F.col("n").alias("n_boards")).join(seers, "sector", "left").join(worst, "sector", "left").select("sector", "n_boards", F.coalesce("sensors", F.array().cast("array<int>")).alias("sensors"), "stdev", "sensor0", "sensor1")


def with_noise(points: DataFrame, seed: int, sigma: float = SIGMA_M) -> DataFrame:
    """Points moved along their rays by normal noise."""
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    k = 1 + sigma * F.randn(seed) / size
    return points.withColumn("__k", k).withColumns({c: F.col(c) * F.col("__k") for c in "xyz"}).drop("__k")


def pose_table(solution: Solution, spark) -> DataFrame:
    rows = [(k, *map(float, p)) for k, p in enumerate(solution.sensors)]
    return spark.createDataFrame(rows, "sensor int, rx double, ry double, rz double, tx double, ty double, tz double")


def covariance_table(solution: Solution, spark) -> DataFrame:
    """``(i, j, value)`` of the covariance."""
    n = len(solution.covariance)
    return spark.createDataFrame([(i, j, float(solution.covariance[i, j])) for i in range(n) for j in range(n)], "i int, j int, value double")


def solution_of(tables: dict[str, DataFrame]) -> Solution:
    """A solution from its tables ``poses``, ``boards`` and ``covariance``; the first and last hold a few rows a sensor."""
    rows = tables["poses"].orderBy("sensor").collect()
    sensors = np.array([[r[k + c] for k in "rt" for c in "xyz"] for r in rows])
    covariance = np.zeros((6 * len(rows) - 6,) * 2)
    for r in tables["covariance"].collect():
        covariance[r["i"], r["j"]] = r["value"]
    return Solution(sensors, tables["boards"], covariance, float("nan"), 0)


def covariances_at(grid: DataFrame, solution: Solution, sensor0: int, sensor1: int) -> DataFrame:
    """``grid(..., x, y[, z])`` with the covariance ``cxx, cxy, cxz, cyy, cyz, czz`` of the two sensors' agreement there.

    The map from the poses' errors to a place is linear in the place, so the
    six numbers are expressions in it with a fixed number of constants.
    """
    z = F.col("z") if "z" in grid.columns else F.lit(0.0)
    basis = [np.zeros(3), *np.eye(3)]
    maps = [_sensitivity(solution, sensor0, sensor1, b) for b in basis]
    parts = [maps[0], *(m - maps[0] for m in maps[1:])]
    place = [F.lit(1.0), F.col("x"), F.col("y"), z]
    out = grid
    for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)):
        terms = [(float((parts[a] @ solution.covariance @ parts[b].T)[i, j]), a, b) for a in range(4) for b in range(4)]
        out = out.withColumn(f"c{'xyz'[i]}{'xyz'[j]}", sum((F.lit(c) * place[a] * place[b] for c, a, b in terms[1:]), F.lit(terms[0][0])))
    return out


def ellipsoid_axes(rows: DataFrame, prefix: str = "c") -> DataFrame:
    """``rows`` of symmetric 3 x 3 matrices ``cxx .. czz`` with ``s1 >= s2 >= s3``, standard deviations along the main axes, and the unit axes ``a1x .. a3z``, a right-handed frame.

    Of equal deviations any axes that fit come out; a zero matrix gives the
    frame's own axes.
    """
    m = [F.col(prefix + k) for k in ("xx", "yy", "zz", "xy", "xz", "yz")]
    vec = lambda name: tuple(F.get(name, F.lit(k)) for k in range(3))
    low, middle, high = v.eigenvalues3(*m)
    rows = rows.withColumns({"_low": low, "_middle": middle, "_high": high})
    # the outer axis that is better told from the middle one comes first
    top = F.col("_high") - F.col("_middle") >= F.col("_middle") - F.col("_low")
    rows = rows.withColumn("_top", top).withColumn("_main", F.array(*v.eigenvector3(*m, F.when(top, F.col("_high")).otherwise(F.col("_low")))))
    rows = rows.withColumn("_other", F.array(*v.eigenvector3(*m, F.when(F.col("_top"), F.col("_low")).otherwise(F.col("_high")))))
    scale = F.greatest(F.abs("_high"), F.abs("_low"))
    rows = rows.withColumn("_main", F.array(*_unit(vec("_main"), 1e-9 * scale * scale, tuple(map(F.lit, (1.0, 0.0, 0.0))))))
    main, other = vec("_main"), vec("_other")
    along = v.dot(main, other)
    x, y, _ = main
    free = v.cross(main, (F.when(F.abs(x) < 0.6, 1.0).otherwise(0.0), F.when((F.abs(x) >= 0.6) & (F.abs(y) < 0.6), 1.0).otherwise(0.0), F.when((F.abs(x) >= 0.6) & (F.abs(y) >= 0.6), 1.0).otherwise(0.0)))
    across = v.sub(_unit(other, 1e-9 * scale * scale, free), v.scale(main, F.when(F.sqrt(v.dot(other, other)) > 1e-9 * scale * scale, along / F.sqrt(F.when(v.dot(other, other) > 0, v.dot(other, other)).otherwise(1.0))).otherwise(0.0)))
    rows = rows.withColumn("_other", F.array(*_unit(across, F.lit(1e-6), free))).withColumn("_other", F.array(*_unit(vec("_other"), F.lit(0.0), vec("_other"))))
    rows = rows.withColumn("_one", F.when(F.col("_top"), F.col("_main")).otherwise(F.col("_other"))).withColumn("_three", F.when(F.col("_top"), F.col("_other")).otherwise(F.col("_main")))
    two = v.cross(vec("_three"), vec("_one"))
    named = {f"s{k}": F.sqrt(F.greatest(F.col(c), F.lit(0.0))) for k, c in ((1, "_high"), (2, "_middle"), (3, "_low"))}
    named |= {f"a{n}{c}": part for n, axis in ((1, vec("_one")), (2, two), (3, vec("_three"))) for c, part in zip("xyz", axis, strict=True)}
    return rows.withColumns(named).drop("_low", "_middle", "_high", "_top", "_main", "_other", "_one", "_three")


def _unit(a: v.Vec, least, otherwise: v.Vec) -> v.Vec:
    """``a`` at length 1 if it is longer than ``least``."""
    size = F.sqrt(v.dot(a, a))
    return tuple(F.when(size > least, c / F.when(size > least, size)).otherwise(o) for c, o in zip(a, otherwise, strict=True))


def ellipsoid_points(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """``rows`` of ``ellipsoid_axes`` with a centre ``x, y, z``, each with the places ``ex, ey, ez`` of its ellipsoid of one standard deviation; ``grid(i, j, x, y, z)`` is a sphere's, of a fixed size."""
    unit = F.broadcast(grid.select(F.col("i").alias("gi"), F.col("j").alias("gj"), *(F.col(c).alias("u" + c) for c in "xyz")))
    place = {f"e{c}": F.col(c) + sum((F.col(f"s{n}") * F.col(f"u{u}") * F.col(f"a{n}{c}") for n, u in ((2, "y"), (3, "z"))), F.col("s1") * F.col("ux") * F.col(f"a1{c}")) for c in "xyz"}
    return rows.crossJoin(unit).withColumns(place)  # the sphere has a fixed number of places


def uncertainty_map(grid: DataFrame, solution: Solution, sensor0: int, sensor1: int) -> DataFrame:
    """``grid(i, j, x, y[, z])`` with the standard deviation ``stdev`` of the two sensors' agreement in its worst direction ``dx, dy, dz``, and the half axes ``ax >= ay >= az`` of its ellipsoid."""
    found = ellipsoid_axes(covariances_at(grid, solution, sensor0, sensor1))
    return found.select(*grid.columns, F.col("s1").alias("stdev"), *(F.col("a1" + c).alias("d" + c) for c in "xyz"), F.col("s1").alias("ax"), F.col("s2").alias("ay"), F.col("s3").alias("az"))
