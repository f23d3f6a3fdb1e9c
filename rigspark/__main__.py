"""Command-line tools: ``python -m rigspark TOOL ...``; logs are Parquet or chunked, results are Parquet."""

from __future__ import annotations

import argparse
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import assembly, calibration, sectors, segmentation, snapshots, views
from .operators import scans as scan_ops
from .operators.parameters import SegmentationParameters
from .sources import bundles, logs


def _log(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return bundles.read_log(spark, a.bag, a.topics.split(",") if a.topics else None, a.after, a.before)


def _poses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def show_log(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Times, number and topics of a log; with --list, its messages."""
    log = _log(spark, a)
    return log.orderBy("time_us", "msg_id").limit(a.most) if a.list else snapshots.info(log)


def infer_spacing(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Points in a turn and rings of each scan."""
    return scan_ops.scan_summary(spark.read.parquet(*a.points))


def segment(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Boards in scans; with --dump, what each step of the segmentation made."""
    par = SegmentationParameters(per_rotation=a.per_rotation)
    points = spark.read.parquet(*a.points)
    if a.dump:
        return assembly.diagnostics(points, par, a.per_rotation)
    planes = segmentation.segment_planes(points, par)
    return assembly.fixture_lines(planes) if a.fixtures else planes


def _numbers(text: str | None):
    return json.loads(text) if text else None


def _lenses(a: argparse.Namespace) -> dict[int, tuple[float, ...]] | None:
    return {int(k): tuple(x) for k, x in json.loads(a.lenses).items()} if a.lenses else None


def _solved(spark: SparkSession, a: argparse.Namespace, points: DataFrame, sensors: int | None = None, names: dict[int, str] | None = None) -> DataFrame:
    exclude = spark.createDataFrame([(k,) for k in a.exclude], "snapshot long") if a.exclude else None
    seed, vehicle = _numbers(a.seed), _numbers(a.vehicle)
    lenses = _lenses(a)
    found = calibration.calibrate(points, lenses, seed=None if seed is None else np.array(seed, float), exclude=exclude, sensors=sensors, names=names)
    if a.dump:
        kind = "sensor int, x double, y double, z double, worst double"
        sizes = {int(k): tuple(x) for k, x in (_numbers(a.sizes) or {}).items()}
        report = calibration.sector_report(points, found, a.sectors, a.reach, vehicle=None if vehicle is None else np.array(vehicle, float), lenses={k: x for k, x in (lenses or {}).items() if k in sizes}, sizes=sizes)
        bundles.write_bundle(a.dump, observations=points, poses=calibration.pose_table(found, spark), boards=found.boards, covariance=calibration.covariance_table(found, spark), stdevs=spark.createDataFrame(calibration.position_stdevs(found), kind), sectors=report)
        if a.replays:
            bundles.write_bundle(a.dump, replays=calibration.replayed(points, found, a.replays, lenses))
    if vehicle is not None:
        found = calibration.Solution(calibration.in_vehicle(found, np.array(vehicle, float)), found.boards, found.covariance, found.rms, found.iterations)
    table = calibration.pose_table(found, spark)
    if a.pose_files:
        bundles.write_pose_files(table, a.pose_files, names or {k: f"sensor{k}" for k in range(len(found.sensors))})
    return table


def fit(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Poses of the sensors from logs and a table ``(topic, sensor, kind)``; chunked logs hold their points, Parquet logs have them beside them."""
    sensors = spark.read.parquet(a.sensors)
    seed = _numbers(a.seed)
    number = assembly.check_arguments(sensors, _lenses(a), None if seed is None else np.array(seed, float))
    corners = spark.read.parquet(a.corners) if a.corners else None
    if a.logs:
        raw = logs.read_logs(spark, a.logs, a.exclude_bags)
        log, points = logs.as_messages(raw), logs.points_of(raw)
    elif a.bag and a.points:
        log, points = _log(spark, a), spark.read.parquet(*a.points)
    else:
        raise ValueError("fit needs --logs, or --bag and --points")
    periods = spark.createDataFrame([tuple(p) for p in _numbers(a.periods)], "t0 long, t1 long") if a.periods else None
    seen = assembly.observed(log, points, sensors, SegmentationParameters(per_rotation=a.per_rotation), period_us=a.period_us, start_us=a.start_us, corners=corners, periods=periods, spread_us=a.spread_us, static_least=a.static_least)
    return _solved(spark, a, seen, number, assembly.topic_names(sensors))


def fit_again(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Poses from the observations of a dump."""
    return _solved(spark, a, bundles.read_bundle(spark, a.bundle, "observations")["observations"])


def show_clouds(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Points of all sensors in the reference frame."""
    return views.in_common_frame(spark.read.parquet(*a.points), _poses(spark, a.poses), a.beyond)


def show_uncertainty(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Standard deviation in the worst direction by place around the vehicle, for two sensors of a dump."""
    solution = calibration.solution_of(bundles.read_bundle(spark, a.bundle, "poses", "boards", "covariance"))
    grid = views.mesh_grid(spark, a.grid, a.reach)
    return calibration.uncertainty_map(grid, solution, a.sensor0, a.sensor1)


def sector_report(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Observations by sector around the vehicle of a dump's boards."""
    boards = bundles.read_bundle(spark, a.bundle, "boards")["boards"]
    return sectors.observations_per_sector(boards.select("snapshot", F.col("board")[3].alias("x"), F.col("board")[4].alias("y")), a.sectors)


def ros_frames(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Lines of text for a transform publisher."""
    names = {int(k): x for k, x in json.loads(a.names).items()}
    return bundles.transforms_yaml(_poses(spark, a.poses), a.base, names)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rigspark", description=__doc__)
    tools = top.add_subparsers(required=True)

    def tool(name: str, run) -> argparse.ArgumentParser:
        own = tools.add_parser(name, help=run.__doc__)
        own.set_defaults(run=run)
        own.add_argument("--out", help="Parquet folder for the result; else it is printed")
        return own

    def of_log(own: argparse.ArgumentParser, required: bool = True) -> None:
        own.add_argument("--bag", nargs="+", required=required)
        own.add_argument("--topics")
        own.add_argument("--after", type=int)
        own.add_argument("--before", type=int)

    def of_solve(own: argparse.ArgumentParser) -> None:
        own.add_argument("--dump", help="folder for observations and results")
        own.add_argument("--exclude", type=int, nargs="*", default=[])
        own.add_argument("--lenses", help="JSON: sensor to fx, fy, cx, cy and distortion")
        own.add_argument("--sizes", help="JSON: camera to width, height, for the report by sector")
        own.add_argument("--seed", help="JSON: a rough pose in any one frame for each sensor")
        own.add_argument("--vehicle", help="JSON: the pose that takes sensor 0's frame to the vehicle's")
        own.add_argument("--sectors", type=int, default=36)
        own.add_argument("--reach", type=float, default=10.0)
        own.add_argument("--replays", type=int, default=0, help="solves with fresh noise to add to the dump")
        own.add_argument("--pose-files", help="folder for a file with each sensor's pose")

    own = tool("show-log", show_log)
    of_log(own)
    own.add_argument("--list", action="store_true")
    own.add_argument("--most", type=int, default=100)
    tool("infer-spacing", infer_spacing).add_argument("points", nargs="+")
    own = tool("segment", segment)
    own.add_argument("points", nargs="+")
    own.add_argument("--per-rotation", type=int, default=2048)
    own.add_argument("--dump", action="store_true")
    own.add_argument("--fixtures", action="store_true")
    own = tool("fit", fit)
    of_log(own, required=False)
    of_solve(own)
    own.add_argument("--logs", help="glob of chunked logs, each a snapshot unless there is a period")
    own.add_argument("--exclude-bags", nargs="*", default=[], help="expressions found in the paths of logs to leave out")
    own.add_argument("--points", nargs="+")
    own.add_argument("--corners", help="Parquet (msg_id, x, y, z, u, v) of the cameras' messages")
    own.add_argument("--sensors", required=True)
    own.add_argument("--period-us", type=int)
    own.add_argument("--start-us", type=int, default=0)
    own.add_argument("--periods", help="JSON: spans of time to leave out")
    own.add_argument("--spread-us", type=int)
    own.add_argument("--per-rotation", type=int, default=2048)
    own.add_argument("--static-least", type=int, default=0)
    own = tool("fit-again", fit_again)
    of_solve(own)
    own.add_argument("bundle")
    own = tool("show-clouds", show_clouds)
    own.add_argument("points", nargs="+")
    own.add_argument("--poses", required=True)
    own.add_argument("--beyond", type=float)
    own = tool("show-uncertainty", show_uncertainty)
    own.add_argument("bundle")
    own.add_argument("--sensor0", type=int, default=0)
    own.add_argument("--sensor1", type=int, default=1)
    own.add_argument("--grid", type=int, default=25)
    own.add_argument("--reach", type=float, default=20.0)
    own = tool("sectors", sector_report)
    own.add_argument("bundle")
    own.add_argument("--sectors", type=int, default=36)
    own = tool("ros-frames", ros_frames)
    own.add_argument("poses")
    own.add_argument("--base", default="vehicle")
    own.add_argument("--names", required=True, help="JSON: sensor to frame name")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("rigspark").getOrCreate()
    result = a.run(spark, a)
    if a.out:
        result.write.parquet(a.out)
    else:
        result.show(100, truncate=False)
    return result


if __name__ == "__main__":
    main()
