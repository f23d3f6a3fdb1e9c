"""From logs to poses, the command-line tools, and guards."""

import numpy as np
import pandas as pd
import pytest

from rigspark.__main__ import main
from rigspark.functions import poses
from rigspark.operators import assembly, calibration, links, residuals, segmentation
from rigspark.operators.parameters import SegmentationParameters
from rigspark.plans.board_queries import rig_points
from rigspark.sources import bundles, synthetic

PAR = SegmentationParameters(per_rotation=1024)
SENSOR1 = np.array([0.02, -0.03, 0.3, 0.4, -0.3, 0.1])


@pytest.fixture(scope="module")
def logged(spark):
    """Two lidars, six boards; a span with one message only, and one in an excluded period."""
    boards = [((3.0, 0.4, 0.2), (1.0, 0.3, 0.2)), ((0.2, 3.2, 0.0), (0.1, 1.0, 0.3)), ((-3.1, 0.3, 0.1), (-1.0, 0.2, -0.2)), ((0.1, -3.0, 0.3), (0.2, -1.0, 0.25)), ((2.2, 2.2, -0.1), (1.0, 0.6, -0.3)), ((-2.0, -2.3, 0.0), (-1.0, -0.7, 0.35))]
    turn = poses.matrix(SENSOR1[:3])
    log, clouds = [], []
    for k, (c, n) in enumerate(boards):
        for sensor in (0, 1):
            at, ahead = (np.array(c), np.array(n)) if sensor == 0 else (turn.T @ (np.array(c) - SENSOR1[3:]), turn.T @ np.array(n))
            msg = 2 * k + sensor
            log.append((f"lidar{sensor}", k * 1_000_000 + 1000 * sensor, msg, 0.0))
            clouds.append(synthetic.board_scan(tuple(at), tuple(ahead), columns=1024, wall=None).assign(msg_id=msg))
    log += [("lidar0", 6_000_000, 100, 0.0), ("other", 6_000_001, 101, 0.0), ("lidar0", 7_000_000, 102, 0.0), ("lidar1", 7_000_001, 103, 0.0)]
    rows = pd.concat(clouds)[["msg_id", "ring", "point_idx", "x", "y", "z"]]
    points = spark.createDataFrame(rows, "msg_id long, ring int, point_idx long, x double, y double, z double").persist()
    sensors = spark.createDataFrame([("lidar0", 0, "lidar"), ("lidar1", 1, "lidar")], "topic string, sensor int, kind string")
    return spark.createDataFrame(log, "topic string, time_us long, msg_id long, value double"), points, sensors


def test_log_to_poses(spark, logged):
    log, points, sensors = logged
    periods = spark.createDataFrame([(6_999_999, 7_500_000)], "t0 long, t1 long")
    found = assembly.calibrate_log(log, points, sensors, 1_000_000, 0, PAR, periods=periods, spread_us=10_000)
    assert np.abs(found.sensors[1] - SENSOR1).max() < 0.03 and found.boards.count() == 6


def test_tools(spark, logged, tmp_path):
    log, points, sensors = logged
    paths = {n: str(tmp_path / n) for n in ("log", "points", "sensors", "dump", "poses", "scan")}
    for name, table in (("log", log), ("points", points), ("sensors", sensors), ("scan", points.where("msg_id < 2").withColumnRenamed("msg_id", "scan"))):
        table.write.parquet(paths[name])
    assert main(["show-log", "--bag", paths["log"]], spark).first()["n"] == log.count()
    assert main(["show-log", "--bag", paths["log"], "--topics", "other", "--list"], spark).count() == 1
    assert {r["per_rotation"] for r in main(["infer-spacing", paths["scan"]], spark).collect()}
    assert main(["segment", paths["scan"], "--per-rotation", "1024", "--fixtures"], spark).count() == 2
    assert {r["tag"] for r in main(["segment", paths["scan"], "--per-rotation", "1024", "--dump"], spark).select("tag").distinct().collect()} == {"point", "segment", "seed", "plane"}
    got = main(["fit", "--bag", paths["log"], "--points", paths["points"], "--sensors", paths["sensors"], "--period-us", "1000000", "--per-rotation", "1024", "--dump", paths["dump"], "--out", paths["poses"]], spark)
    assert got.count() == 2
    assert main(["show-uncertainty", paths["dump"], "--grid", "5"], spark).where("stdev > 0 and ax >= ay").count() == 25
    assert main(["sectors", paths["dump"], "--sectors", "8"], spark).agg({"n": "sum"}).first()[0] == 6
    assert main(["ros-frames", paths["poses"], "--names", '{"0": "a", "1": "b"}'], spark).count() == 2
    cloud = points.where("msg_id < 2").withColumnRenamed("msg_id", "sensor")
    cloud.write.parquet(str(tmp_path / "cloud"))
    assert main(["show-clouds", str(tmp_path / "cloud"), "--poses", paths["poses"], "--beyond", "9"], spark).count() == cloud.count()


def test_arguments_are_checked(spark, logged):
    _, _, sensors = logged
    assert assembly.check_arguments(sensors, None, np.zeros((2, 6))) == 2
    camera = spark.createDataFrame([("a", 0, "lidar"), ("b", 1, "camera")], sensors.schema)
    for rows, lenses, seed in ((sensors, {1: (1, 1, 1, 1)}, None), (camera, None, None), (sensors, None, np.zeros((3, 6))), (sensors.limit(1), None, None), (sensors.where("sensor = 1"), None, None), (camera.where("sensor = 5"), None, None)):
        with pytest.raises(ValueError):
            assembly.check_arguments(rows, lenses, seed)
    with pytest.raises(ValueError):
        assembly.one_schema()


def test_seeds_exclusion_and_vehicle_frame(spark):
    truth, _, _ = synthetic.rig()
    points = rig_points(spark)
    found = calibration.calibrate(points, seed=truth + 0.001, exclude=spark.createDataFrame([(0,), (1,)], "snapshot int"))
    assert np.abs(found.sensors - truth).max() < 1e-6 and found.boards.count() == 10
    vehicle = np.array([0.1, 0.2, -0.3, 1.0, 2.0, 3.0])
    placed = calibration.in_vehicle(found, vehicle)
    assert np.allclose(placed[0], vehicle) and np.allclose(calibration.seed_from_vehicle(placed), found.sensors, atol=1e-9)
    stdevs = calibration.position_stdevs(found)
    assert stdevs[0] == (0, 0.0, 0.0, 0.0, 0.0) and all(s[4] >= max(s[1:4]) > 0 for s in stdevs[1:])


def test_an_absurd_seed_is_refused(spark):
    truth, boards, _ = synthetic.rig()
    table = spark.createDataFrame([(k, (b + [0, 0, 0, 500, 500, 0]).tolist()) for k, b in enumerate(boards)], "snapshot long, board array<double>")
    with pytest.raises(ValueError, match="seed"):
        calibration.solve(rig_points(spark), truth, table)


def test_small_functions(spark):
    assert residuals.board_centre(4, 3, 0.1) == pytest.approx((0.1, 0.15, 0.0))
    names = {r["name"] for r in SegmentationParameters.table(spark).collect()}
    assert {"per_rotation", "max_range"} <= names
    reached = spark.createDataFrame([(0, 0), (1, 1)], "sensor int, steps int")
    assert [r["sensor"] for r in links.unreachable(spark.range(3).selectExpr("cast(id as int) as sensor"), reached).collect()] == [2]
    rows = spark.createDataFrame([(2, [("a", "b", "late")]), (1, [("a", "b", "early"), ("a", "c", "other")])], "time_us long, transforms array<struct<parent: string, child: string, pose: string>>")
    assert bundles.static_transform(rows, "a", "b") == "early" and bundles.static_transform(rows, "x", "b") is None
    planes = spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "scan int, plane int")
    assert [r["scan"] for r in segmentation.observed_boards(planes).collect()] == [0]
    diag = assembly.moving_points(spark.createDataFrame([(s, 0, s, 0, 0, 5.0, 0.0, 0.0) for s in range(6)] + [(0, 0, 0, 0, 1, 0.0, 3.0, 0.0)], "snapshot int, sensor int, scan int, ring int, point_idx long, x double, y double, z double"), 4)
    assert [(r["snapshot"], r["y"], r["ring"]) for r in diag.collect()] == [(0, 3.0, 0)]


def test_scales_go_back(spark):
    pose = spark.createDataFrame([(0.1, 0.2, 0.3, 1.0, 2.0, 3.0)], "rx double, ry double, rz double, tx double, ty double, tz double")
    for kind in ("sensor", "board"):
        assert np.allclose(pose.select(*assembly.scaled(kind)).select(*assembly.scaled(kind, back=True)).first(), pose.first())


def test_long_chains_are_followed_to_their_end(spark):
    chain = spark.range(60).selectExpr("cast(id as int) AS sensor0", "cast(id + 1 as int) AS sensor1")
    assert {r["sensor"]: r["steps"] for r in links.reachable(chain).collect()} == {k: k for k in range(61)}
    shortcut = chain.unionAll(spark.sql("SELECT 0 AS sensor0, 50 AS sensor1"))
    assert {r["sensor"]: r["steps"] for r in links.reachable(shortcut, 50).collect()}[1] == 2
    assert [tuple(r) for r in links.reachable(chain.where("sensor0 > 99")).collect()] == [(0, 0)]


def test_fit_from_chunked_logs_with_a_camera(spark, tmp_path):
    """A bag for each board, in chunks; the camera ahead sees two of the boards; poses come out in the vehicle's frame."""
    from rigspark.functions import lenses
    from rigspark.sources import logs

    boards = [((3.0, 0.4, 0.2), (1.0, 0.3, 0.2)), ((0.2, 3.2, 0.0), (0.1, 1.0, 0.3)), ((-3.1, 0.3, 0.1), (-1.0, 0.2, -0.2)), ((0.1, -3.0, 0.3), (0.2, -1.0, 0.25))]
    lens = (800.0, 800.0, 640.0, 480.0, -0.1, 0.02)
    look = poses.rodrigues(np.array([[0, 0, 1.0], [-1, 0, 0], [0, -1, 0]]))
    camera = np.array([*look, 0.1, 0.2, -0.1])
    turn, i, j = poses.matrix(SENSOR1[:3]), *np.divmod(np.arange(36), 6)
    flat = np.stack([j * 0.1, i * 0.1, np.zeros(36)], 1)
    messages, corners = [], []
    for k, (c, n) in enumerate(boards):
        for sensor in (0, 1):
            at, ahead = (np.array(c), np.array(n)) if sensor == 0 else (turn.T @ (np.array(c) - SENSOR1[3:]), turn.T @ np.array(n))
            scan = synthetic.board_scan(tuple(at), tuple(ahead), columns=1024, wall=None)
            messages.append((f"bag{k}", f"lidar{sensor}", 1_000_000 * k + sensor, logs.POINT_TYPES[0], bytearray(logs.cloud_payload(k, "f", scan[["x", "y", "z"]].to_numpy(), scan.ring.to_numpy()))))
        if k == 0:
            seen = (flat - [0.25, 0.25, 0]) @ poses.aligning(np.array(n)).T + c
            uv = lenses.project_points((seen - camera[3:]) @ poses.matrix(camera[:3]), lens)
            messages.append((f"bag{k}", "camera", 1_000_000 * k + 5, "image", bytearray(b"")))
            corners += [(f"bag{k}", "camera", 1_000_000 * k + 5, *map(float, f), *map(float, q)) for f, q in zip(flat, uv, strict=True)]
    logs.write_logs(spark.createDataFrame(messages, "bag string, topic string, time_ns long, type string, payload binary"), str(tmp_path / "logs"))
    spark.createDataFrame(corners, "bag string, topic string, time_ns long, x double, y double, z double, u double, v double").selectExpr("xxhash64(bag, topic, time_ns) AS msg_id", *"xyzuv").write.parquet(str(tmp_path / "corners"))
    spark.createDataFrame([("lidar0", 0, "lidar"), ("lidar1", 1, "lidar"), ("camera", 2, "camera")], "topic string, sensor int, kind string").write.parquet(str(tmp_path / "sensors"))
    vehicle = [0.0, 0.0, 0.0, 1.0, 2.0, 3.0]
    seed = [poses.compose(np.array(vehicle), p).tolist() for p in (np.zeros(6), SENSOR1 + 0.01, camera + 0.01)]
    arguments = ["fit", "--logs", str(tmp_path / "logs" / "bag*"), "--sensors", str(tmp_path / "sensors"), "--lenses", f'{{"2": {list(lens)}}}', "--seed", str(seed), "--vehicle", str(vehicle), "--per-rotation", "1024"]
    with pytest.raises(ValueError, match="corners"):
        main(arguments, spark)
    got = {r["sensor"]: r for r in main([*arguments, "--corners", str(tmp_path / "corners"), "--pose-files", str(tmp_path / "poses"), "--sizes", '{"2": [1280, 960]}', "--dump", str(tmp_path / "dump")], spark).collect()}
    for k, pose in enumerate((np.zeros(6), SENSOR1, camera)):
        assert np.abs(np.array([got[k]["t" + c] for c in "xyz"]) - pose[3:] - [1, 2, 3]).max() < 0.05
    assert sorted(p.name for p in (tmp_path / "poses").glob("name=*")) == ["name=camera", "name=lidar0", "name=lidar1"]
    report = spark.read.parquet(str(tmp_path / "dump" / "sectors"))
    assert report.count() == 36 and report.agg({"n_boards": "sum"}).first()[0] == 4
