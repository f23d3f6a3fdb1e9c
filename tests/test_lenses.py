"""Lenses, poses of boards that are seen aslant, ellipsoids, and replays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigspark.functions import lenses, poses
from rigspark.functions import vectors as v
from rigspark.operators import adjustment, calibration, cameras
from rigspark.plans.board_queries import rig_points
from rigspark.plans.lens_queries import LENS
from rigspark.sources import synthetic


def test_rays_and_slopes():
    p = np.random.default_rng(1).uniform(-0.7, 0.7, (200, 3)) * [1, 1, 0] + [0, 0, 1.5]
    seen = lenses.project_points(p, LENS)
    back = lenses.unproject_points(seen, LENS)
    assert np.abs(back - p / p[:, 2:]).max() < 1e-9
    h, slope = 1e-6, lenses.projection_jacobian(p, LENS)
    for k in range(3):
        d = h * np.eye(3)[k]
        assert np.allclose((lenses.project_points(p + d, LENS) - lenses.project_points(p - d, LENS)) / (2 * h), slope[:, :, k], atol=1e-3)
    with pytest.raises(ValueError):
        lenses.coefficients((1.0, 1.0))


def test_a_lens_that_folds_over_sees_no_point_twice(spark):
    """Beyond the fold the pixel comes back into the image, but does not look at the point."""
    bent = (500.0, 500.0, 500.0, 500.0, -0.3, 0.0)
    rows = spark.createDataFrame([(0, 0.2, 0.1, 1.0), (1, 1.75, 0.1, 1.0), (2, 0.2, 0.1, -1.0), (3, 5.0, 0.0, 1.0), (4, 0.0, 0.0, 0.0)], "k int, x double, y double, z double")
    got = {r["k"]: r["seen"] for r in rows.select("k", lenses.in_view(v.vec(), bent, 1001, 1001).alias("seen")).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False}


def test_rays_of_columns_are_those_of_arrays(spark):
    """Newton's steps run over arrays, also with a lens by row; a null pixel has no ray."""
    p = np.random.default_rng(1).uniform(-0.7, 0.7, (100, 3)) * [1, 1, 0] + [0, 0, 1.5]
    seen = lenses.project_points(p, LENS)
    rows = spark.createDataFrame([*((k, *map(float, q), *LENS) for k, q in enumerate(seen)), (100, None, 1.0, *LENS)], "k int, u double, v double, " + ", ".join(f"c{i} double" for i in range(16)))
    for lens in (LENS, [F.col(f"c{i}") for i in range(16)], [*LENS[:4], F.col("c4"), *LENS[5:]]):
        x, y, _ = lenses.unproject(F.col("u"), F.col("v"), lens)
        found = rows.select("k", x.alias("x"), y.alias("y"))
        assert "aggregate(" not in found._jdf.queryExecution().analyzed().toString()
        got = {r["k"]: (r["x"], r["y"]) for r in found.collect()}
        assert got.pop(100) == (None, None) and np.allclose([got[k] for k in range(100)], lenses.unproject_points(seen, LENS)[:, :2], rtol=0, atol=1e-12)


@pytest.mark.parametrize("tilt", [0.0, 0.6, 1.0, -0.8])
@pytest.mark.parametrize("lens", [(700.0, 700.0, 600.0, 500.0), LENS])
def test_oblique_boards_never_take_the_mirror_pose(tilt, lens):
    rng = np.random.default_rng(3)
    i, j = np.divmod(np.arange(64), 8)
    flat = np.stack([j * 0.05, i * 0.05, np.zeros(64)], 1)
    for far in (1.0, 2.0):
        pose = np.array([tilt, tilt / 2, 0.3, -0.1, -0.1, far])
        seen = lenses.project_points(flat @ poses.matrix(pose[:3]).T + pose[3:], lens) + rng.normal(0, 0.3, (64, 2))
        found = cameras.board_pose(flat, seen, lens)
        turned = poses.matrix(found[:3])[:, 2] @ poses.matrix(pose[:3])[:, 2]
        assert turned > 0.98 and np.abs(found[3:] - pose[3:]).max() < 0.05 * far
    assert cameras.board_pose(flat[:3], seen[:3], lens) is None


def test_ellipsoids_of_any_shape(spark):
    rng = np.random.default_rng(5)
    turn = poses.matrix(rng.normal(0, 1, 3))
    shapes = [np.diag([9.0, 4.0, 1.0]), np.eye(3), np.zeros((3, 3)), np.diag([4.0, 4.0, 1.0]), np.diag([9.0, 1.0, 1.0]), np.diag([1e-8, 2e-8, 3e-8])]
    rows = [(k, *(float((turn @ m @ turn.T)[i, j]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))) for k, m in enumerate(shapes)]
    table = spark.createDataFrame(rows, "k int, cxx double, cxy double, cxz double, cyy double, cyz double, czz double")
    for r in calibration.ellipsoid_axes(table).collect():
        frame = np.array([[r[f"a{n}{c}"] for c in "xyz"] for n in (1, 2, 3)])
        sizes = np.array([r["s1"], r["s2"], r["s3"]])
        m = turn @ shapes[r["k"]] @ turn.T
        assert np.allclose(frame @ frame.T, np.eye(3), atol=1e-6) and np.linalg.det(frame) > 0
        assert np.allclose(frame.T @ np.diag(sizes**2) @ frame, m, atol=2e-6 * max(np.abs(m).max(), 1e-8))


def test_uncertainty_by_place_is_that_of_the_poses(spark):
    found = calibration.calibrate(rig_points(spark, snapshots=8, points=20, sigma=0.01))
    grid = spark.createDataFrame([(0, 0, 3.0, -2.0, 0.5)], "i int, j int, x double, y double, z double")
    row = calibration.uncertainty_map(grid, found, 0, 2).first()
    m = calibration.transform_covariance(found, 0, 2, np.array([3.0, -2.0, 0.5]))
    values, vectors = np.linalg.eigh(m)
    assert np.allclose(np.sqrt(values[::-1]), [row["ax"], row["ay"], row["az"]], rtol=1e-4)
    assert abs(vectors[:, 2] @ [row["dx"], row["dy"], row["dz"]]) > 0.9999


def test_replays_spread_as_the_covariance_says(spark):
    """40 replays take about the jobs of one solve."""
    points = rig_points(spark, snapshots=10, points=20, sigma=0.0)
    first = calibration.calibrate(points)
    jobs = []
    run = adjustment._equations
    adjustment._equations = lambda *a: jobs.append(1) or run(*a)
    try:
        replays = calibration.replayed(points, first, 40)
    finally:
        adjustment._equations = run
    assert len(jobs) <= 20
    spread = {(r["i"], r["j"]): r["value"] for r in calibration.replay_covariance(replays).collect()}
    ratio = [np.sqrt(spread[k, k] / first.covariance[k, k]) for k in range(len(first.covariance))]
    assert len(spread) == len(first.covariance) ** 2 and 0.6 < min(ratio) and max(ratio) < 1.6
    again = calibration.replayed(points.repartition(3), first, 3)
    few = replays.where("replay <= 3 and sensor = 1").orderBy("replay").collect()
    assert np.allclose([r["tx"] for r in few], [r["tx"] for r in again.where("sensor = 1").orderBy("replay").collect()], atol=1e-5)


def test_sensors_with_too_few_boards_are_named(spark):
    points = rig_points(spark)
    with pytest.raises(ValueError, match="lidar front has 0"):
        calibration.calibrate(points, seed=np.concatenate([synthetic.rig()[0], np.zeros((1, 6))]), sensors=4, names={3: "front"})


def test_one_bad_snapshot_is_rejected(spark):
    moved = rig_points(spark, sigma=0.005).withColumn("x", F.col("x") + F.when((F.col("snapshot") == 3) & (F.col("sensor") == 1), 1.0).otherwise(0.0))
    found = calibration.calibrate(moved)
    assert sorted(r["snapshot"] for r in found.boards.select("snapshot").collect()) == [k for k in range(12) if k != 3]
    assert np.abs(found.sensors - synthetic.rig()[0]).max() < 0.01


def test_a_lidar_that_sees_the_board_aside_is_rejected(spark):
    """In its plane, but metres from where the cameras see it."""
    truth, rows = synthetic.camera_rig()
    table = spark.createDataFrame(rows, "snapshot int, sensor int, x double, y double, z double, u double, v double")
    boards = {r["snapshot"]: r["board"] for r in calibration.calibrate(table, synthetic.LENSES).boards.collect()}
    aside = poses.matrix(np.array(boards[4][:3]))[:, 0] * 2
    hit = (F.col("snapshot") == 4) & (F.col("sensor") == 0)
    moved = table.withColumns({c: F.col(c) + F.when(hit, float(d)).otherwise(0.0) for c, d in zip("xyz", aside, strict=True)})
    found = calibration.calibrate(moved, synthetic.LENSES)
    assert 4 not in {r["snapshot"] for r in found.boards.collect()} and np.abs(found.sensors - truth).max() < 1e-4
