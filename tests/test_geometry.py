"""Poses, boards and calibration against known truth."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rigspark.functions import poses
from rigspark.operators import adjustment, calibration, segmentation
from rigspark.operators.parameters import SegmentationParameters
from rigspark.plans.board_queries import rig_points
from rigspark.sources import synthetic

small = st.floats(-1.5, 1.5, allow_nan=False)
pose = st.tuples(*[small] * 6).map(np.array)


@settings(max_examples=60, deadline=None)
@given(pose, pose)
def test_compose_and_inverse(a, b):
    assert np.allclose(poses.compose(a, poses.inverted(a)), 0, atol=1e-7)
    p = np.array([0.3, -1.0, 2.0])
    once = poses.matrix(a[:3]) @ (poses.matrix(b[:3]) @ p + b[3:]) + a[3:]
    both = poses.compose(a, b)
    assert np.allclose(poses.matrix(both[:3]) @ p + both[3:], once, atol=1e-6)
    assert poses.is_rotation(poses.matrix(a[:3]))


@pytest.mark.parametrize("by_range", [False, True])
def test_jacobian_by_differences(by_range):
    """Two snapshots, two lidars and a camera with a distorting lens."""
    rng = np.random.default_rng(0)
    sensors = np.array([np.zeros(6), rng.normal(0, 0.4, 6), [0.2, -0.1, 0.3, 0.1, 0.2, -2.0]])
    boards = np.array([[*rng.normal(0, 0.4, 3), 4, 0.2, 0.3], [*rng.normal(0, 0.4, 3), 3, -0.2, 1.0]])
    of, sensor = np.repeat([0, 1], 9), np.tile(np.repeat([0, 1, 2], 3), 2)
    p = np.where(sensor[:, None] < 2, rng.normal(0, 1, (18, 3)) + [3, 0, 0], rng.normal(0, 0.3, (18, 3)) * [1, 1, 0])
    data = adjustment.Snapshots(np.arange(2), of, sensor, p, rng.normal(500, 10, (18, 2)), boards, np.array([9, 9]))
    lenses = {2: (800.0, 810.0, 640.0, 480.0, -0.2, 0.05, 0.001, -0.0005, 0.01, 0.02, 0.01, -0.003, 1e-3, 2e-3, -1e-3, 5e-4)}
    at = lambda s, b: adjustment.Model(data, s, lenses, by_range).at(b)
    _, rows, js, jb = at(sensors, boards)
    h = 1e-6
    for k in range(6):
        for s in range(3):
            d = np.zeros((3, 6))
            d[s, k] = h
            slope = (at(sensors + d, boards)[0] - at(sensors - d, boards)[0]) / (2 * h)
            assert np.allclose(slope, np.where(sensor[rows] == s, js[:, k], 0), rtol=1e-4, atol=2e-2)
        for b in range(2):
            d = np.zeros((2, 6))
            d[b, k] = h
            slope = (at(sensors, boards + d)[0] - at(sensors, boards - d)[0]) / (2 * h)
            assert np.allclose(slope, np.where(of[rows] == b, jb[:, k], 0), rtol=1e-4, atol=2e-2)


def test_segmentation_finds_the_board(spark):
    centre, normal = (3.0, 0.3, 0.1), np.array([1.0, 0.2, 0.1])
    scans = {0: synthetic.board_scan(centre, normal), 1: synthetic.board_scan((12.0, 0, 0), (1.0, 0, 0)), 2: synthetic.board_scan((3.0, 0, 0), (1.0, 0, 0), size=0.05)}
    found = segmentation.segment_planes(synthetic.scans_table(spark, scans), SegmentationParameters(per_rotation=2048)).collect()
    assert [r["scan"] for r in found] == [0]
    got = np.array([found[0][c] for c in ("nx", "ny", "nz")])
    assert math.degrees(math.acos(min(1.0, abs(got @ normal) / np.linalg.norm(normal)))) < 0.1
    off = np.array([found[0][c] for c in ("px", "py", "pz")]) - centre
    assert abs(off @ got) < 0.005 and np.linalg.norm(off) < 0.2


def test_calibration_recovers_the_rig(spark):
    truth, _, _ = synthetic.rig()
    found = calibration.calibrate(rig_points(spark))
    assert np.abs(found.sensors - truth).max() < 1e-6
    noisy = calibration.calibrate(rig_points(spark, sigma=0.02))
    stdev = np.sqrt(np.diag(noisy.covariance))
    assert (np.abs(noisy.sensors[1:].ravel() - truth[1:].ravel()) < 6 * stdev).all()


def test_unreached_sensor_is_named(spark):
    rows = rig_points(spark).where("sensor <> 2 or snapshot = 0")
    with pytest.raises(ValueError, match=r"\[2\]"):
        calibration.calibrate(rows)


def test_board_pose():
    from rigspark.operators import cameras

    sensors, rows = synthetic.camera_rig()
    own = rows[(rows.snapshot == 1) & (rows.sensor == 2)]
    flat, seen, lens = own[["x", "y", "z"]].to_numpy(), own[["u", "v"]].to_numpy(), synthetic.LENSES[2]
    found = cameras.board_pose(flat, seen, lens)
    assert np.abs(cameras.project(flat @ poses.matrix(found[:3]).T + found[3:], lens) - seen).max() < 1e-6


def test_cameras_calibrate_with_lidars(spark):
    truth, rows = synthetic.camera_rig()
    table = spark.createDataFrame(rows, "snapshot int, sensor int, x double, y double, z double, u double, v double")
    found = calibration.calibrate(table, synthetic.LENSES)
    assert np.abs(found.sensors - truth).max() < 1e-5
