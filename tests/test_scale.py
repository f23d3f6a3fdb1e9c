"""Work and memory of large tables, on small ones."""

import tracemalloc

import numpy as np

from rigspark.functions import lenses, poses
from rigspark.operators import adjustment, calibration, cameras
from rigspark.plans.board_queries import rig_points
from rigspark.plans.lens_queries import LENS


def test_replays_start_from_the_solution_with_ranges(spark):
    """a solution needs no solve by planes first."""
    points = rig_points(spark, snapshots=8, points=12, sigma=0.01)
    first = calibration.calibrate(points)
    kinds = []
    run = adjustment._equations
    adjustment._equations = lambda data, trials, lens, by_range, noise: kinds.append(by_range) or run(data, trials, lens, by_range, noise)
    try:
        found = calibration.replayed(points, first, 3).collect()
    finally:
        adjustment._equations = run
    assert len(found) == 9 and set(kinds) == {True} and len(kinds) < 10


def _batch(boards, each, rng):
    sensors = np.array([np.zeros(6), [0.1, -0.2, 0.3, 0.4, -0.6, 0.2]])
    seeds = np.concatenate([rng.normal(0, 0.3, (boards, 3)), rng.normal(0, 0.2, (boards, 3)) + [0, 0, 4]], 1)
    of, sensor = np.repeat(np.arange(boards), 2 * each), np.tile(np.repeat([0, 1], each), boards)
    flat = rng.uniform(-0.3, 0.3, (len(of), 3)) * [1, 1, 0]
    world = np.einsum("nij,nj->ni", adjustment.matrices(seeds[of, :3]), flat) + seeds[of, 3:]
    p = np.einsum("nji,nj->ni", adjustment.matrices(sensors[sensor, :3]), world - sensors[sensor, 3:])
    return adjustment.Snapshots(np.arange(boards), of, sensor, p, np.zeros((len(of), 2)), seeds, np.full(boards, 2 * each)), sensors


def test_a_batch_needs_little_memory():
    """of a full batch, derivatives by both poses are kept by board and sensor, not by point."""
    each = 16
    data, sensors = _batch(adjustment.BATCH_POINTS // (2 * each), each, np.random.default_rng(2))
    tracemalloc.start()
    try:
        model = adjustment.Model(data, sensors, {}, True)
        share = model.reduced(*model.solved(data.seeds + 0.001))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60e6 and np.isfinite(share).all()


def test_boards_seen_edge_on_keep_their_weights():
    """of many boards a few are seen edge on; rounding loses their regularisation, and their equations have no full rank."""
    rng, each = np.random.default_rng(6), 8
    data, sensors = _batch(400, each, rng)
    ahead = data.seeds[:, 3:] / np.linalg.norm(data.seeds[:, 3:], axis=1)[:, None]
    across = np.cross(ahead, [1.0, 0.0, 0.0])
    normal = across / np.linalg.norm(across, axis=1)[:, None] + 10.0 ** rng.uniform(-3, -2, (400, 1)) * ahead
    normal /= np.linalg.norm(normal, axis=1)[:, None]
    data.seeds[:, :3] = np.array([poses.rodrigues(poses.aligning(n)) for n in normal])
    local = rng.uniform(-0.3, 0.3, (len(data.of), 3)) * [1, 1, 0]
    world = np.einsum("nij,nj->ni", adjustment.matrices(data.seeds[data.of, :3]), local) + data.seeds[data.of, 3:]
    data.p[:] = np.einsum("nji,nj->ni", adjustment.matrices(sensors[data.sensor, :3]), world - sensors[data.sensor, 3:])
    model = adjustment.Model(data, sensors, {}, True)
    share = model.reduced(*model.solved(data.seeds))
    h = share[:144].reshape(12, 12)
    assert np.isfinite(share).all() and np.linalg.eigvalsh((h + h.T) / 2)[0] > -1e-12 * np.abs(h).max()


def test_eliminated_boards_explain_what_they_see():
    """for derivatives of one direction only, all of it is the board's."""
    seen = np.full((6, 1), 1e8)
    h = np.diag(adjustment.WEIGHTS**2) + seen @ seen.T
    assert np.linalg.matrix_rank(h) == 1
    assert np.allclose(seen.T @ adjustment._solve_held(h[None], seen[None])[0], 1)


def test_sums_by_run_are_those_of_the_points():
    """normal equations from the runs are those of the derivatives point by point."""
    data, sensors = _batch(5, 6, np.random.default_rng(3))
    boards = data.seeds + 0.01
    for by_range in (False, True):
        model = adjustment.Model(data, sensors, {}, by_range)
        e, rows, js, jb = model.at(boards)
        cost, h, g = model._own(model.summed(boards), boards)
        held = adjustment.WEIGHTS * boards
        for k in range(5):
            own = data.of[rows] == k
            assert np.isclose(cost[k], e[own] @ e[own] + held[k] @ held[k])
            assert np.allclose(h[k], jb[own].T @ jb[own] + np.diag(adjustment.WEIGHTS**2)) and np.allclose(g[k], jb[own].T @ e[own] + adjustment.WEIGHTS * held[k])


def test_boards_are_solved_side_by_side():
    """poses of many boards at once, one of them never seen, are those of each by itself."""
    rng = np.random.default_rng(4)
    i, j = np.divmod(np.arange(16), 4)
    flat = np.tile(np.stack([j * 0.15, i * 0.15, np.zeros(16)], 1), (9, 1, 1))
    truth = np.concatenate([rng.normal(0, 0.4, (9, 3)), rng.normal(0, 0.2, (9, 2)), rng.uniform(1, 3, (9, 1))], 1)
    seen = np.stack([lenses.project_points(f @ poses.matrix(p[:3]).T + p[3:], LENS) for f, p in zip(flat, truth, strict=True)])
    seen[5] = np.nan
    found = cameras.board_poses(flat, seen, LENS)
    assert np.isnan(found[5]).all() and cameras.board_pose(flat[5], seen[5], LENS) is None
    left = np.arange(9) != 5
    assert np.abs(found - truth)[left].max() < 1e-6
    assert all(np.allclose(found[k], cameras.board_pose(flat[k], seen[k], LENS), atol=1e-9) for k in np.flatnonzero(left))
