"""Board poses in cameras, from the image positions of the board's corners.

``corners(snapshot, sensor, x, y, z, u, v)``: a corner in the board's frame
(z = 0) and where the camera sees it.  Lenses are given by sensor, as
``functions.lenses`` has them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import poses
from ..functions.lenses import Lens, projection_jacobian, unproject_points
from ..functions.lenses import project_points as project
from .adjustment import left_jacobians, matrices

Intrinsics = dict[int, Lens]

_POSE = "snapshot long, sensor int, rx double, ry double, rz double, tx double, ty double, tz double, px double, py double, pz double, nx double, ny double, nz double, mx double, my double"


def _rodrigues(m: np.ndarray) -> np.ndarray:
    """``poses.rodrigues`` of each matrix."""
    w = np.stack([m[:, 2, 1] - m[:, 1, 2], m[:, 0, 2] - m[:, 2, 0], m[:, 1, 0] - m[:, 0, 1]], 1) / 2
    s, c = np.linalg.norm(w, axis=1), (np.trace(m, axis1=1, axis2=2) - 1) / 2
    out = w * np.where(s > 1e-6, np.arctan2(s, c) / np.where(s > 1e-6, s, 1.0), 1.0)[:, None]
    for k in np.flatnonzero((s <= 1e-6) & (c <= 0)):  # half turns are rare
        out[k] = poses.rodrigues(m[k])
    return out


def _homographies(flat: np.ndarray, rays: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Poses of flat boards from the rays of their good points, without regard to how exact each is."""
    count = good.sum(1)
    middle = (flat[:, :, :2] * good[:, :, None]).sum(1) / count[:, None]
    apart = (flat[:, :, :2] - middle[:, None]) * good[:, :, None]
    size = np.maximum(np.abs(apart).max((1, 2)), 1e-12)
    a = np.concatenate([apart / size[:, None, None], good[:, :, None]], 2)
    x, y = (np.where(good, rays[:, :, k], 0.0)[:, :, None] for k in (0, 1))
    zero = np.zeros_like(a)
    rows = np.concatenate([np.concatenate([a, zero, -a * x], 2), np.concatenate([zero, a, -a * y], 2)], 1)
    h = np.linalg.eigh(rows.transpose(0, 2, 1) @ rows)[1][:, :, 0].reshape(-1, 3, 3)
    back = np.zeros((len(flat), 3, 3))
    back[:, 0, 0] = back[:, 1, 1] = 1 / size
    back[:, :2, 2], back[:, 2, 2] = -middle / size[:, None], 1.0
    h = h @ back
    h = h * (2 / (np.linalg.norm(h[:, :, 0], axis=1) + np.linalg.norm(h[:, :, 1], axis=1)))[:, None, None]
    behind = (h[:, 2, :2] * middle).sum(1) + h[:, 2, 2] < 0  # the board is before the camera
    h = np.where(behind[:, None, None], -h, h)
    u, _, vt = np.linalg.svd(np.stack([h[:, :, 0], h[:, :, 1], np.cross(h[:, :, 0], h[:, :, 1])], 2))
    u[:, :, 2] *= np.linalg.det(u @ vt)[:, None]
    return np.concatenate([_rodrigues(u @ vt), h[:, :, 2]], 1)


def _mirrored(pose: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The other poses in which flat boards look much the same from afar: their normals mirrored at the line of sight."""
    m = matrices(pose[:, :3])
    middle = (m @ centre[:, :, None])[:, :, 0] + pose[:, 3:]
    sight = middle / np.linalg.norm(middle, axis=1)[:, None]
    normal = m[:, :, 2]
    other = 2 * (normal * sight).sum(1)[:, None] * sight - normal
    axis = np.cross(normal, other)
    size = np.linalg.norm(axis, axis=1)
    same = size < 1e-9
    turn = matrices(axis * (np.arctan2(size, (normal * other).sum(1)) / np.where(same, 1.0, size))[:, None]) @ m
    found = np.concatenate([_rodrigues(turn), middle - (turn @ centre[:, :, None])[:, :, 0]], 1)
    return np.where(same[:, None], pose, found)


def _ahead(pose: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The poses turned about the boards' centres, if need be, so that all points are before the camera."""
    p = flat @ matrices(pose[:, :3]).transpose(0, 2, 1) + pose[:, None, 3:]
    least, mean = p[:, :, 2].min(1), p.mean(1)
    near = np.stack([0 * least, 0 * least, 2 * np.abs(least) + 1e-3], 1)
    move = np.where((mean[:, 2] < 0)[:, None], -2 * mean, near)
    return np.concatenate([pose[:, :3], pose[:, 3:] + np.where((least > 0)[:, None], 0.0, move)], 1)


def _refined(pose: np.ndarray, flat: np.ndarray, seen: np.ndarray, lens: Lens, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean square errors in pixels and poses after damped Gauss-Newton steps; each board stops by itself."""
    boards, corners = flat.shape[:2]

    def errors(at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        turned = flat[k] @ matrices(at[:, :3]).transpose(0, 2, 1)
        p = turned + at[:, None, 3:]
        e = project(p.reshape(-1, 3), lens).reshape(-1, corners, 2) - seen[k]
        usable = (p[:, :, 2].min(1) > 0) & np.isfinite(e).all((1, 2))
        return turned, e, np.where(usable, (e * e).sum((1, 2)), np.inf)

    pose, damping = pose.copy(), np.full(boards, 1e-6)
    turned, e, cost = errors(pose, np.arange(boards))
    going = np.isfinite(cost)
    for _ in range(rounds):
        k = np.flatnonzero(going)
        if not len(k):
            break
        slope = projection_jacobian((turned[k] + pose[k, None, 3:]).reshape(-1, 3), lens).reshape(len(k), corners, 2, 3)
        j = np.concatenate([np.cross(turned[k][:, :, None], slope) @ left_jacobians(pose[k, :3])[:, None], slope], 3).reshape(len(k), -1, 6)
        back = j.transpose(0, 2, 1)
        h = back @ j
        damped = h + (damping[k, None] * np.einsum("nii->ni", h) + 1e-12)[:, :, None] * np.eye(6)
        step = np.linalg.solve(damped, back @ e[k].reshape(len(k), -1, 1))[:, :, 0]
        turned_, e_, cost_ = errors(pose[k] - step, k)
        worse = cost_ > cost[k]
        small = ~worse & ((np.abs(step).max(1) < 1e-12) | (cost[k] - cost_ <= 1e-14 * cost_))
        damping[k] *= np.where(worse, 10, 0.1)
        going[k] = ~small & ~(worse & (damping[k] > 1e6))
        taken = k[~worse]
        pose[taken] -= step[~worse]
        turned[taken], e[taken], cost[taken] = turned_[~worse], e_[~worse], cost_[~worse]
    return cost / corners, pose


#: Focal lengths, as shares of the lens's, from which a board's pose is sought.
LADDER = (1.0, 0.7, 1.5)
#: Steps of a candidate before the best one is chosen.
COARSE = 5
#: Mean square error in pixels below which no further candidate is tried.
FITS = 1.0
#: Corners that a task solves for at a time.
BATCH_CORNERS = 1 << 15


def board_poses(flat: np.ndarray, seen: np.ndarray, lens: Lens, rounds: int = 30) -> np.ndarray:
    """Poses of flat boards in the camera's frame, ``flat`` (boards, corners, 3) and ``seen`` (boards, corners, 2).

    Candidates are the homographies for the lens's focal length and for some
    others, each with its mirror pose, all before the camera; each is refined
    on the reprojection, and the one that fits best is taken, the first pair's
    if it fits well.  Points whose
    pixel the lens cannot look back from only take part in the refinement.
    Not a number if fewer than four can be looked back from, or no pose puts
    the board before the camera.
    """
    with np.errstate(all="ignore"):
        rays = unproject_points(seen.reshape(-1, 2), lens)[:, :2].reshape(seen.shape)
        good = np.isfinite(rays).all(2)
        best, found = np.full(len(flat), np.inf), np.full((len(flat), 6), np.nan)
        usable = (good.sum(1) >= 4) & np.isfinite(flat).all((1, 2))
        for share in LADDER:
            k = np.flatnonzero(usable & (best >= FITS))
            if not len(k):
                break
            first = _homographies(flat[k], rays[k] / share, good[k])
            for start in (first, _mirrored(first, (flat[k].min(1) + flat[k].max(1)) / 2)):
                cost, pose = _refined(_ahead(start, flat[k]), flat[k], seen[k], lens, COARSE)
                better = cost < best[k]
                best[k[better]], found[k[better]] = cost[better], pose[better]
        k = np.flatnonzero(np.isfinite(best))
        if len(k):
            found[k] = _refined(found[k], flat[k], seen[k], lens, rounds)[1]
    return found


def board_pose(flat: np.ndarray, seen: np.ndarray, lens: Lens, rounds: int = 30) -> np.ndarray | None:
    """``board_poses`` of one board; None if there is no pose."""
    found = board_poses(flat[None], seen[None], lens, rounds)[0]
    return found if np.isfinite(found).all() else None


def boards_in_cameras(corners: DataFrame, lenses: Intrinsics) -> DataFrame:
    """Board pose, centre and normal (away from the camera) for each snapshot and camera that sees it, and ``mx, my``, the centre in the board's frame.

    A task solves boards of one camera and number of corners side by side.
    """
    names = [c.split()[0] for c in _POSE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            snapshot, sensor = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            lists = batch.column(2)
            first, sizes = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py(), np.diff(np.asarray(lists.offsets))
            whole = np.stack([x.to_numpy(zero_copy_only=False).astype(float) for x in lists.flatten().flatten()], 1)
            for s, n in {*zip(sensor.tolist(), sizes.tolist(), strict=True)}:
                rows, most = np.flatnonzero((sensor == s) & (sizes == n)), max(1, BATCH_CORNERS // n)
                for k in (rows[i : i + most] for i in range(0, len(rows), most)):
                    p = whole[first[k][:, None] + np.arange(n)]
                    flat = p[:, :, :3]
                    pose = board_poses(flat, p[:, :, 3:], lenses[s])
                    m, middle = matrices(pose[:, :3]), (flat.min(1) + flat.max(1)) / 2
                    centre = (m @ middle[:, :, None])[:, :, 0] + pose[:, 3:]
                    normal = np.where(((m[:, :, 2] * centre).sum(1) > 0)[:, None], m[:, :, 2], -m[:, :, 2])
                    there = np.isfinite(pose).all(1)
                    numbers = np.concatenate([pose, centre, normal, middle[:, :2]], 1)[there].T
                    yield pa.RecordBatch.from_arrays([pa.array(snapshot[k][there].astype(np.int64)), pa.array(np.full(there.sum(), s, np.int32)), *map(pa.array, numbers)], names=names)

    boards = corners.groupBy("snapshot", "sensor").agg(F.array_sort(F.collect_list(F.struct(*"xyzuv"))).alias("p"))
    return boards.mapInArrow(run, _POSE)
