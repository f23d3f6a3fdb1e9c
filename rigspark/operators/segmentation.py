"""Planar boards in scans.

Straight ring pieces and seed planes are relational (``scans``).  Growing a
cluster from its seed depends on what earlier clusters took, so it runs by
scan over the scan's few thousand segments; refining reads the scan's ordered
points the same way.  A scan is one turn of one sensor: its size does not grow
with the log, and scans are dealt over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch
from . import scans
from .parameters import SegmentationParameters

DEFAULT = SegmentationParameters()
TURN_STEP = 6
COS_TURN = math.cos(math.radians(10))

_CLUSTER = "scan long, cluster int, ring int, cell0 int, cell1 int, first long, last long, px double, py double, pz double, nx double, ny double, nz double"
_PLANE = "scan long, plane int, n_points int, px double, py double, pz double, nx double, ny double, nz double, rms double, points array<long>"


def fit_plane(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, unit normal, and ascending eigenvalues of the scatter."""
    mean = points.mean(0)
    values, vectors = np.linalg.eigh((points - mean).T @ (points - mean))
    return mean, vectors[:, 0], values


class _Growth:
    """Clusters of one scan's segments."""

    def __init__(self, rows: pd.DataFrame, cells: int, par: SegmentationParameters) -> None:
        self.par, self.cells, self.taken = par, cells, set()
        self.at = {(int(r), int(c)): i for i, (r, c) in enumerate(zip(rows.ring, rows.cell, strict=True))}
        self.p, self.v = rows[["px", "py", "pz"]].to_numpy(), rows[["vx", "vy", "vz"]].to_numpy()
        self.a, self.b = rows[["ax", "ay", "az"]].to_numpy(), rows[["bx", "by", "bz"]].to_numpy()
        self.seed_p, self.seed_n = rows[["cx", "cy", "cz"]].to_numpy(), rows[["sx", "sy", "sz"]].to_numpy()
        self.first, self.last = rows["first"].to_numpy(), rows["last"].to_numpy()

    def fits(self, i: int) -> bool:
        n, v, off = self.normal, self.v[i], self.p[i] - self.centre
        across = (n @ v) ** 2 < self.par.max_cos_normal**2 * (n @ n) * (v @ v)
        return bool(across and (off @ n) ** 2 < self.par.max_error_grow**2 * (n @ n))

    def admits(self, i: int) -> bool:
        """The segment fits the plane, or a plane fitted anew with it that all members fit too."""
        if self.fits(i):
            return True
        old = self.centre, self.normal
        among = [*self.members, i]
        self.centre, self.normal, _ = fit_plane(np.concatenate([self.a[among], self.b[among]]))
        if all(self.fits(k) for k in (i, *self.members)):
            return True
        self.centre, self.normal = old
        return False

    def free(self, ring: int, cell: int) -> int | None:
        i = self.at.get((ring, cell % self.cells))
        return None if i is None or i in self.taken else i

    def take(self, i: int) -> None:
        self.taken.add(i)
        self.members.append(i)

    def along(self, ring: int, cell: int, step: int) -> int:
        """Extend in the ring from a member; the last cell reached."""
        start, now = cell, self.at[ring, cell % self.cells]
        while (i := self.free(ring, cell + step)) is not None:
            gap = self.a[i] - self.b[now] if step > 0 else self.b[i] - self.a[now]
            turn = self.v[now] @ self.v[i]
            straight = turn**2 >= self.par.min_cos_same_in_ring**2 * (self.v[now] @ self.v[now]) * (self.v[i] @ self.v[i])
            if gap @ gap > self.par.max_across_cells**2 or not straight or not self.admits(i):
                break
            self.take(i)
            now, cell = i, cell + step
            if abs(cell - start) >= self.cells:
                break
        return cell

    def upward(self, ring: int, left: int, right: int) -> int | None:
        """The nearest cell to the middle of left..right that goes on in the next ring; of two, the right one."""
        middle = left + (right - left + 1) // 2
        reach = [None, None]
        for side, order in enumerate((range(middle, left - 1, -1), range(middle + 1, right + 1))):
            for cell in order:
                i, below = self.free(ring + 1, cell), self.at[ring, cell % self.cells]
                if i is not None and (d := self.p[i] - self.p[below]) @ d <= self.par.max_across_rings**2 and self.admits(i):
                    reach[side] = cell
                    break
        low, high = reach
        if low is None or high is None:
            return high if low is None else low
        return low if middle - low < high - middle else high

    def grow(self, ring: int, cell: int) -> list[tuple[int, int, int]]:
        """Rows (ring, left, right) of the cluster from a seed."""
        self.members: list[int] = []
        self.take(self.at[ring, cell])
        rows, at = [], cell
        while True:
            left = self.along(ring, at, -1)
            right = self.along(ring, at, 1)
            rows.append((ring, left, right))
            at = self.upward(ring, left, right)
            if at is None:
                return rows
            ring += 1
            self.take(self.at[ring, at % self.cells])

    def clusters(self) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]]:
        par = self.par
        found = 0
        for (ring, cell), i in sorted(self.at.items()):
            if found == par.max_clusters:
                return
            if i in self.taken or self.free(ring + 1, cell) is None or np.isnan(self.seed_n[i, 0]):
                continue
            self.centre, self.normal = self.seed_p[i], self.seed_n[i]
            rows = self.grow(ring, cell)
            if len(self.members) == 2:  # the seed pair alone: its upper segment may serve another seed
                self.taken.discard(self.members[1])
                continue
            if not par.min_segments <= len(self.members) <= par.max_segments or len(rows) < par.min_rings:
                continue
            if (self.p[self.members] ** 2).sum(1).min() >= par.max_range**2:
                continue
            p, n, _ = fit_plane(np.concatenate([self.a[self.members], self.b[self.members]]))
            if (p @ n) ** 2 < par.min_cos_tilt**2 * (p @ p):
                continue
            found += 1
            yield rows, p, n


def clusters(segments: DataFrame, per_rotation: int, par: SegmentationParameters = DEFAULT) -> DataFrame:
    """Clusters of segments: a row for each ring of each, with its cells, points and the cluster's plane."""
    seeds = scans.adjacent_pairs(segments, par).select("scan", "ring", "cell", "cx", "cy", "cz", *(F.col(f"n{c}").alias(f"s{c}") for c in "xyz"))
    cells = per_rotation // par.points_per_segment

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        g, out = _Growth(rows, cells, par), []
        for k, (lines, p, n) in enumerate(g.clusters()):
            for ring, left, right in lines:
                a, b = g.at[ring, left % cells], g.at[ring, right % cells]
                out.append((rows.scan.iloc[0], k, ring, left % cells, right % cells, g.first[a], g.last[b], *p, *n))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _CLUSTER.split(", ")])

    return segments.join(seeds, ["scan", "ring", "cell"], "left").groupBy("scan").applyInPandas(run, _CLUSTER)


def _walk(xyz: np.ndarray, az: np.ndarray, start: int, step: int, visited: np.ndarray, p: np.ndarray, n: np.ndarray, per_rotation: int, par: SegmentationParameters) -> list[int]:
    """Points of one ring that continue the plane from ``start`` in one direction."""
    size, got, last, turn = len(xyz), [], None, None
    for k in range(size):
        i = (start + k * step) % size
        if visited[i]:
            break
        gap = None
        if last is not None:
            gap = int(0.5 + (step * (az[i] - last)) % (2 * math.pi) * per_rotation / (2 * math.pi))
            if gap >= par.max_gap_refine:
                break
        if abs((xyz[i] - p) @ n) > par.max_error_refine:
            continue
        behind = (i - TURN_STEP * step) % size
        if k >= TURN_STEP and visited[behind] and gap is not None:
            d = xyz[i] - xyz[behind]
            if turn is not None:
                least = 1 + gap * gap * (COS_TURN - 1)
                if least * least * (d @ d) * (turn @ turn) > (d @ turn) ** 2:
                    continue
            turn = d
        visited[i] = True
        got.append(i)
        last = az[i]
    return got


def _refined(points: pd.DataFrame, found: pd.DataFrame, per_rotation: int, par: SegmentationParameters) -> Iterator[tuple]:
    points = points.sort_values(["ring", "in_ring"])
    rings = {int(r): (g[["x", "y", "z"]].to_numpy(), g["az"].to_numpy(), g["point_idx"].to_numpy(), np.zeros(len(g), bool)) for r, g in points.groupby("ring")}
    planes = 0
    for _, rows in found.sort_values(["cluster", "ring"]).groupby("cluster"):
        p, n = rows[["px", "py", "pz"]].to_numpy()[0], rows[["nx", "ny", "nz"]].to_numpy()[0]
        xyz, names, enough = [], [], True
        for ring, first, last in zip(rows.ring, rows["first"], rows["last"], strict=True):
            own, az, idx, visited = rings[int(ring)]
            middle = int(first + ((last - first) % len(own) + 1) // 2) % len(own)
            got = _walk(own, az, middle, 1, visited, p, n, per_rotation, par) + _walk(own, az, (middle - 1) % len(own), -1, visited, p, n, per_rotation, par)
            xyz.append(own[got])
            names += idx[got].tolist()
            if len(got) < par.min_per_ring_multiple * par.points_per_segment:
                enough = False
                break
        if not enough or not names:
            continue
        cloud = np.concatenate(xyz)
        p, n, values = fit_plane(cloud)
        size = len(cloud)
        thick = values[0] > par.max_rms**2 * size
        thin = values[1] < (par.min_second_rms_multiple * par.max_plane_size) ** 2 * size
        wide = 4 * ((cloud - p) ** 2).sum(1).max() > par.max_plane_size**2
        if thick or thin or wide:
            continue
        if planes == par.max_planes:
            return
        n = -n if p @ n < 0 else n
        yield planes, size, *p, *n, float(np.sqrt(max(values[0], 0) / size)), names
        planes += 1


def segment_planes(points: DataFrame, par: SegmentationParameters = DEFAULT) -> DataFrame:
    """Boards of every scan: ``(scan, plane, n_points, p, n, rms, points)``; a scan without any has no row.

    ``points(scan, ring, point_idx, x, y, z)``.  ``par.per_rotation`` 0 infers
    the spacing from the scans and takes the commonest for all of them.  The
    straight pieces, a few for each ring, are written once: seeds and growth
    both read them.
    """
    per_rotation = par.per_rotation
    if not per_rotation:
        summary = scans.scan_summary(points).groupBy("per_rotation").count().orderBy(F.desc("count"), "per_rotation").first()
        per_rotation = int(summary["per_rotation"]) if summary and summary["per_rotation"] else par.points_per_segment
    with Scratch(points.sparkSession) as scratch:
        segments = scratch.stored(scans.stage1_segments(points, per_rotation, par), "segments")
        found = clusters(segments, per_rotation, par)

    def run(cloud: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in _PLANE.split(", ")]
        if not len(found) or not len(cloud):
            return pd.DataFrame([], columns=names)
        return pd.DataFrame([(cloud.scan.iloc[0], *row) for row in _refined(cloud, found, per_rotation, par)], columns=names)

    rows = scans.ordered(points).select("scan", "ring", "in_ring", "az", "point_idx", *"xyz")
    return rows.groupBy("scan").cogroup(found.groupBy("scan")).applyInPandas(run, _PLANE)


def observed_boards(planes: DataFrame) -> DataFrame:
    """Scans with exactly one board; with none or several, the board is unobserved."""
    one = planes.groupBy("scan").agg(F.count("*").alias("c")).where("c = 1").select("scan")
    return planes.join(one, "scan")
