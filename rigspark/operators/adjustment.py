"""Least-squares poses of a rig, with the boards' poses solved where their points are.

For given poses of the sensors each snapshot's board has a best pose of its
own, which a task finds by a few steps from the board's seed.  What is left is
a problem in the sensors' poses alone: a snapshot's share of its normal
equations has the board eliminated by its Schur complement, and Spark sums the
shares.  The driver keeps the sensors' poses and takes a dogleg step between
steepest descent and Gauss-Newton inside a trust radius.

A trial is one job over the stored snapshots, without a shuffle of points and
without a table of boards: it gives the cost there and, if the step is taken,
the next equations; a refused step only shrinks the radius, as the old
equations still hold.  Replays of the solve with fresh noise are solved side by
side: a task draws the noise of each replay where the points are, and all
replays take their step in the same job.  What the driver holds grows with
replays times the square of the sensors' number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lenses import Lens, project_points, projection_jacobian
from ..functions.poses import skews
from .residuals import REGULAR_R, REGULAR_T, SIGMA_M, SIGMA_PX

#: Points that a task holds as arrays at a time; its memory follows from these, not from the table.
BATCH_POINTS = 1 << 15
#: Steps of a board's own solve.
INNER = 10
#: Least damping of these steps; equations that rounding leaves without full rank can still be solved with it.
LEAST_DAMPING = 1e-12
WEIGHTS = np.array([REGULAR_R] * 3 + [REGULAR_T] * 3)


# ---- rotations of many vectors at once


def matrices(r: np.ndarray) -> np.ndarray:
    """Rotation matrices of Rodrigues vectors."""
    k = skews(r)
    theta = np.linalg.norm(r, axis=1)[:, None, None]
    small = theta < 1e-4
    t = np.where(small, 1.0, theta)
    a, b = np.where(small, 1 - theta**2 / 6, np.sin(t) / t), np.where(small, 0.5 - theta**2 / 24, (1 - np.cos(t)) / t**2)
    return np.eye(3) + a * k + b * (k @ k)


def left_jacobians(r: np.ndarray) -> np.ndarray:
    """J with d(R(r) p)/dr = -[R p]x J(r)."""
    k = skews(r)
    theta = np.linalg.norm(r, axis=1)[:, None, None]
    small = theta < 1e-4
    t = np.where(small, 1.0, theta)
    a, b = np.where(small, 0.5 - theta**2 / 24, (1 - np.cos(t)) / t**2), np.where(small, 1 / 6 - theta**2 / 120, (t - np.sin(t)) / t**3)
    return np.eye(3) + a * k + b * (k @ k)


def _times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.einsum("nij,nj->ni", m, v)


# ---- a batch of snapshots


@dataclass
class Snapshots:
    """Points of some snapshots, in order of snapshot and sensor: which of each, places, pixels; and the boards' seeds."""

    names: np.ndarray
    of: np.ndarray
    sensor: np.ndarray
    p: np.ndarray
    uv: np.ndarray
    seeds: np.ndarray
    sizes: np.ndarray

    def noisy(self, seed: int, replay: int, sigma_m: float, sigma_px: float, cameras: list[int]) -> Snapshots:
        """With noise along rays and on pixels that depends on the replay and the snapshot only; replay 0 has none."""
        if replay == 0:
            return self
        draws = np.concatenate([np.random.default_rng([seed, replay, crc32(str(name).encode())]).standard_normal((n, 3)) for name, n in zip(self.names.tolist(), self.sizes.tolist(), strict=True)])
        camera = np.isin(self.sensor, cameras)
        k = np.where(camera, 1.0, 1 + sigma_m * draws[:, 0] / np.linalg.norm(np.where(camera[:, None], 1.0, self.p), axis=1))
        return Snapshots(self.names, self.of, self.sensor, self.p * k[:, None], self.uv + sigma_px * draws[:, 1:], self.seeds, self.sizes)


@dataclass
class Part:
    """Points of one kind of sensor: which rows, where each run of one snapshot and sensor begins, and the run's snapshot and sensor."""

    rows: np.ndarray
    begin: np.ndarray
    of: np.ndarray
    own: np.ndarray
    run: np.ndarray


def _part(data: Snapshots, rows: np.ndarray) -> Part:
    of, own = data.of[rows], data.sensor[rows]
    begin = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (own[1:] != own[:-1])])
    return Part(rows, begin, of[begin], own[begin], np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(rows)])))


class Model:
    """Residuals of a batch and their derivatives, in standard deviations.

    A lidar's points see of the poses only the board's plane in its frame, four
    numbers, and a camera's corners only the board's pose in its frame, six.
    Sums over points are of derivatives by these, and each run of points of one
    snapshot and sensor takes its sums on to the derivatives by both poses.
    """

    def __init__(self, data: Snapshots, sensors: np.ndarray, lenses: dict[int, Lens], by_range: bool) -> None:
        self.data, self.sensors, self.lenses, self.by_range = data, sensors, lenses, by_range
        self.turns, self.jacobians = matrices(sensors[:, :3]), left_jacobians(sensors[:, :3])
        camera = np.isin(data.sensor, list(lenses))
        self.parts: list[tuple[int | None, Part]] = []
        for s, rows in [(None, np.flatnonzero(~camera)), *((s, np.flatnonzero(data.sensor == s)) for s in np.unique(data.sensor[camera]).tolist())]:
            if len(rows):
                self.parts.append((s, _part(data, rows)))
        self.places = [np.ascontiguousarray(data.p[part.rows].T) for _, part in self.parts]
        self.spans = [np.sqrt((p * p).sum(0)) if s is None else None for (s, _), p in zip(self.parts, self.places, strict=True)]

    def _lidars(self, k: int, boards: np.ndarray, turn: np.ndarray, jb: np.ndarray) -> tuple:
        """Errors and their derivatives by the plane in the lidar's frame, and that plane's by both poses."""
        part, p, span = self.parts[k][1], self.places[k], self.spans[k]
        n, dn = turn[:, :, 2][part.of], (-(skews(turn[:, :, 2]) @ jb))[part.of]
        back, apart = self.turns[part.own].transpose(0, 2, 1), boards[part.of, 3:] - self.sensors[part.own, 3:]
        m, ahead = _times(back, n), (n * apart).sum(1)
        by_sensor, by_board = np.zeros((len(n), 4, 6)), np.zeros((len(n), 4, 6))
        by_sensor[:, :3, :3], by_sensor[:, 3, 3:] = skews(m) @ back @ self.jacobians[part.own], -n
        by_board[:, :3, :3], by_board[:, 3, :3], by_board[:, 3, 3:] = back @ dn, np.einsum("ni,nij->nj", apart, dn), n
        x, y, z = (m.T)[:, part.run]
        b, far = x * p[0] + y * p[1] + z * p[2], ahead[part.run]
        if self.by_range:
            b = np.where(np.abs(b) > 1e-9, b, 1e-9)
            gain = span / (b * SIGMA_M)
            e, w, by_far = span / SIGMA_M - gain * far, gain * far / b, -gain
        else:
            e, w, by_far = (far - b) / SIGMA_M, np.full(len(b), -1 / SIGMA_M), np.full(len(b), 1 / SIGMA_M)
        return [(e, [w * p[0], w * p[1], w * p[2], by_far])], by_sensor, by_board

    def _camera(self, k: int, boards: np.ndarray, turn: np.ndarray, jb: np.ndarray) -> tuple:
        """Errors and their derivatives by a small move of the board in the camera's frame, and that move's by both poses."""
        s, part = self.parts[k]
        back = self.turns[s].T
        shift = (boards[part.of, 3:] - self.sensors[s, 3:]) @ self.turns[s]
        turned = _times((back @ turn[part.of])[part.run], self.data.p[part.rows])
        p = turned + shift[part.run]
        p = np.where((p[:, 2:] > 1e-3), p, p * [1, 1, 0] + [0, 0, 1e-3])  # behind the camera: a great error
        slope = projection_jacobian(p, self.lenses[s]) / SIGMA_PX
        e = (project_points(p, self.lenses[s]) - self.data.uv[part.rows]) / SIGMA_PX
        by_turn = back @ self.jacobians[s]
        by_sensor, by_board = np.zeros((len(shift), 6, 6)), np.zeros((len(shift), 6, 6))
        by_sensor[:, :3, :3], by_sensor[:, 3:, :3], by_sensor[:, 3:, 3:] = -by_turn, skews(shift) @ by_turn, -back
        by_board[:, :3, :3], by_board[:, 3:, 3:] = back @ jb[part.of], back
        return [(e[:, i], [*np.cross(turned, slope[:, i]).T, *slope[:, i].T]) for i in (0, 1)], by_sensor, by_board

    def _found(self, boards: np.ndarray) -> Iterator[tuple]:
        turn, jb = matrices(boards[:, :3]), left_jacobians(boards[:, :3])
        for k, (s, part) in enumerate(self.parts):
            yield part, *(self._lidars if s is None else self._camera)(k, boards, turn, jb)

    def at(self, boards: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Errors, the point each belongs to, and derivatives by the sensor's and the board's pose."""
        parts = []
        for part, errors, by_sensor, by_board in self._found(boards):
            for e, slope in errors:
                own = np.stack(slope, 1)
                parts.append((e, part.rows, np.einsum("nk,nkj->nj", own, by_sensor[part.run]), np.einsum("nk,nkj->nj", own, by_board[part.run])))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0), np.zeros(0, int), np.zeros((0, 6)), np.zeros((0, 6)))

    def summed(self, boards: np.ndarray) -> list[tuple]:
        """For each kind of sensor, sums over each run of points: squared errors, and normal equations; the derivatives by both poses; the largest error."""
        out = []
        for part, errors, by_sensor, by_board in self._found(boards):
            size = by_board.shape[1]
            cost, g, h = np.zeros(len(part.of)), np.zeros((len(part.of), size)), np.zeros((len(part.of), size, size))
            for e, slope in errors:
                cost += np.add.reduceat(e * e, part.begin)
                for i in range(size):
                    g[:, i] += np.add.reduceat(e * slope[i], part.begin)
                    for j in range(i + 1):
                        h[:, i, j] += np.add.reduceat(slope[i] * slope[j], part.begin)
            for i in range(size):
                h[:, :i, i] = h[:, i, :i]
            out.append((part, cost, g, h, by_sensor, by_board, max(float(np.abs(e).max()) for e, _ in errors)))
        return out

    def solved(self, boards: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """The best board of each snapshot from ``boards`` on, and ``summed`` there."""
        damping = np.full(len(boards), 1e-6)
        cost, h, g = self._own(self.summed(boards), boards)
        going = np.ones(len(boards), bool)
        for _ in range(INNER):
            diagonal = np.einsum("nii->ni", h)
            damped = h + (damping[:, None] * diagonal)[:, :, None] * np.eye(6)
            step = np.where(going[:, None], np.linalg.solve(damped, g[:, :, None])[:, :, 0], 0.0)
            trial = boards - step
            cost_, h_, g_ = self._own(self.summed(trial), trial)
            better = going & (cost_ <= cost)
            gain = cost - cost_
            damping = np.where(better, np.maximum(damping / 10, LEAST_DAMPING), damping * 10)
            going &= (np.abs(gain) > 1e-8 * np.maximum(cost, 1e-6)) & (damping < 1e8)  # a step that rounding makes worse is an end too
            boards, cost = np.where(better[:, None], trial, boards), np.where(better, cost_, cost)
            h, g = np.where(better[:, None, None], h_, h), np.where(better[:, None], g_, g)
            if not going.any():
                break
        return boards, self.summed(boards)

    def _own(self, found: list[tuple], boards: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each snapshot's cost, and normal equations of its board."""
        held, n = WEIGHTS * boards, len(boards)
        cost, h, g = (held * held).sum(1), np.tile(np.diag(WEIGHTS**2), (n, 1, 1)), WEIGHTS * held
        for part, c, gp, hp, _, by_board, _ in found:
            back = by_board.transpose(0, 2, 1)
            sums = _by(part.of, np.concatenate([c[:, None], (back @ gp[:, :, None])[:, :, 0], (back @ hp @ by_board).reshape(-1, 36)], 1), n)
            cost, g, h = cost + sums[:, 0], g + sums[:, 1:7], h + sums[:, 7:].reshape(-1, 6, 6)
        return cost, h, g

    def reduced(self, boards: np.ndarray, found: list[tuple]) -> np.ndarray:
        """The batch's share: equations of the sensors, cost, and the largest errors in metres and pixels, as one row of numbers."""
        s, n = len(self.sensors), len(boards)
        cost, hbb, gb = self._own(found, boards)
        width = 6 * s
        both, own, g = np.zeros((n * s, 36)), np.zeros((s, 36)), np.zeros((s, 6))
        worst = [0.0, 0.0]
        for (kind, _), (part, _, gp, hp, by_sensor, by_board, most) in zip(self.parts, found, strict=True):
            back = by_sensor.transpose(0, 2, 1)
            half = back @ hp
            both += _by(part.of * s + part.own, (half @ by_board).reshape(-1, 36), n * s)
            own += _by(part.own, (half @ by_sensor).reshape(-1, 36), s)
            g += _by(part.own, (back @ gp[:, :, None])[:, :, 0], s)
            worst[kind is not None] = max(worst[kind is not None], most * (SIGMA_M if kind is None else SIGMA_PX))
        both = both.reshape(n, s, 6, 6).reshape(n, width, 6)
        back = _solve_held(hbb, np.concatenate([gb[:, :, None], both.transpose(0, 2, 1)], 2))
        h = -np.tensordot(both, back[:, :, 1:], ((0, 2), (0, 1)))
        for k in range(s):
            h[6 * k : 6 * k + 6, 6 * k : 6 * k + 6] += own[k].reshape(6, 6)
        g = g.ravel() - np.einsum("nij,nj->i", both, back[:, :, 0])
        return np.array([*h.ravel(), *g, cost.sum(), float(len(self.data.p)), *worst])


def _solve_held(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Solutions for boards' equations, of which no eigenvalue lies below the least weight's square.

    A lidar that sees a board edge on gives sums beside which rounding loses
    those weights; eigenvalues that came out lower are put back.
    """
    values, vectors = np.linalg.eigh(h)
    return vectors @ ((vectors.transpose(0, 2, 1) @ x) / np.maximum(values, WEIGHTS.min() ** 2)[:, :, None])


def _by(key: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by key."""
    order = np.argsort(key, kind="stable")
    out, sorted_key = np.zeros((n, values.shape[1])), key[order]
    if len(key):
        begin = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
        out[sorted_key[begin]] = np.add.reduceat(values[order], begin, axis=0)
    return out


# ---- over all snapshots


def gathered(points: DataFrame, boards: DataFrame) -> DataFrame:
    """A row for each snapshot that has a board: its seed, and its points as arrays; a snapshot is what the rig sees of one board at one time."""
    columns = ["sensor", "x", "y", "z", "u", "v"]
    uv = [F.col(c) if c in points.columns else F.lit(None).cast("double").alias(c) for c in columns]
    rows = points.select("snapshot", *uv).groupBy("snapshot").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("p"))
    spark = points.sparkSession
    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # few snapshots are much work
    return rows.join(boards.select("snapshot", "board"), "snapshot").select("snapshot", "board", *(F.col(f"p.{c}").alias(c) for c in columns)).repartition(dealt, "snapshot")


def _snapshots(batches: Iterator[pa.RecordBatch]) -> Iterator[Snapshots]:
    for whole in batches:
        sizes = np.diff(whole.column(2).offsets.to_numpy())
        cut = 0
        while cut < len(sizes):
            upto = max(cut + 1, int(np.searchsorted(np.cumsum(sizes[cut:]), BATCH_POINTS, "right")) + cut)
            batch, n = whole.slice(cut, upto - cut), sizes[cut:upto]
            flat = [batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(float) for k in range(1, 8)]
            yield Snapshots(batch.column(0).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n), flat[1].astype(int), np.stack(flat[2:5], 1), np.nan_to_num(np.stack(flat[5:7], 1)), flat[0].reshape(-1, 6), n)
            cut = upto


@dataclass
class Noise:
    """What a replay other than 0 adds to points along their rays, and to pixels."""

    seed: int = 0
    sigma_m: float = SIGMA_M
    sigma_px: float = SIGMA_PX


@dataclass
class Equations:
    h: np.ndarray
    g: np.ndarray
    cost: float
    points: float
    worst_m: float
    worst_px: float


def _equations(data: DataFrame, trials: dict[int, np.ndarray], lenses: dict[int, Lens], by_range: bool, noise: Noise) -> dict[int, Equations]:
    """Equations of each replay at its trial poses; one job."""
    width = 6 * len(next(iter(trials.values())))
    size = width * width + width + 4
    sent = data.sparkSession.sparkContext.broadcast(trials)  # replays times sensors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {r: np.zeros(size) for r in sent.value}
        for own in _snapshots(batches):
            for replay, sensors in sent.value.items():
                model = Model(own.noisy(noise.seed, replay, noise.sigma_m, noise.sigma_px, list(lenses)), sensors, lenses, by_range)
                share = model.reduced(*model.solved(own.seeds))
                most = np.maximum(sums[replay][-2:], share[-2:])
                sums[replay] += share
                sums[replay][-2:] = most
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["replay", "sums"])

    parts = data.mapInArrow(run, "replay int, sums array<double>").select("replay", F.posexplode("sums").alias("k", "x"))
    sums = {r: np.zeros(size) for r in trials}
    most = {r: np.zeros(size) for r in trials}
    for row in parts.groupBy("replay", "k").agg(F.sum("x").alias("x"), F.max("x").alias("most")).collect():  # replays times the numbers of the sensors' matrix
        sums[row["replay"]][row["k"]], most[row["replay"]][row["k"]] = row["x"], row["most"]
    out = {}
    for r, x in sums.items():
        h, g = x[: width * width].reshape(width, width), x[width * width : -4]
        out[r] = Equations(h[6:, 6:], g[6:], float(x[-4]), float(x[-3]), *most[r][-2:].tolist())
    sent.destroy()
    return out


def boards_at(data: DataFrame, poses_by_replay: dict[int, np.ndarray], lenses: dict[int, Lens], noise: Noise) -> DataFrame:
    """``(replay, snapshot, board)``: every board's best pose for given sensors."""
    sent = data.sparkSession.sparkContext.broadcast(poses_by_replay)
    kind = data.schema["snapshot"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _snapshots(batches):
            for replay, sensors in sent.value.items():
                boards, _ = Model(own.noisy(noise.seed, replay, noise.sigma_m, noise.sigma_px, list(lenses)), sensors, lenses, True).solved(own.seeds)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(boards), replay), pa.int32()), pa.array(own.names), pa.array(boards.tolist(), pa.list_(pa.float64()))], names=["replay", "snapshot", "board"])

    return data.mapInArrow(run, f"replay int, snapshot {kind}, board array<double>")


def dogleg(h: np.ndarray, g: np.ndarray, radius: float) -> np.ndarray:
    """The step inside the radius along steepest descent and then towards the Gauss-Newton step."""
    newton = -np.linalg.lstsq(h, g, rcond=None)[0]
    if np.linalg.norm(newton) <= radius:
        return newton
    curve = float(g @ h @ g)
    cauchy = -g * (float(g @ g) / curve) if curve > 0 else -g / np.linalg.norm(g) * radius
    size = np.linalg.norm(cauchy)
    if size >= radius:
        return cauchy * (radius / size)
    d = newton - cauchy
    a, b, c = d @ d, 2 * cauchy @ d, size**2 - radius**2
    return cauchy + d * ((-b + np.sqrt(b * b - 4 * a * c)) / (2 * a))


@dataclass
class Replay:
    """Where the solve of a replay is: poses, their equations, and the trust radius."""

    sensors: np.ndarray
    now: Equations | None = None
    radius: float = 1.0
    steps: int = 0
    done: bool = False

    def trial(self) -> np.ndarray:
        return self.sensors + np.concatenate([np.zeros(6), dogleg(self.now.h, self.now.g, self.radius)]).reshape(-1, 6)

    def judge(self, at: np.ndarray, found: Equations, tolerance: float) -> None:
        """Take the trial if its cost is lower; the radius follows how well the equations foretold it."""
        step = (at - self.sensors).ravel()[6:]
        foretold = -(2 * self.now.g @ step + step @ self.now.h @ step)
        gain, size = self.now.cost - found.cost, float(np.linalg.norm(step))
        self.steps += 1
        ratio = gain / foretold if foretold > 0 else 1.0
        small = max(abs(gain), foretold) <= tolerance * max(self.now.cost, 1e-12) or self.now.cost < 1e-16 * self.now.points
        if gain >= 0:
            self.sensors, self.now = at, found
        if ratio < 0.25:
            self.radius = size / 4
        elif ratio > 0.75 and size >= 0.9 * self.radius:
            self.radius *= 3
        self.done = small or self.radius < 1e-12


def adjust(data: DataFrame, seeds: dict[int, np.ndarray], lenses: dict[int, Lens], *, noise: Noise | None = None, rounds: int = 30, tolerance: float = 1e-8, most_m: float = 100.0, most_px: float = 1000.0, solved: bool = False) -> dict[int, Replay]:
    """Solve every replay from its seed poses, first by distances to planes, then by ranges along rays; ``data`` is a stored table of ``gathered``.

    Seeds that are a solution already (``solved``) are near enough for ranges at once.
    All replays still open share a job.  A seed that leaves an error beyond
    ``most_m`` or ``most_px`` is refused.
    """
    noise = noise or Noise()
    replays = {r: Replay(np.asarray(x, float)) for r, x in seeds.items()}
    for by_range in (True,) if solved else (False, True):
        found = _equations(data, {r: x.sensors for r, x in replays.items()}, lenses, by_range, noise)
        for r, own in replays.items():
            if r not in found or not found[r].points:
                raise ValueError("no snapshot to solve with")
            if found[r].worst_m > most_m or found[r].worst_px > most_px:
                raise ValueError(f"the seed is off by {found[r].worst_m:.3g} m and {found[r].worst_px:.3g} pixels")
            own.now, own.done, own.radius = found[r], False, 1.0
        for _ in range(rounds):
            trials = {r: x.trial() for r, x in replays.items() if not x.done}
            if not trials:
                break
            found = _equations(data, trials, lenses, by_range, noise)
            for r, at in trials.items():
                replays[r].judge(at, found[r], tolerance)
    return replays
