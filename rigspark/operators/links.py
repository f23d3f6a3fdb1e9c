"""Which sensors see the board together, and what that says of their poses.

Observations are ``(snapshot, sensor)``, lidars numbered before cameras.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import poses
from ..functions import vectors as v

LEAST_SHARED = 3


def selected_snapshots(observations: DataFrame, at_least: int = 2) -> DataFrame:
    return observations.groupBy("snapshot").agg(F.countDistinct("sensor").alias("n_sensors")).where(F.col("n_sensors") >= at_least)


def co_observations(observations: DataFrame) -> DataFrame:
    """``(sensor0, sensor1, n)``: snapshots that both see, sensor0 < sensor1.

    Each snapshot's sensors are gathered to a set first (a rig has at most a
    few dozen), and its pairs counted map-side.
    """
    sets = observations.groupBy("snapshot").agg(F.array_sort(F.collect_set("sensor")).alias("s"))
    pairs = sets.select(F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    names = pairs.schema["p"].dataType.names
    return pairs.groupBy(F.col(f"p.{names[0]}").alias("sensor0"), F.col(f"p.{names[1]}").alias("sensor1")).agg(F.count("*").alias("n"))


def pruned(links: DataFrame, at_least: int = LEAST_SHARED) -> DataFrame:
    return links.where(F.col("n") >= at_least)


def observation_counts(observations: DataFrame, kinds: DataFrame, lidar_least: int = 3, camera_least: int = 1) -> DataFrame:
    """Snapshots by sensor of ``kinds(sensor, kind)``, and whether they are enough for its kind."""
    counts = observations.groupBy("sensor").agg(F.countDistinct("snapshot").alias("n"))
    n = F.coalesce("n", F.lit(0))
    least = F.when(F.col("kind") == "lidar", lidar_least).otherwise(camera_least)
    return kinds.join(counts, "sensor", "left").select("sensor", "kind", n.alias("n"), (n >= least).alias("enough"))


def reachable(links: DataFrame, root: int = 0) -> DataFrame:
    """``(sensor, steps)``: sensors that links reach from ``root``, with the fewest steps.

    A rig's links are at most one row for each pair of its sensors, so they fit
    one row, in which each round adds the neighbours of what is reached.  There
    are as many rounds as sensors: a chain of any length is followed to its end.
    """
    ends = F.array(*(F.struct(F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b")) for a, b in (("sensor0", "sensor1"), ("sensor1", "sensor0"))))
    rig = links.select(F.explode(ends).alias("e")).agg(F.collect_set("e").alias("edges"), F.countDistinct("e.a").alias("sensors"))

    def further(reached: Column, step: Column) -> Column:
        known = F.transform(reached, lambda r: r["sensor"])
        out = F.filter("edges", lambda e: F.array_contains(known, e["a"]) & ~F.array_contains(known, e["b"]))
        new = F.array_distinct(F.transform(out, lambda e: e["b"]))
        return F.concat(reached, F.transform(new, lambda s: F.struct(s.alias("sensor"), step.cast("int").alias("steps"))))

    start = F.array(F.struct(F.lit(root).cast("int").alias("sensor"), F.lit(0).alias("steps")))
    rounds = F.sequence(F.lit(1), F.greatest("sensors", F.lit(1)))
    return rig.select(F.explode(F.aggregate(rounds, start, further)).alias("r")).select("r.sensor", "r.steps")


def unreachable(sensors: DataFrame, reached: DataFrame) -> DataFrame:
    return sensors.join(reached, "sensor", "left_anti")


def pair_sums(planes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """What aligning a pair needs: sums of n0 n1^T, means of p0 and p1; ``planes(*keys, snapshot, sensor, px..pz, nx..nz)``.

    ``keys`` tell rigs apart; a snapshot's sensors are paired, at most a few
    dozen of them, and sums are taken map-side.
    """
    a, b = planes.alias("a"), planes.alias("b")
    same = F.col("a.sensor") < F.col("b.sensor")
    for k in (*keys, "snapshot"):
        same &= F.col(f"a.{k}") == F.col(f"b.{k}")
    outer = [F.sum(F.col(f"a.n{i}") * F.col(f"b.n{j}")).alias(f"m{i}{j}") for i in "xyz" for j in "xyz"]
    means = [F.avg(F.col(f"{s}.p{c}")).alias(f"{s}{c}") for s in "ab" for c in "xyz"]
    return a.join(b, same).groupBy(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.sensor").alias("sensor0"), F.col("b.sensor").alias("sensor1")).agg(F.count("*").alias("n"), *outer, *means)


#: Squarings of a matrix: its power then has 2^40 factors.
SQUARINGS = 40


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _length(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e))


def _scaled(x: Column) -> Column:
    return _bound(x, lambda y: _bound(_length(y), lambda size: F.transform(y, lambda e: e / F.when(size > 0, size).otherwise(F.lit(1.0)))))


def with_leading_vector(rows: DataFrame, m: list[Column], name: str) -> DataFrame:
    """``rows`` with a unit eigenvector to the largest eigenvalue of a symmetric 4 x 4 matrix, whose 16 numbers are ``m``.

    The matrix, moved so that no eigenvalue is negative, is squared again and
    again in a fold until only the leading one is left.  Each step is a column,
    so that the next one does not repeat it.
    """
    at = lambda x, i, j: F.get(x, F.lit(4 * i + j))

    def squared(x: Column, _: Column) -> Column:
        return _scaled(F.array(*(sum((at(x, i, k) * at(x, k, j) for k in range(1, 4)), at(x, i, 0) * at(x, 0, j)) for i in range(4) for j in range(4))))

    rows = rows.withColumn(name, F.array(*m)).withColumn("_size", _length(F.col(name)))
    rows = rows.withColumn(name, F.transform(name, lambda e, k: F.when(k % 5 == 0, e + F.col("_size")).otherwise(e)))
    rows = rows.withColumn(name, F.aggregate(F.sequence(F.lit(1), F.lit(SQUARINGS)), _scaled(F.col(name)), squared))
    rows = rows.withColumn("_diagonal", F.array(*(at(F.col(name), i, i) for i in range(4))))
    rows = rows.withColumn("_place", (F.array_position("_diagonal", F.array_max("_diagonal")) - 1).cast("int"))
    column = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get(F.col(name), 4 * i + F.col("_place")))
    return rows.withColumn(name, column).withColumn(name, _scaled(F.col(name))).drop("_size", "_diagonal", "_place")


def alignments(sums: DataFrame) -> DataFrame:
    """``sums`` of ``pair_sums`` as ``(keys..., sensor0, sensor1, n, rx..rz, tx..tz)``: the pose that takes sensor1's frame to sensor0's.

    By Horn's method: the best rotation is the quaternion that a symmetric
    4 x 4 matrix of the sums has as leading eigenvector, and t = mean(p0 - R p1).
    """
    m = lambda i, j: F.col(f"m{j}{i}")  # noqa: E731  sensor1 is turned to sensor0
    x, y, z = "xyz"
    a, b, c = m(y, z) - m(z, y), m(z, x) - m(x, z), m(x, y) - m(y, x)
    d, e, f = m(x, y) + m(y, x), m(z, x) + m(x, z), m(y, z) + m(z, y)
    xx, yy, zz = m(x, x), m(y, y), m(z, z)
    rows = [xx + yy + zz, a, b, c, a, xx - yy - zz, d, e, b, d, yy - xx - zz, f, c, e, f, zz - xx - yy]
    kept = [k for k in sums.columns if not (len(k) == 3 and k[0] == "m") and not (len(k) == 2 and k[0] in "ab" and k[1] in "xyz")]
    with_q = with_leading_vector(sums, rows, "q")
    w, qx, qy, qz = (F.get("q", F.lit(k)) for k in range(4))
    turned = with_q.select(*kept, *(f"{s}{k}" for s in "ab" for k in "xyz"), *(r.alias("r" + k) for r, k in zip(poses.from_quaternion(qx, qy, qz, w), "xyz", strict=True)))
    t = v.sub(v.vec("a"), poses.rotate(v.vec("r"), v.vec("b")))
    return turned.select(*kept, "rx", "ry", "rz", *(x.alias("t" + k) for x, k in zip(t, "xyz", strict=True)))
