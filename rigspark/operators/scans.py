"""Operators on scans: filters, order, spacing, segments, planes.

A scan table has ``(scan, ring, point_idx, x, y, z)``.  Everything is keyed by
(scan, ring), so one shuffle serves the order, the gaps and the segments.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v
from .parameters import SegmentationParameters

DEFAULT = SegmentationParameters()


def drop_invalid(points: DataFrame) -> DataFrame:
    """A point with x = y = 0 is no return."""
    return points.where(~((F.col("x") == 0) & (F.col("y") == 0)))


def drop_zero_range(points: DataFrame) -> DataFrame:
    return points.where(v.norm2(v.vec()) > 0)


def range_cut(points: DataFrame, below: float) -> DataFrame:
    return points.where(v.norm(v.vec()) < below)


def max_range(points: DataFrame, most: float) -> DataFrame:
    return points.where(v.norm2(v.vec()) <= most * most)


def ring_only(points: DataFrame, ring: int) -> DataFrame:
    return points.where(F.col("ring") == ring)


def far_points(points: DataFrame, beyond: float = 1000.0) -> DataFrame:
    """Points that are too far out to be believed; a warning, not a filter."""
    return points.where((F.abs("x") > beyond) | (F.abs("y") > beyond) | (F.abs("z") > beyond))


def ordered(points: DataFrame) -> DataFrame:
    """Valid points with azimuth, place in their ring by (azimuth, point_idx), and gap to the point before."""
    w = Window.partitionBy("scan", "ring").orderBy("az", "point_idx")
    out = drop_invalid(points).withColumn("az", v.azimuth(v.vec()))
    return out.withColumn("in_ring", F.row_number().over(w) - 1).withColumn("daz", F.col("az") - F.lag("az").over(w))


def points_per_ring(points: DataFrame, rings: int | None = None) -> DataFrame:
    """Valid points by (scan, ring), zero for rings without; rings run to the scan's largest, or to ``rings``."""
    counts = drop_invalid(points).groupBy("scan", "ring").agg(F.count("*").alias("n"))
    span = points.groupBy("scan").agg((F.max("ring") + 1 if rings is None else F.lit(rings)).alias("rings"))
    every = span.select("scan", F.explode(F.sequence(F.lit(0), F.col("rings") - 1)).alias("ring"))
    return every.join(counts, ["scan", "ring"], "left").select("scan", "ring", F.coalesce("n", F.lit(0)).alias("n"))


def ring_offsets(points: DataFrame) -> DataFrame:
    w = Window.partitionBy("scan").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)
    return points_per_ring(points).withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0)))


def spacing_histogram(points: DataFrame) -> DataFrame:
    """``(scan, per_rotation, n)``: how many neighbours in azimuth imply so many points for each turn."""
    step = F.abs("daz")
    bins = F.floor(2 * math.pi / F.when(step > 0, step) + 0.5)
    return ordered(points).select("scan", bins.alias("per_rotation")).where("per_rotation between 1 and 65536").groupBy("scan", "per_rotation").agg(F.count("*").alias("n"))


def spacing_in_file_order(points: DataFrame) -> DataFrame:
    """The histogram over neighbours in file order, without the search for a power of two."""
    w = Window.partitionBy("scan", "ring").orderBy("point_idx")
    step = F.abs(F.col("az") - F.lag("az").over(w))
    rows = drop_zero_range(points).withColumn("az", v.azimuth(v.vec())).select("scan", step.alias("step"))
    return rows.select("scan", F.floor(2 * math.pi / F.when(F.col("step") > 0, F.col("step")) + 0.5).alias("per_rotation")).where("per_rotation >= 1 and per_rotation < 1000000").groupBy("scan", "per_rotation").agg(F.count("*").alias("n"))


def top_spacings(histogram: DataFrame) -> DataFrame:
    """The two commonest spacings of each scan, and whether the first is clear (five times the second)."""
    w = Window.partitionBy("scan").orderBy(F.desc("n"), "per_rotation")
    top = histogram.withColumn("place", F.row_number().over(w)).where("place <= 2")
    first = F.max(F.when(F.col("place") == 1, F.col("n")))
    second = F.max(F.when(F.col("place") == 2, F.col("n")))
    return top.groupBy("scan").agg(F.max(F.when(F.col("place") == 1, F.col("per_rotation"))).alias("mode"), first.alias("n_first"), F.coalesce(second, F.lit(0)).alias("n_second"), F.coalesce(first >= 5 * second, F.lit(True)).alias("clear"))


def scan_summary(points: DataFrame) -> DataFrame:
    """What a scan looks like: points, rings, and points for each turn as the mode and its nearest power of two."""
    counts = points_per_ring(points).groupBy("scan").agg(F.sum("n").alias("n_points"), F.count("*").alias("n_rings"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("n_rings_seen"))
    spacing = top_spacings(spacing_histogram(points)).select("scan", "mode", v.nearest_power2(F.col("mode")).alias("per_rotation"), "clear")
    return counts.join(spacing, "scan", "left")


def stage1_cells(points: DataFrame, per_rotation: int, par: SegmentationParameters = DEFAULT) -> DataFrame:
    """Ordered points with their azimuth cell, place in it, and whether the gap before them is too wide."""
    cells = per_rotation // par.points_per_segment
    out = ordered(points).withColumn("cell", v.azimuth_cell(F.col("az"), cells))
    place = F.row_number().over(Window.partitionBy("scan", "ring", "cell").orderBy("in_ring")) - 1
    gap = F.floor(0.5 + F.abs("daz") * per_rotation / (2 * math.pi)) - 1
    out = out.withColumn("in_cell", place)
    # a ring's first point has no gap; points beyond the cell's expected size are not checked
    wide = (F.col("in_cell") < par.points_per_segment) & (gap > par.max_gap)
    return out.withColumn("invalid", F.coalesce(wide, F.lit(False)))


def scatter(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean and centred 3x3 scatter sums by group, from one pass of partial sums."""
    n = F.count("*")
    aggs = [n.alias("n"), *(F.avg(c).alias(f"m{c}") for c in "xyz")]
    aggs += [(F.covar_pop(a, b) * n).alias(f"s{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]
    return rows.groupBy(*keys).agg(*aggs)


def _moments(prefix: str = "s") -> tuple[Column, ...]:
    return tuple(F.col(prefix + c) for c in ("xx", "yy", "zz", "xy", "xz", "yz"))


def eigen(sums: DataFrame) -> DataFrame:
    """``scatter`` with ascending eigenvalues l0, l1, l2."""
    l0, l1, l2 = v.eigenvalues3(*_moments())
    return sums.withColumns({"l0": l0, "l1": l1, "l2": l2})


def fitted_planes(sums: DataFrame) -> DataFrame:
    """``scatter`` with eigenvalues and the unit normal (nx, ny, nz), pointing away from the sensor."""
    out = eigen(sums)
    n = v.eigenvector3(*_moments(), F.col("l0"))
    out = out.withColumns(dict(zip(("ux", "uy", "uz"), n, strict=True)))
    size = v.norm(v.vec("u"))
    sign = F.when(v.dot(v.vec("u"), v.vec("m")) < 0, -1.0).otherwise(1.0)
    return out.withColumns({f"n{c}": F.when(size > 0, F.col(f"u{c}") / F.when(size > 0, size) * sign) for c in "xyz"}).drop("ux", "uy", "uz")


def stage1_segments(points: DataFrame, per_rotation: int, par: SegmentationParameters = DEFAULT) -> DataFrame:
    """Straight pieces of rings: ``(scan, ring, cell, px..pz, vx..vz, first, last, ax..az, bx..bz)``.

    A cell gives a segment when few of its points follow wide gaps, enough do
    not, and these lie along the chord from its first to its last point.  The
    segment's centre and direction come from all of its points.
    """
    cells = stage1_cells(points, per_rotation, par)
    keys = ["scan", "ring", "cell"]
    w = Window.partitionBy(*keys)
    ends = {}
    for c in "xyz":
        ends[f"a{c}"] = F.min_by(c, "in_ring").over(w)
        ends[f"b{c}"] = F.max_by(c, "in_ring").over(w)
    rows = cells.drop("az", "daz").withColumns(ends)
    chord, off = v.sub(v.vec("b"), v.vec("a")), v.sub(v.vec(), v.vec("a"))
    along = v.dot(off, chord)
    rows = rows.withColumn("bend", v.norm2(off) - along * along / F.when(v.norm2(chord) > 0, v.norm2(chord)))
    n = F.count("*")
    valid = F.sum(F.when(F.col("invalid"), 0).otherwise(1))
    checks = [(n - valid).alias("n_invalid"), valid.alias("n_valid"), F.max(F.when(~F.col("invalid") & (F.col("in_cell") > 0), F.col("bend"))).alias("bend"), F.min("in_ring").alias("first"), F.max("in_ring").alias("last")]
    aggs = [F.avg(c).alias(f"p{c}") for c in "xyz"] + [(F.covar_pop(a, b) * n).alias(f"s{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]
    out = rows.groupBy(*keys).agg(*checks, *aggs, *(F.first(c).alias(c) for c in ends))
    out = out.where((F.col("n_invalid") <= par.max_invalid_in_segment) & (F.col("n_valid") >= par.min_in_segment) & (F.coalesce("bend", F.lit(0.0)) <= par.max_bend**2))
    out = eigen(out.where(F.col("sxx") + F.col("syy") + F.col("szz") > 0))
    direction = v.eigenvector3(*_moments(), F.col("l2"))
    out = out.withColumns(dict(zip(("vx", "vy", "vz"), direction, strict=True)))
    # a segment's direction follows the turn of the scan
    size = v.norm(v.vec("v"))
    sign = F.when(v.dot(v.vec("v"), v.sub(v.vec("b"), v.vec("a"))) < 0, -1.0).otherwise(1.0)
    out = out.withColumns({f"v{c}": F.col(f"v{c}") / F.when(size > 0, size) * sign for c in "xyz"})
    return out.select(*keys, "n_valid", "n_invalid", "first", "last", *(p + c for p in "pvab" for c in "xyz"))


def adjacent_pairs(segments: DataFrame, par: SegmentationParameters = DEFAULT) -> DataFrame:
    """Seed planes: segments of one cell in neighbouring rings that span a plane.

    The planes' normals from either segment agree, and neither is seen too
    flat.  Columns: ``(scan, ring, cell, cx..cz, nx..nz)`` of the lower ring.
    """
    # one row for each key already: the aggregate, which needs no shuffle, only keeps the optimiser from copying the eigenvector formulas into the predicates
    segments = segments.dropDuplicates(["scan", "ring", "cell"])
    up = segments.select("scan", (F.col("ring") - 1).alias("ring"), "cell", *(F.col(p + c).alias("u" + p + c) for p in "pv" for c in "xyz"))
    both = segments.join(up, ["scan", "ring", "cell"])
    p0, v0, p1, v1 = v.vec("p"), v.vec("v"), v.vec("up"), v.vec("uv")
    dp = v.sub(p1, p0)
    n0, n1 = v.cross(dp, v0), v.cross(dp, v1)
    n, c = v.mean(n0, n1), v.mean(p0, p1)
    good = (v.norm2(dp) <= par.max_across_rings**2) & v.same_direction(n0, n1, par.min_cos_same_cross_ring) & v.not_tilted(c, n, par.min_cos_tilt)
    return both.where(good).select("scan", "ring", "cell", *(x.alias("c" + k) for x, k in zip(c, "xyz", strict=True)), *(x.alias("n" + k) for x, k in zip(n, "xyz", strict=True)))
