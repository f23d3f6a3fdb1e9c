"""The static scene: range images, their robust mode over snapshots, and masking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v

QUANTUM = 0.2
COLUMNS = 2048


def range_image(points: DataFrame, snapshot: str, columns: int = COLUMNS) -> DataFrame:
    """``(ring, column, snapshot, r)``: the last range written to each cell; cells without one have no row."""
    rows = points.withColumn("r", v.norm(v.vec())).where("r > 0").withColumn("column", v.azimuth_column(v.azimuth(v.vec()), columns))
    return rows.groupBy("ring", "column", F.col(snapshot).alias("snapshot")).agg(F.max_by("r", "point_idx").alias("r"))


def robust_mode(cells: DataFrame, keys: list[str], value: str, at_least: int, quantum: float = QUANTUM) -> DataFrame:
    """The quantised mode of non-zero values by group, or 0 where it is not sure.

    Bins of at least four values count, alone or with their upper neighbour;
    the largest wins, the lower of equals.  The group's number of values and
    the winner's must both reach ``at_least``.
    """
    bins = cells.where(F.col(value) != 0).groupBy(*keys, F.floor(F.col(value) / quantum).alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    by_bin = Window.partitionBy(*keys).orderBy("bin")
    full = bins.withColumn("all", total).where("n >= 4")
    ahead = F.when(F.lead("bin").over(by_bin) == F.col("bin") + 1, F.lead("n").over(by_bin)).otherwise(0)
    full = full.withColumn("tot", F.col("n") + ahead)
    best = full.groupBy(*keys).agg(F.max("all").alias("all"), F.max_by(F.struct("bin", "n", "tot"), F.struct("tot", F.negate("bin"))).alias("b"))
    middle = F.col("b.bin") + F.when(F.floor(F.col("b.tot") / 2) >= F.col("b.n"), 1).otherwise(0)
    mode = F.when((F.col("all") >= at_least) & (F.col("b.tot") >= at_least), (0.5 + middle) * quantum).otherwise(0.0)
    every = cells.select(*keys).distinct()
    return every.join(best.select(*keys, mode.alias("mode")), keys, "left").select(*keys, F.coalesce("mode", F.lit(0.0)).alias("mode"))


def static_points(points: DataFrame, modes: DataFrame, columns: int = COLUMNS, quantum: float = QUANTUM) -> DataFrame:
    """``points`` with ``static``: within two quanta of their cell's mode; an unknown mode counts as 0."""
    rows = points.withColumn("column", v.azimuth_column(v.azimuth(v.vec()), columns)).withColumn("r", v.norm(v.vec()))
    both = rows.join(modes, ["ring", "column"], "left")
    return both.withColumn("static", F.abs(F.col("r") - F.coalesce("mode", F.lit(0.0))) < 2 * quantum).drop("mode")


def without_static(points: DataFrame, modes: DataFrame, columns: int = COLUMNS, quantum: float = QUANTUM) -> DataFrame:
    return static_points(points, modes, columns, quantum).where("not static").drop("column", "r", "static")
