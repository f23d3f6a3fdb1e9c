"""Operators on message logs: selection in time, snapshots, and checks of them.

A log has ``(topic, time_us, msg_id, ...)``; windows of time are half open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_window(log: DataFrame, start_us: int | None = None, stop_us: int | None = None) -> DataFrame:
    if start_us is not None:
        log = log.where(F.col("time_us") >= start_us)
    if stop_us is not None:
        log = log.where(F.col("time_us") < stop_us)
    return log


def info(log: DataFrame) -> DataFrame:
    """First and last time, number of messages, and topics of the whole log."""
    return log.agg(F.min("time_us").alias("t0"), F.max("time_us").alias("t1"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("topic")), ",").alias("topics"))


def topics(log: DataFrame) -> DataFrame:
    return log.select("topic").distinct()


def first_messages(log: DataFrame, keys: list[str]) -> DataFrame:
    """The first message of each group: by time, then id."""
    first = F.struct("time_us", "msg_id")
    return log.groupBy(*keys).agg(F.min("time_us").alias("time_us"), F.min_by("msg_id", first).alias("msg_id"), F.min_by("value", first).alias("value"))


def with_segment(log: DataFrame, period_us: int, start_us: int) -> DataFrame:
    """Tumbling segments of time from ``start_us``; earlier messages are left out."""
    return log.where(F.col("time_us") >= start_us).withColumn("segment", F.floor((F.col("time_us") - start_us) / period_us))


def decimated(log: DataFrame, period_us: int, start_us: int) -> DataFrame:
    """The first message of each topic in each segment of time."""
    return first_messages(with_segment(log, period_us, start_us), ["segment", "topic"])


def without_periods(log: DataFrame, periods: DataFrame) -> DataFrame:
    """Messages outside all ``periods(t0, t1)``, given by hand and closed at both ends.

    Periods and messages meet in the coarse time cells that a period touches,
    so this is a keyed join whatever the number of periods.
    """
    cell = 3_600_000_000
    held = periods.select("t0", "t1", F.explode(F.sequence(F.floor(F.col("t0") / cell), F.floor(F.col("t1") / cell))).alias("cell"))
    inside = (F.col("m.cell") == F.col("p.cell")) & F.col("time_us").between(F.col("t0"), F.col("t1"))
    return log.withColumn("cell", F.floor(F.col("time_us") / cell)).alias("m").join(held.alias("p"), inside, "left_anti").drop("cell")


def usable(snapshots: DataFrame, at_least: int = 2) -> DataFrame:
    """Segments with messages of enough topics."""
    return snapshots.groupBy("segment").agg(F.countDistinct("topic").alias("n_topics")).where(F.col("n_topics") >= at_least)


def tight(snapshots: DataFrame, spread_us: int) -> DataFrame:
    """Messages of the segments whose messages lie within ``spread_us``; a looser segment goes as a whole."""
    keep = snapshots.groupBy("segment").agg((F.max("time_us") - F.min("time_us")).alias("spread")).where(F.col("spread") <= spread_us)
    return snapshots.join(keep.select("segment"), "segment", "left_semi")


def missing_topics(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted topics that the log never shows."""
    return wanted.join(log.select("topic").distinct(), "topic", "left_anti")


def classified(log: DataFrame, points_col: str) -> DataFrame:
    """Topics as lidar or camera, from whether their messages hold points; one that shows both is neither."""
    has = F.col(points_col).isNotNull()
    kind = F.when(F.min(has) & F.max(has), "lidar").when(~F.max(has), "camera").otherwise("mixed")
    return log.groupBy("topic").agg(kind.alias("kind"))


def lidars_first(kinds: DataFrame, order: DataFrame) -> DataFrame:
    """``(sensor, topic, kind)``: lidars before cameras, each in the order given by ``order(topic, place)``."""
    rank = F.when(F.col("kind") == "lidar", 0).otherwise(1)
    rows = kinds.join(order, "topic")
    return rows.select((F.row_number().over(Window.orderBy(rank, "place")) - 1).alias("sensor"), "topic", "kind")  # one row for each sensor of the rig


def timeline(log: DataFrame, duration_us: int = 0) -> DataFrame:
    """Messages with time since the log's first; cut after ``duration_us`` unless that is not positive."""
    start = log.agg(F.min("time_us").alias("start"))
    out = log.crossJoin(F.broadcast(start)).withColumn("since_us", F.col("time_us") - F.col("start")).drop("start")  # one row
    return out.where(F.col("since_us") <= duration_us) if duration_us > 0 else out


def last_snapshot(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    return snapshots.groupBy(*keys).agg(F.max("segment").alias("segment"), F.max_by("msg_id", F.struct("segment", "time_us", "msg_id")).alias("msg_id"))
