"""Queries on chunked logs, written from ``events`` and ``embeddings`` and read back, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshots
from ..sources import fixtures as fx
from ..sources import logs
from ..storage import Scratch
from .catalogue import query
from .log_queries import HOUR, T0

#: A bag for each of three days, in parts.
_BAGS = f"{fx.MESSAGES_SQL}, bagged AS (SELECT 'bag-' || (((time_us - {T0}) // {24 * HOUR}) % 3) AS bag, topic, time_us * 1000 AS time_ns, msg_id, value FROM messages WHERE time_us >= {T0})"


def _bagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages as logs of three bags, each of several part files; a message's payload is its value as text."""
    rows = fx.messages(spark, sf_dir).where(F.col("time_us") >= T0)
    bag = F.concat(F.lit("bag-"), (F.floor((F.col("time_us") - T0) / (24 * HOUR)) % 3).cast("string"))
    log = rows.select(bag.alias("bag"), "topic", (F.col("time_us") * 1000).alias("time_ns"), F.col("msg_id").alias("sequence"), F.lit("std_msgs/msg/Float64").alias("type"), F.col("value").cast("string").cast("binary").alias("payload"))
    with Scratch(spark) as scratch:
        folder = f"{scratch.folder}/logs"
        logs.write_logs(log.repartitionByRange(4, "time_ns").sortWithinPartitions("time_ns"), folder)
    return logs.read_logs(spark, f"{folder}/bag-*")


@query("log_round_trip", f"WITH {_BAGS} SELECT bag, topic, time_ns, msg_id, round(value, 6) AS value FROM bagged")
def log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bagged(spark, sf_dir).select("bag", "topic", "time_ns", F.col("sequence").alias("msg_id"), F.round(F.col("payload").cast("string").cast("double"), 6).alias("value"))


@query("first_per_bag", f"WITH {_BAGS} SELECT bag, topic, time_ns, msg_id FROM bagged QUALIFY row_number() OVER (PARTITION BY bag, topic ORDER BY time_ns, msg_id) = 1")
def first_per_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _bagged(spark, sf_dir).select("bag", "topic", F.col("time_ns").alias("time_us"), F.col("sequence").alias("msg_id"), F.lit(0.0).alias("value"))
    return snapshots.first_messages(log, ["bag", "topic"]).select("bag", "topic", F.col("time_us").alias("time_ns"), "msg_id")


@query("log_window", f"WITH {_BAGS} SELECT bag, topic, count(*) AS n, min(time_ns) AS t0, max(time_ns) AS t1 FROM bagged WHERE topic IN ('view', 'click') AND bag <> 'bag-1' AND time_ns >= {(T0 + 20 * HOUR) * 1000} AND time_ns < {(T0 + 400 * HOUR) * 1000} GROUP BY ALL")
def log_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bagged(spark, sf_dir).where(F.col("bag").isin("bag-0", "bag-2") & F.col("topic").isin("view", "click") & (F.col("time_ns") >= (T0 + 20 * HOUR) * 1000) & (F.col("time_ns") < (T0 + 400 * HOUR) * 1000))
    return rows.groupBy("bag", "topic").agg(F.count("*").alias("n"), F.min("time_ns").alias("t0"), F.max("time_ns").alias("t1"))


@query("log_clouds", f"WITH {fx.POINTS_SQL} SELECT 'scan-' || scan AS bag, ring, count(*) AS n, round(sum(x), 3) AS x, round(sum(y), 3) AS y, round(max(z), 3) AS z FROM points GROUP BY ALL")
def log_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scans as point clouds in logs, a message for each thousand points."""

    def clouds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scan, ring, at = (batch.column(k).to_numpy() for k in range(3))
            xyz = np.stack([batch.column(k).to_numpy() for k in (3, 4, 5)], 1)
            for own in np.unique(scan):
                mine = np.flatnonzero(scan == own)
                for k in range(0, len(mine), 1000):
                    some = mine[k : k + 1000]
                    stamp = int(at[some].min())
                    payload = logs.cloud_payload(stamp, "lidar", xyz[some], ring[some], wide=True)
                    yield pa.RecordBatch.from_arrays([pa.array([f"scan-{own}"]), pa.array(["/lidar"]), pa.array([stamp]), pa.array([logs.POINT_TYPES[0]]), pa.array([payload], pa.binary())], names=["bag", "topic", "time_ns", "type", "payload"])

    rows = fx.points(spark, sf_dir).select("scan", "ring", "point_idx", *"xyz").mapInArrow(clouds, "bag string, topic string, time_ns long, type string, payload binary")
    with Scratch(spark) as scratch:
        folder = f"{scratch.folder}/logs"
        logs.write_logs(rows, folder)
    found = logs.points_of(logs.read_logs(spark, f"{folder}/scan-*"))
    return found.groupBy("bag", "ring").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("x"), F.round(F.sum("y"), 3).alias("y"), F.round(F.max("z"), 3).alias("z"))
