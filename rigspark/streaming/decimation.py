"""Decimation of a message stream: the first message of each topic in each span of time.

An addition: the batch form is ``operators.snapshots.decimated``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decimated_stream(messages: DataFrame, period: str, late: str) -> DataFrame:
    """``messages(topic, time timestamp, msg_id, value)`` to one row for each topic and window.

    State is one row for each open window and topic; ``late`` bounds how long
    a window stays open.
    """
    first = F.struct("time", "msg_id")
    windows = messages.withWatermark("time", late).groupBy(F.window("time", period), "topic")
    rows = windows.agg(F.min("time").alias("time"), F.min_by("msg_id", first).alias("msg_id"), F.min_by("value", first).alias("value"))
    return rows.select(F.col("window.start").alias("start"), "topic", "time", "msg_id", "value")
