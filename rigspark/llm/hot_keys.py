"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot, so there are fewer than MOST_HOT hot keys.
MOST_HOT = 4096


def joined(rows: DataFrame, side: DataFrame, key: str, name: str, count: str, total: int) -> DataFrame:
    """``rows`` inner-joined on ``key`` with ``side``, whose column ``name`` has each key once.

    ``side``'s ``count`` says how many of the ``total`` rows a key has.  Hot
    keys are fewer than ``MOST_HOT`` whatever the input, so their side is
    broadcast and their rows stay where they are; only the others are shuffled.
    ``count`` is not part of the result.
    """
    hot = F.col(count) * MOST_HOT > total
    kept = [c for c in side.columns if c != count]
    near = F.broadcast(side.where(hot).select(kept))  # fewer than MOST_HOT rows
    direct = rows.join(near, F.col(key) == F.col(name))
    rest = rows.join(near.select(name), F.col(key) == F.col(name), "left_anti")
    return direct.unionByName(rest.join(side.where(~hot).select(kept), F.col(key) == F.col(name)))
