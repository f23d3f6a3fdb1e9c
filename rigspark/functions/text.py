"""Text helpers: times, lists and topic names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integers beyond this are nanoseconds, others seconds (year 5138 in seconds).
SECONDS_BELOW = 100_000_000_000


def time_ns(text: Column) -> Column:
    """Nanoseconds since the epoch from integer seconds or nanoseconds, decimal seconds, or a date and time; else null."""
    whole = text.rlike(r"^\s*[0-9]+\s*$")
    number = text.try_cast("bigint")
    decimal = text.try_cast("decimal(28,9)")
    stamp = F.unix_micros(text.try_cast("timestamp")) * 1000
    return F.when(whole, F.when(number < SECONDS_BELOW, number * 1_000_000_000).otherwise(number)).otherwise(F.coalesce((decimal * 1_000_000_000).cast("bigint"), stamp))


def int_list(text: Column) -> Column:
    """Integers of a comma-separated list; an entry that is none is null."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int"))


def float_list(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))


def all_valid(numbers: Column, *, negative: bool = True) -> Column:
    """Every entry was a number, and none is negative where that is not allowed."""
    good = F.forall(numbers, lambda x: x.isNotNull())
    return good if negative else good & F.forall(numbers, lambda x: x >= 0)


def safe_name(topic: Column) -> Column:
    """A topic as part of a file name."""
    return F.regexp_replace(F.regexp_replace(topic, "^/+", ""), "[^A-Za-z0-9_-]+", "_")


def component(topic: Column, i: int) -> Column:
    """The i-th part (from 0) between slashes, or null."""
    return F.get(F.split(topic, "/"), F.lit(i))
