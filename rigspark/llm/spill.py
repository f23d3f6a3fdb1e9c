"""Intermediate tables in the shared folder, and the size of Arrow batches."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..storage import Scratch, shared_folder  # noqa: F401  for the operators

#: Bytes of an Arrow batch between Spark and Python; rows of text differ too much in length to count rows.
BATCH_BYTES = 4 << 20


def sized_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches in bytes, so that long texts do not fill an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
