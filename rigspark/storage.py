"""Cutting lineage: intermediate tables go to the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder only where that is unset and all tasks run in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.gettempdir() + "/rigspark-checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is written inside lets Spark remove its shuffle files at the end: the written table takes their place."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


class Scratch:
    """Tables of one run in a folder of their own; a lost executor costs no recomputation past them.

    As a context manager it removes them all if the run fails; otherwise those
    not dropped stay for the result's readers.  What is left goes when the
    driver ends in order.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/rigspark/{uuid.uuid4().hex}"
        place, store = self._place(self.folder)
        store.deleteOnExit(place)

    def _place(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            self.drop()

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        with _shuffles_go(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove the tables of these names, or all."""
        place, store = self._place(self.folder)
        for name in names:
            for found in store.globStatus(self._place(f"{self.folder}/{name}-*")[0]) or []:
                store.delete(found.getPath(), True)
        if not names:
            store.delete(place, True)
