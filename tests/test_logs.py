"""Chunked logs: round trips, planning by pushed filters, files cut off, and writes that fail."""

import contextlib
import io
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from rigspark.sources import logs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("logs"))
    rows = spark.range(6000).select(F.concat(F.lit("b"), (F.col("id") % 2).cast("string")).alias("bag"), F.when(F.col("id") % 3 == 0, "lidar").otherwise("camera").alias("topic"), (F.col("id") * 1000).alias("time_ns"), F.col("id").alias("sequence"), F.lit("t").alias("type"), F.sha2(F.col("id").cast("string"), 512).cast("binary").alias("payload"))
    logs.write_logs(rows.repartitionByRange(3, "time_ns"), place)
    return place


def test_one_row_a_bag_and_topic(spark, folder):
    found = logs.find_bags(spark, folder + "/*")
    assert list(found) == ["b0", "b1"] and all(len(f) >= 2 for f in found.values())
    log = logs.read_logs(spark, folder + "/*")
    first = log.groupBy("bag", "topic").agg(F.min("time_ns").alias("t"), F.count("*").alias("n"))
    assert sorted(map(tuple, first.collect())) == [("b0", "camera", 2000, 2000), ("b0", "lidar", 0, 1000), ("b1", "camera", 1000, 2000), ("b1", "lidar", 3000, 1000)]
    assert logs.read_logs(spark, folder + "/*", ["b1$"]).select("bag").distinct().collect()[0]["bag"] == "b0"
    with pytest.raises(FileNotFoundError):
        logs.find_bags(spark, folder + "/nothing*")


def test_filters_reach_the_planning(spark, folder, monkeypatch):
    log = logs.read_logs(spark, folder + "/*").where("topic = 'lidar' AND time_ns >= 3000000 AND time_ns < 4000000 AND bag = 'b0'")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        log.explain("formatted")
    pushed = out.getvalue()
    assert "PushedFilters" in pushed and "time_ns" in pushed.split("PushedFilters")[1].split("\n")[0]
    assert log.count() == len([k for k in range(3000, 4000) if k % 2 == 0 and k % 3 == 0])
    reader = logs.LogReader(logs.find_bags(spark, folder + "/*"))
    every = len(reader.partitions())
    assert not list(reader.pushFilters([EqualTo(("bag",), "b0"), GreaterThanOrEqual(("time_ns",), 5_900_000), LessThan(("time_ns",), 5_950_000), In(("topic",), ("camera", "none"))]))
    assert 0 < len(reader.partitions()) < every
    left = list(logs.LogReader({}).pushFilters([EqualTo(("payload",), b"")]))
    assert len(left) == 1


def test_small_chunks_are_partitions(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "CHUNK_BYTES", 500)
    with open(tmp_path / "own.mcap", "wb") as f:
        part = logs._Part(f)
        for k in range(40):
            part.add("a" if k < 20 else "b", k, k, k, "type", "cdr", bytes(50))
        part.close()
    found = logs.pieces("own", str(tmp_path / "own.mcap"))
    assert len(found) > 5 and found[0].first_ns == 0 and found[-1].last_ns == 39
    reader = logs.LogReader({"own": [str(tmp_path / "own.mcap")]})
    list(reader.pushFilters([EqualTo(("topic",), "b")]))
    assert len(reader.partitions()) < len(found)
    assert logs.read_logs(spark, str(tmp_path / "*.mcap")).where("topic = 'b'").count() == 20


def test_logs_without_an_index(spark, tmp_path):
    whole = tmp_path / "whole.mcap"
    with open(whole, "wb") as f:
        part = logs._Part(f)
        for k in range(10):
            part.add("a", k, k, k, "type", "cdr", b"x")
            if k % 4 == 3:
                part.flush()
        part.close()
    raw = whole.read_bytes()
    (tmp_path / "cut.mcap").write_bytes(raw[: len(raw) - 60])
    loose = logs.MAGIC + logs._record(logs.HEADER, logs._text("") + logs._text("")) + b"".join([logs._record(logs.SCHEMA, struct.pack("<H", 1) + logs._text("t") + logs._text("") + struct.pack("<I", 0)), logs._record(logs.CHANNEL, struct.pack("<HH", 0, 1) + logs._text("a") + logs._text("") + struct.pack("<I", 0))]) + b"".join(logs._record(logs.MESSAGE, struct.pack("<HIQQ", 0, k, k, k) + b"y") for k in range(5))
    (tmp_path / "loose.mcap").write_bytes(loose + b"\5\1")
    (tmp_path / "other.mcap").write_bytes(b"not a log")
    log = logs.read_logs(spark, str(tmp_path / "*.mcap"), ["other"])
    assert sorted(map(tuple, log.groupBy("bag").agg(F.count("*")).collect())) == [("cut", 10), ("loose", 5), ("whole", 10)]
    with pytest.raises(Exception, match="not a chunked log"):
        logs.read_logs(spark, str(tmp_path / "other.mcap")).count()


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    rows = spark.range(100).select(F.when(F.col("id") != 99, "bag").alias("bag"), F.lit("t").alias("topic"), F.col("id").alias("time_ns"), F.lit(None).cast("binary").alias("payload")).repartition(3)
    with pytest.raises(Exception):
        logs.write_logs(rows, str(tmp_path / "log"))
    assert not [p for p in (tmp_path / "log").rglob("*") if p.is_file()]
    logs.write_logs(rows.where("bag is not null"), str(tmp_path / "log"))
    assert logs.read_logs(spark, str(tmp_path / "log" / "bag")).count() == 99
    assert not list((tmp_path / "log").glob("_temporary*"))


def test_clouds(spark, tmp_path):
    xyz, ring = np.arange(15, dtype=np.float32).reshape(5, 3), np.array([0, 1, 2, 1, 0])
    payload = logs.cloud_payload(7_000_000_001, "frame", xyz, ring)
    stamp, fields = logs.cloud(payload)
    assert stamp == 7_000_000_001 and fields["ring"].tolist() == ring.tolist() and np.array_equal(np.stack([fields[c] for c in "xyz"], 1), xyz)
    rows = spark.createDataFrame([("b", "l", 5, logs.POINT_TYPES[1], bytearray(payload)), ("b", "c", 6, "other", bytearray(b"")), ("b", "l", 7, logs.POINT_TYPES[0], bytearray(logs.cloud_payload(8, "", xyz[:0], ring[:0])))], "bag string, topic string, time_ns long, type string, payload binary")
    logs.write_logs(rows, str(tmp_path / "log"))
    points = logs.points_of(logs.read_logs(spark, str(tmp_path / "log" / "*")))
    assert points.count() == 5 and points.agg(F.sum("z")).first()[0] == float(xyz[:, 2].sum())
    assert json.loads(json.dumps(list(logs.find_bags(spark, str(tmp_path / "log" / "*"))))) == ["b"]


def test_wide_clouds_come_back_as_they_are():
    """places that four bytes would round."""
    xyz = np.random.default_rng(1).normal(0, 3, (50, 3))
    _, found = logs.cloud(logs.cloud_payload(1, "frame", xyz, np.arange(50) % 4, wide=True))
    assert (np.stack([found[c] for c in "xyz"], 1) == xyz).all() and found["ring"].tolist() == [k % 4 for k in range(50)]
