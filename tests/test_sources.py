"""Bundles, arrays, pose files and the stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigspark.operators import calibration
from rigspark.plans.board_queries import rig_points
from rigspark.sources import bundles
from rigspark.streaming.decimation import decimated_stream


def test_bundle_replays(spark, tmp_path):
    points = rig_points(spark, snapshots=8, points=20)
    first = calibration.calibrate(points)
    bundles.write_bundle(str(tmp_path), points=points, poses=calibration.pose_table(first, spark))
    back = bundles.read_bundle(spark, str(tmp_path), "points", "poses")
    again = calibration.solve(calibration.with_noise(back["points"], 3, 0.001), first.sensors, first.boards)
    assert np.abs(again.sensors - first.sensors).max() < 0.02
    text = [r["value"] for r in bundles.transforms_yaml(back["poses"], "base", {0: "a", 1: "b", 2: "c"}).collect()]
    assert text[0] == "a: {parent: base, translation: [0.000000000, 0.000000000, 0.000000000], rotation: [0.000000000, 0.000000000, 0.000000000, 1.000000000]}"


def test_arrays_are_checked(spark):
    good = bundles.scans_from_arrays(spark, {0: (np.zeros((2, 3), np.float32), np.array([0, 1], np.uint16)), 4: (np.ones((3, 3)), np.array([2, 2, 2]))})
    assert good.count() == 5 and good.where("scan = 4").agg(F.sum("x")).first()[0] == 3.0 and good.schema == bundles.POINTS
    assert bundles.scans_from_arrays(spark, {}).count() == 0
    for points, rings in ((np.zeros((2, 2)), np.array([0, 1])), (np.zeros((2, 3)), np.array([0.0, 1.0])), (np.zeros((2, 3)), np.array([0])), (np.zeros((2, 3)), np.array([0, -1])), (np.zeros((2, 3), int), np.array([0, 1]))):
        with pytest.raises(ValueError, match="scan 7"):
            bundles.scans_from_arrays(spark, {7: (points, rings)})
    assert bundles.agreed(good.where("scan = 0"), "scan") == 0
    with pytest.raises(ValueError):
        bundles.agreed(good, "ring")


def test_camera_models():
    plain = bundles.camera_model("{'lensmodel': 'LENSMODEL_PINHOLE', 'intrinsics': [1., 2., 3., 4.], 'imagersize': [5, 6]}")
    assert plain == {"lens": (1.0, 2.0, 3.0, 4.0), "size": (5, 6), "pose": None}
    bent = bundles.camera_model("{'lensmodel': 'LENSMODEL_OPENCV4', 'intrinsics': [1, 2, 3, 4, .1, .2, .3, .4], 'imagersize': [5, 6], 'extrinsics': [0, 0, 0, 1, 2, 3]}")
    assert len(bent["lens"]) == 8 and bent["pose"][5] == 3.0
    for text in ("{'lensmodel': 'LENSMODEL_OTHER', 'intrinsics': [1, 2, 3, 4], 'imagersize': [5, 6]}", "{'lensmodel': 'LENSMODEL_OPENCV5', 'intrinsics': [1, 2, 3, 4], 'imagersize': [5, 6]}"):
        with pytest.raises(ValueError):
            bundles.camera_model(text)


def test_bags_of_several_part_files(spark, tmp_path):
    for name in ("one", "two"):
        spark.range(100).selectExpr("'t' AS topic", "id AS time_us", "id AS msg_id", "0.0D AS value").repartition(3).write.parquet(str(tmp_path / name))
    log = bundles.read_log(spark, [str(tmp_path / "one"), str(tmp_path / "two")], stop_us=50)
    assert sorted(map(tuple, log.groupBy("bag").count().collect())) == [("one", 50), ("two", 50)]


def test_pose_files(spark, tmp_path):
    table = spark.createDataFrame([(k, 0.1, 0.2, 0.3, 1.0, 2.0, 3.0 + k) for k in range(2)], "sensor int, rx double, ry double, rz double, tx double, ty double, tz double")
    bundles.write_pose_files(table, str(tmp_path / "poses"), {0: "front", 1: "rear"})
    texts = {p.parent.name: p.read_text() for p in (tmp_path / "poses").rglob("part-*.txt")}
    assert texts == {"name=front": "rt = [0.1, 0.2, 0.3, 1.0, 2.0, 3.0]\n", "name=rear": "rt = [0.1, 0.2, 0.3, 1.0, 2.0, 4.0]\n"}
    with pytest.raises(ValueError):
        bundles.write_pose_files(table, str(tmp_path / "other"), {0: "front"})


def test_stream_decimates(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:03", 1), ("a", "2024-01-01 00:00:01", 2), ("b", "2024-01-01 00:00:02", 3), ("a", "2024-01-01 00:00:12", 4), ("a", "2024-01-01 01:00:00", 5)]
    table = spark.createDataFrame(rows, "topic string, time string, msg_id long").select("topic", F.col("time").cast("timestamp").alias("time"), "msg_id", F.lit(1.0).alias("value"))
    table.write.parquet(str(tmp_path / "in"))
    stream = decimated_stream(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), "10 seconds", "1 minute")
    query = stream.writeStream.outputMode("append").format("memory").queryName("decimated").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["msg_id"] for r in spark.sql("SELECT msg_id FROM decimated").collect()) == [2, 3, 4]
