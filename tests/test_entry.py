import __spark_entry__ as entry


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(entry.oracle_sql()) <= set(entry.queries())


def test_empty_segment_lists(spark):
    from rigspark.operators import background, links, scans, snapshots

    points = spark.createDataFrame([], "scan int, ring int, point_idx long, x double, y double, z double")
    assert scans.scan_summary(points).count() == 0
    assert scans.stage1_segments(points, 64).count() == 0
    log = spark.createDataFrame([], "topic string, time_us long, msg_id long, value double")
    assert snapshots.decimated(log, 10, 0).count() == 0
    assert links.co_observations(spark.createDataFrame([], "snapshot int, sensor int")).count() == 0
    assert background.robust_mode(spark.createDataFrame([], "ring int, r double"), ["ring"], "r", 2).count() == 0


def test_points_at_the_seam(spark):
    from rigspark.operators import scans

    rows = [(0, 0, 0, -1.0, 0.0, 0.0), (0, 0, 1, -1.0, -0.0, 0.0), (0, 0, 2, 0.0, 0.0, 3.0), (0, 2, 3, 1.0, 0.0, 0.0), (0, 2, 4, 1.0, 0.0, 0.5)]
    points = spark.createDataFrame(rows, "scan int, ring int, point_idx long, x double, y double, z double")
    assert [r["n"] for r in scans.points_per_ring(points).orderBy("ring").collect()] == [2, 0, 2]
    assert scans.drop_zero_range(points).count() == 5  # (0, 0, z) is kept here and dropped by drop_invalid
    assert scans.drop_invalid(points).count() == 4
