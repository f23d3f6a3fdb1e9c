"""Raw frames: checks, lines, rescaling and files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigspark.operators import frames as fr
from rigspark.sources import frame_files

SCHEMA = "frame long, h int, w int, format string, data binary, line string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "own") for r in rows], SCHEMA)


def by_hand(levels, tiles=8, spread=400, rounds=2):
    """The rule again, over a whole array."""
    h, w = levels.shape
    tall, wide = min(h, tiles), min(w, tiles)
    down, across = np.arange(h) * tall // h, np.arange(w) * wide // w
    lo = np.array([[levels[np.ix_(down == a, across == b)].min() for b in range(wide)] for a in range(tall)])
    hi = np.array([[levels[np.ix_(down == a, across == b)].max() for b in range(wide)] for a in range(tall)])

    def around(f, a, b):
        near = f[max(a - 1, 0) : a + 2, max(b - 1, 0) : b + 2]
        return int(near.sum() - f[a, b]) // (near.size - 1) if near.size > 1 else f[a, b]

    def mean(f):
        return np.array([[around(f, a, b) for b in range(wide)] for a in range(tall)])

    lo, hi = np.maximum(lo, mean(lo) - spread), np.minimum(hi, mean(hi) + spread)
    for _ in range(rounds):
        lo, hi = np.minimum(lo, mean(lo)), np.maximum(hi, mean(hi))

    def at(n, cells):
        return np.clip((np.arange(n) + 0.5) * cells / n - 0.5, 0, cells - 1)

    def blend(f):
        y, x = at(h, tall), at(w, wide)
        y0, x0 = y.astype(int), x.astype(int)
        wy, wx = y - y0, x - x0
        rows = f[y0] * (1 - wy)[:, None] + f[np.minimum(y0 + 1, tall - 1)] * wy[:, None]
        return rows[:, x0] * (1 - wx) + rows[:, np.minimum(x0 + 1, wide - 1)] * wx

    a, b = blend(lo), blend(hi)
    return np.floor(255 * np.clip((levels - a) / np.maximum(b - a, 1), 0, 1) + 0.5).astype(int)


def test_problems(spark):
    rows = [
        (None, 1, 1, "mono8", b"a"), (1, 1, 1, "mono8", b"a"), (2, 2, 3, "mono16", bytes(12)), (3, 2, 3, "bgr8", bytes(18)), (4, 2, 3, "bgr8", bytes(17)),
        (5, 0, 3, "mono8", b""), (6, None, 3, "mono8", b""), (7, 1, 1, None, b"a"), (8, 1, 1, "rgb8", b"abc"), (9, 1, 1, "mono8", None), (10, 60000, 60000, "mono16", b"a"),
    ]
    got = {r.frame: r.problem for r in fr.frame_problems(table(spark, rows)).collect()}
    assert got == {None: "no id", 1: None, 2: None, 3: None, 4: "wrong length", 5: "no size", 6: "no size", 7: "unknown format", 8: "unknown format", 9: "no data", 10: "wrong length"}
    assert fr.frame_problems(table(spark, [])).count() == 0


@pytest.mark.parametrize(("h", "w"), [(1, 1), (3, 5), (8, 8), (37, 61), (120, 9)])
def test_rescaled(spark, h, w):
    rng = np.random.default_rng(h)
    levels = rng.integers(1000, 1200, (h, w)) + np.arange(w) * 7
    levels[rng.random((h, w)) > 0.97] = 65535
    got = fr.rescale(table(spark, [(1, h, w, "mono16", levels.astype("<u2").tobytes()), (2, h, w, "mono8", bytes(h * w))])).collect()
    assert {r.frame for r in got} == {1} and len(got) == h
    assert [r.levels for r in sorted(got, key=lambda r: r.line)] == by_hand(levels).tolist()


def test_flat_and_empty(spark):
    flat = fr.rescale(table(spark, [(1, 4, 4, "mono16", b"\x07\x01" * 16)])).collect()
    assert {tuple(r.levels) for r in flat} == {(0, 0, 0, 0)}
    assert fr.rescale(table(spark, [])).count() == 0


def test_lamp_does_not_darken(spark):
    """One bright pixel leaves contrast to the rest of its tile."""
    levels = np.tile(np.arange(64) % 2 * 100 + 3000, (64, 1))
    levels[20, 20] = 65535
    rows = fr.rescale(table(spark, [(1, 64, 64, "mono16", levels.astype("<u2").tobytes())]), rounds=0).where("line = 21").collect()
    near = rows[0].levels[18:24]
    assert max(near) - min(near) > 40
    assert (levels[21].max() - 3000) * 255 / (65535 - 3000) < 1  # by plain extremes it would have none


def test_eight_bits(spark):
    levels = np.arange(6 * 10).reshape(6, 10) * 50
    rows = [(1, 6, 10, "mono16", levels.astype("<u2").tobytes()), (2, 1, 2, "bgr8", b"abcdef"), (3, 1, 2, "mono8", b"ab"), (4, 1, 2, "mono8", b"abc"), (None, 1, 2, "mono8", b"ab")]
    got = {r.frame: r for r in fr.eight_bits(table(spark, rows)).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1].format, bytes(got[1].data)) == ("mono8", bytes(by_hand(levels).astype(np.uint8).tobytes()))
    assert bytes(got[2].data) == b"abcdef" and bytes(got[3].data) == b"ab"


def test_files(spark, tmp_path):
    rows = table(spark, [(1, 1, 2, "mono8", b"ab"), (2, 1, 2, "bgr8", b"abcdef"), (3, 1, 2, "mono16", b"abcd")])
    frame_files.write_frames(rows.withColumn("name", F.format_string("f%03d", "frame")), str(tmp_path / "all"))
    got = {p.name: p.read_bytes() for p in (tmp_path / "all").iterdir()}
    assert got == {"f001.pgm": b"P5 2 1 255\nab", "f002.ppm": b"P6 2 1 255\ncbafed", "f003.pgm": b"P5 2 1 65535\nbadc"}
    frame_files.write_frames(rows.withColumn("name", F.format_string("f%03d", "frame")), str(tmp_path / "two"), first=2)
    assert {p.name for p in (tmp_path / "two").iterdir()} == {"f001.pgm", "f002.ppm"}


@pytest.mark.parametrize("name", ["'same'", "if(frame = 2, 'a/b', string(frame))"])
def test_failed_run_leaves_nothing(spark, tmp_path, name):
    rows = table(spark, [(k, 1, 2, "mono8", b"ab") for k in range(1, 4)]).repartition(3)
    with pytest.raises(Exception, match="name"):
        frame_files.write_frames(rows.withColumn("name", F.expr(name)), str(tmp_path))
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []


def test_frames_of_many_widths_meet_in_a_batch(spark):
    """lines of frames of different sizes, by turns, each with its own fields."""
    rng = np.random.default_rng(7)
    own = {k: rng.integers(0, 65536, (1 + 5 * k % 13, 1 + 7 * k % 19)) for k in range(12)}
    rows = [(k, *x.shape, "mono16", x.astype("<u2").tobytes()) for k, x in own.items()] + [(20, 3, 3, "mono16", b"short"), (21, 2, 2, "mono8", b"abcd")]
    got = {}
    for r in fr.rescale(table(spark, rows).coalesce(1)).collect():
        got.setdefault(r.frame, {})[r.line] = r.levels
    assert {k: [x[i] for i in range(len(x))] for k, x in got.items()} == {k: by_hand(x).tolist() for k, x in own.items()}


def test_fields_take_one_shuffle(spark):
    """a frame's tiles are put together once, where they are first summed."""
    rows = [(k, 9, 9, "mono16", bytes(162)) for k in range(3)]
    plan = fr.fields(fr.tile_extremes(fr.lines(table(spark, rows))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_tiles_leave_the_task_as_partial_extremes(spark):
    """F8: what is shuffled is a frame's tiles, not its lines."""
    levels = np.random.default_rng(8).integers(0, 65536, (400, 30))
    rows = table(spark, [(1, 400, 30, "mono16", levels.astype("<u2").tobytes()), (2, 400, 30, "mono8", bytes(12000))])
    strips = fr.lines(rows)
    assert strips.columns == ["frame", "h", "w", "depth", "line", "raw"] and strips.where("octet_length(raw) = 30 * depth").count() == 800
    got = {(r.frame, r.down, r.across): (r.lowest, r.highest) for r in fr.tile_extremes(strips).collect()}
    across = np.arange(30) * 8 // 30
    want = {(1, a, b): (int(x.min()), int(x.max())) for a in range(8) for b in range(8) for x in [levels[50 * a : 50 * a + 50, across == b]]}
    assert got == want | {(2, a, b): (0, 0) for a in range(8) for b in range(8)}
