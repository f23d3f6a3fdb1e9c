"""Raw camera frames: ``(frame, h, w, format, data)``, a row a frame, checked and brought to eight bits.

``frame`` names one row.  ``data`` holds the lines from the top, without gaps:
one byte a pixel (``mono8``), two, the lower first (``mono16``), or blue,
green and red (``bgr8``).  Frames are taken apart into lines, so that a task
holds the numbers of some lines, never of all of a frame; the frames themselves
are shuffled once, where they meet their fields.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a pixel.
FORMATS = {"mono8": 1, "mono16": 2, "bgr8": 3}
TILES = 8


def pixel_bytes() -> Column:
    """Of the column ``format``; null if it is unknown."""
    return F.expr("CASE format " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in FORMATS.items()) + " END")


def frame_problems(frames: DataFrame) -> DataFrame:
    """``(frame, problem)``: why a frame cannot be used; null where it can.

    A frame without an id, size, format or data has the first of its problems.
    """
    return frames.select(
        "frame",
        F.when(F.col("frame").isNull(), "no id")
        .when(F.least(F.coalesce("h", F.lit(0)), F.coalesce("w", F.lit(0))) < 1, "no size")
        .when(pixel_bytes().isNull(), "unknown format")
        .when(F.col("data").isNull(), "no data")
        .when(F.octet_length("data") != F.col("h").cast("long") * F.col("w") * pixel_bytes(), "wrong length")
        .alias("problem"),
    )


def lines(frames: DataFrame, *more: str) -> DataFrame:
    """``(frame, h, w, depth, line, raw)`` and columns ``more`` of the frames: the lines of grey frames as bytes, ``depth`` of them a pixel; frames without their data in full give none."""
    grey = frames.where(F.col("format").isin("mono8", "mono16") & (F.col("h") > 0) & (F.col("w") > 0)).withColumn("depth", pixel_bytes())
    grey = grey.where(F.octet_length("data") == F.col("h").cast("long") * F.col("w") * F.col("depth"))
    kept = ["frame", "h", "w", "depth"]
    rows = grey.select(*kept, *more, "data", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("line"))
    return rows.select(*kept, *more, "line", F.substring("data", F.col("line") * F.col("w") * F.col("depth") + 1, F.col("w") * F.col("depth")).alias("raw"))


def _levels(raw: pa.Array, w: np.ndarray, depth: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lines of one width and depth: which they are, and the whole numbers that their pixels hold."""
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
    every = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(raw) else np.zeros(0, np.uint8)
    for own_w, own_depth in {*zip(w.tolist(), depth.tolist(), strict=True)}:
        own = (w == own_w) & (depth == own_depth)
        some = every if own.all() else every[np.repeat(own, np.diff(ends))]
        yield np.flatnonzero(own), np.ascontiguousarray(some).view("<u2" if own_depth == 2 else np.uint8).reshape(-1, own_w)


def tile_extremes(strips: DataFrame, tiles: int = TILES) -> DataFrame:
    """``(frame, down, across, lowest, highest)`` of a grid of tiles over ``lines``; a frame of fewer lines or columns has as many tiles as those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w, depth, line = (batch.column(k).to_numpy().astype(np.int64) for k in range(1, 5))
            frame = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy()
            down = line * np.minimum(h, tiles) // h
            for k, levels in _levels(batch.column(5), w, depth):
                wide = min(levels.shape[1], tiles)
                edges = (np.arange(wide) * levels.shape[1] + wide - 1) // wide
                begin = np.flatnonzero(np.r_[True, (np.diff(frame[k]) != 0) | (np.diff(down[k]) != 0)])
                ends = [by.reduceat(by.reduceat(levels, edges, axis=1), begin, axis=0).astype(np.int32).ravel() for by in (np.minimum, np.maximum)]
                first = np.repeat(k[begin], wide)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first)), pa.array(down[first].astype(np.int32)), pa.array(np.tile(np.arange(wide, dtype=np.int32), len(begin))), *map(pa.array, ends)], names=["frame", "down", "across", "lowest", "highest"])

    kind = strips.schema["frame"].dataType.simpleString()
    parts = strips.select("frame", "h", "w", "depth", "line", "raw").mapInArrow(run, f"frame {kind}, down int, across int, lowest int, highest int")
    # dealt by frame alone, so that what puts a frame's tiles together needs no further shuffle
    return parts.repartition("frame").groupBy("frame", "down", "across").agg(F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))


def _around(grid: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The mean, rounded down, over the cells that touch each cell; its own value if none does."""
    total, count = np.zeros_like(grid), np.zeros_like(grid)
    tall, wide = grid.shape[1:]
    values, known = (np.pad(x, ((0, 0), (1, 1), (1, 1))) for x in (np.where(there, grid, 0), there.astype(grid.dtype)))
    for a, b in ((a, b) for a in range(3) for b in range(3) if (a, b) != (1, 1)):
        total += values[:, a : a + tall, b : b + wide]
        count += known[:, a : a + tall, b : b + wide]
    return np.where(count > 0, total // np.maximum(count, 1), grid)


def _grids(extremes: DataFrame, spread: int, rounds: int) -> DataFrame:
    """``(frame, down, across, lowest, highest)``: the fields of a frame in one row, as arrays in order of the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(1)
            ends = np.asarray(cells.offsets) - cells.offsets[0].as_py()
            down, across, lowest, highest = (x.to_numpy().astype(np.int64) for x in cells.flatten().flatten())
            at = np.repeat(np.arange(len(batch)), np.diff(ends)), down, across
            there = np.zeros((len(batch), down.max(initial=0) + 1, across.max(initial=0) + 1), bool)
            there[at] = True
            low, high = np.zeros(there.shape, np.int64), np.zeros(there.shape, np.int64)
            low[at], high[at] = lowest, highest
            low, high = np.maximum(low, _around(low, there) - spread), np.minimum(high, _around(high, there) + spread)
            for _ in range(rounds):
                low, high = np.minimum(low, _around(low, there)), np.maximum(high, _around(high, there))
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (down, across, low[at], high[at])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["frame", "down", "across", "lowest", "highest"])

    kind = extremes.schema["frame"].dataType.simpleString()
    whole = extremes.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("down", "across", "lowest", "highest"))).alias("cells"))  # at most tiles * tiles
    return whole.mapInArrow(run, f"frame {kind}, down array<int>, across array<int>, lowest array<int>, highest array<int>")


def fields(extremes: DataFrame, spread: int = 400, rounds: int = 2) -> DataFrame:
    """The extremes of tiles as fields without outliers and steps.

    An extreme counts up to ``spread`` levels beyond the mean around it, so a
    lamp does not darken its tile; then the fields widen ``rounds`` times to
    the means around them, so neighbours differ little.
    """
    cells = _grids(extremes, spread, rounds).select("frame", F.explode(F.arrays_zip("down", "across", "lowest", "highest")).alias("c"))
    return cells.select("frame", "c.down", "c.across", F.col("c.lowest").cast("long").alias("lowest"), F.col("c.highest").cast("long").alias("highest"))


def rescale(frames: DataFrame, tiles: int = TILES, spread: int = 400, rounds: int = 2) -> DataFrame:
    """``(frame, line, levels)``: ``mono16`` frames in eight bits, each pixel between the fields at its place.

    The fields are known at the middles of tiles and blended linearly between
    them.  Frames of other formats give no rows.
    """
    deep = frames.where("format = 'mono16'")
    grid = _grids(tile_extremes(lines(deep), tiles), spread, rounds).select("frame", "lowest", "highest")
    rows = lines(deep.select("frame", "h", "w", "format", "data").join(grid, "frame"), "lowest", "highest")
    rows = rows.withColumns({"tall": F.least("h", F.lit(tiles)), "wide": F.least("w", F.lit(tiles))})
    rows = rows.withColumn("y", _place("line", "h", "tall")).withColumn("y0", F.floor("y").cast("int")).withColumn("y1", F.least(F.col("y0") + 1, F.col("tall") - 1))
    # a line lies between two rows of the fields
    near = [F.slice(name, F.col(y) * F.col("wide") + 1, F.col("wide")).alias(name + y) for name in ("lowest", "highest") for y in ("y0", "y1")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, w, depth, y = (batch.column(k).to_numpy() for k in (1, 2, 3, 5))
            sizes = np.minimum(w, tiles)
            flat = [batch.column(k).flatten().to_numpy() for k in range(6, 10)]
            for k, levels in _levels(batch.column(4), w, depth):
                n, wide = levels.shape[1], min(levels.shape[1], tiles)
                mask = np.repeat(w == n, sizes)
                a0, a1, b0, b1 = (x[mask].reshape(-1, wide) for x in flat)
                wy = (y[k] - np.floor(y[k]))[:, None]
                x = np.maximum(0.0, np.minimum(wide - 1.0, (np.arange(n) + 0.5) * wide / n - 0.5))
                x0 = np.floor(x).astype(int)
                x1, wx = np.minimum(x0 + 1, wide - 1), x - x0
                a, b = (f[:, x0] * (1 - wx) + f[:, x1] * wx for f in (a0 * (1 - wy) + a1 * wy, b0 * (1 - wy) + b1 * wy))
                out = np.floor(255 * np.maximum(0.0, np.minimum(1.0, (levels - a) / np.maximum(b - a, 1.0))) + 0.5).astype(np.int32)
                own = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * n), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), pa.array(line[k]), own], names=["frame", "line", "levels"])

    kind = frames.schema["frame"].dataType.simpleString()
    return rows.select("frame", "line", "w", "depth", "raw", "y", *near).mapInArrow(run, f"frame {kind}, line int, levels array<int>")


def _place(i: Column | str, size: str, cells: str) -> Column:
    """Where a pixel's middle is among the middles of ``cells`` equal parts of ``size``; beyond the outer ones, there."""
    i = F.col(i) if isinstance(i, str) else i
    return F.greatest(F.lit(0.0), F.least(F.col(cells) - F.lit(1.0), (i + F.lit(0.5)) * F.col(cells) / F.col(size) - F.lit(0.5)))


def eight_bits(frames: DataFrame, tiles: int = TILES, spread: int = 400, rounds: int = 2) -> DataFrame:
    """Usable frames with ``mono16`` ones rescaled to ``mono8``; other columns are dropped."""
    good = frames.join(frame_problems(frames).where("problem IS NULL").select("frame"), "frame", "left_semi").select("frame", "h", "w", "format", "data")
    byte = F.expr("array_join(transform(levels, l -> lpad(hex(l), 2, '0')), '')")
    strips = rescale(good, tiles, spread, rounds).select("frame", F.struct("line", byte.alias("hex")).alias("s"))
    made = strips.groupBy("frame").agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["hex"]), "")).alias("data"))
    deep = good.where("format = 'mono16'").select("frame", "h", "w", F.lit("mono8").alias("format")).join(made, "frame")
    return good.where("format != 'mono16'").unionByName(deep)
