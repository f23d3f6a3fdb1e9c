"""Hard negatives by distributed radix selection over integer scores.

Every anchor is scored against every row.  Which rows come first in a window
of scores is never found by sorting: each task counts its rows of a window by
the digit of their score, Spark adds the counts, and the digit that holds the
k-th row from above is refined in the next round, by score first and, among
rows of one score, by id.  When a window has at most ``FEW`` rows down to the
k-th one's bucket, only those rows are gathered and put in order.

A task needs to send only its digits down to its own k-th row, as the k-th of
all rows cannot come later: at most k counts a window and task, whatever the
number of rows and however many of them tie.

Anchors are taken in panels of bounded size, broadcast to the rows, which stay
where they are; a row is read once a panel and round and meets thousands of
anchors there, so that the products are the cost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spill import Scratch

#: Digits of a round.
DIGITS = 256
#: A window with no more rows than this down to its bucket is gathered.
FEW = 64
#: Anchors of a panel, and its components.
PANEL, PANEL_SIZE = 8192, 1 << 23
#: Scores held at a time.
SCORES = 1 << 21


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of 64-bit integers; shorter ones end in zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where no partial sum can leave its integers."""
    width = min(left.shape[1], right.shape[1])
    left, right = left[:, :width], right[:, :width]
    bound = float(np.sqrt((left.astype(float) ** 2).sum(1).max(initial=0) * (right.astype(float) ** 2).sum(1).max(initial=0)))
    kind = next((k for k, whole in EXACT.items() if bound < whole), np.int64)
    return left.astype(kind) @ right.astype(kind).T


#: Up to where a type's sums are whole numbers without gaps.
EXACT = {np.float32: 1 << 24, np.float64: 1 << 53}


class Windows:
    """Scores from ``low`` to ``high`` of rows that an anchor may take; the best of each are wanted.

    The bucket is what may still hold the last wanted row: a range of scores,
    and once it is one score, a range of ids.  ``above`` rows come before it.
    Windows are in the order of their anchors.
    """

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.anchor, self.high, self.digits = anchor, high, DIGITS
        self.bucket_low, self.bucket_high = low.copy(), high.copy()
        self.id_low, self.id_high = np.zeros_like(low), np.zeros_like(low)
        self.by_id = np.zeros(len(low), bool)
        self.above = np.zeros_like(low)
        #: Windows that take rows at all, and those whose bucket is not yet found.
        self.open = low <= high
        self.asked = self.open.copy()


def _width(low: np.ndarray, high: np.ndarray, digits: int) -> np.ndarray:
    """Width of a digit where ``low`` to ``high`` is dealt to ``digits``; unsigned, so that no range is too wide."""
    return (high.astype(np.uint64) - low.astype(np.uint64)) // np.uint64(digits) + np.uint64(1)


def _digit(value: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    return ((value.astype(np.uint64) - low.astype(np.uint64)) // width).astype(np.int64)


class Panel:
    """Anchors: row keys, ids, labels and vectors."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.keys, self.ids, self.labels = (batch.column(i).to_numpy() for i in range(3))
        self.vectors = _matrix(batch.column(3))


class _Search:
    """What a task looks for: the windows ``asked`` of a panel's anchors, in rows of the anchors' own label if ``same``, else of others."""

    def __init__(self, panel: Panel, windows: Windows, asked: np.ndarray, same: bool) -> None:
        self.panel, self.windows, self.asked, self.same = panel, windows, asked, same
        self.first = np.searchsorted(windows.anchor, np.arange(len(panel.keys) + 1))
        self.most = int(np.diff(self.first).max(initial=0))
        #: Lowest and highest score that any window of an anchor asks for.
        self.low, self.high = np.full(len(panel.keys), np.iinfo(np.int64).max), np.full(len(panel.keys), np.iinfo(np.int64).min)
        np.minimum.at(self.low, windows.anchor[asked], windows.bucket_low[asked])
        np.maximum.at(self.high, windows.anchor[asked], windows.high[asked])

    def _blocks(self, keys: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        own, busy = self.panel.labels, self.low <= self.high
        for label in np.unique(own[busy]) if self.same else [None]:
            mine, rows = np.flatnonzero(busy & (own == label) if self.same else busy), np.flatnonzero(labels == label) if self.same else np.arange(len(keys))
            step = max(1, SCORES // max(1, len(rows)))
            for k in range(0, len(mine) if len(rows) else 0, step):
                at = mine[k : k + step]
                taken = keys[rows][None, :] != self.panel.keys[at][:, None] if self.same else labels[None, :] != own[at][:, None]
                yield at, rows, _products(self.panel.vectors[at], vectors[rows]), taken

    def found(self, keys: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(window, row, score)`` of rows from a window's bucket up."""
        for at, rows, scores, taken in self._blocks(keys, labels, vectors):
            whole = EXACT.get(scores.dtype.type, (1 << 63) - 1)
            low, high = (np.clip(x[at], -whole, whole).astype(scores.dtype)[:, None] for x in (self.low, self.high))
            taken &= scores >= low
            taken &= scores <= high
            i, j = np.nonzero(taken)
            score, anchor = scores[i, j].astype(np.int64), at[i]
            for slot in range(self.most):
                w = self.first[anchor] + slot
                some = np.flatnonzero(w < self.first[anchor + 1])
                w = w[some]
                fits = self.asked[w] & (score[some] >= self.windows.bucket_low[w]) & (score[some] <= self.windows.high[w])
                yield w[fits], rows[j[some[fits]]], score[some[fits]]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(0, len(batch), 4096):
            part = batch.slice(k, 4096)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_numpy(), _matrix(part.column(3))


def _first_of(windows: np.ndarray, need: int, *order: np.ndarray) -> np.ndarray:
    """Places of each window's first ``need`` entries by ``order``."""
    by = np.lexsort((*order[::-1], windows))
    w = windows[by]
    begin = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, np.int64)
    rank = np.arange(len(w)) - np.repeat(begin, np.diff(np.r_[begin, len(w)]))
    return by[rank < need]


def _counted(rows: DataFrame, known: Broadcast, need: int, same: bool) -> DataFrame:
    """``(window, digit, n, left)``: rows by the digits of a round, from the best on; ``left`` rows of the bucket are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        panel, windows = known.value
        search = _Search(panel, windows, windows.asked, same)
        digits = windows.digits
        width, id_width = _width(windows.bucket_low, windows.bucket_high, digits), _width(windows.id_low, windows.id_high, digits)
        cells = counts = np.zeros(0, np.int64)
        for keys, ids, labels, vectors in _batches(batches):
            new = []
            for w, row, score in search.found(keys, labels, vectors):
                inside = (score <= windows.bucket_high[w]) & (~windows.by_id[w] | ((ids[row] >= windows.id_low[w]) & (ids[row] <= windows.id_high[w])))
                w, score, own = w[inside], score[inside], ids[row[inside]]
                new.append(w * digits + np.where(windows.by_id[w], _digit(own, windows.id_low[w], id_width[w]), _digit(windows.bucket_high[w], score, width[w])))
            found, n = np.unique(np.concatenate([np.zeros(0, np.int64), *new]), return_counts=True)
            both = np.r_[cells, found]
            cells, of = np.unique(both, return_inverse=True)
            counts = np.bincount(of, np.r_[counts, n].astype(float), len(cells)).astype(np.int64)
            # a task's own last wanted row bounds what it has to tell
            w = cells // digits
            begin = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, np.int64)
            before = np.cumsum(counts) - counts
            before -= np.repeat(before[begin], np.diff(np.r_[begin, len(w)]))
            needed = before < need - windows.above[w]
            cells, counts = cells[needed], counts[needed]
        w = cells // digits
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(cells % digits), pa.array(counts), pa.array(need - known.value[1].above[w])], names=["window", "digit", "n", "left"])

    return rows.mapInArrow(run, "window long, digit long, n long, left long").groupBy("window", "digit").agg(F.sum("n").alias("n"), F.first("left").alias("left"))


def _refine(rows: DataFrame, windows: Windows, panel: Panel, need: int, same: bool, ids: tuple[int, int]) -> None:
    """Narrow every window's bucket until few rows are left down to it; a round is one job."""
    by = Window.partitionBy("window").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)  # at most DIGITS rows a window
    while windows.asked.any():
        known = rows.sparkSession.sparkContext.broadcast((panel, windows))
        counts = _counted(rows, known, need, same).withColumn("upto", F.sum("n").over(by))
        # the last digit that begins before enough rows are met; at most a row for each window of the panel
        bucket = counts.where(F.col("upto") - F.col("n") < F.col("left")).groupBy("window").agg(F.max("digit").alias("digit"), F.max("upto").alias("upto"), F.max_by("n", "digit").alias("n"))
        found = {r["window"]: (r["digit"], r["upto"], r["n"]) for r in bucket.toLocalIterator()}
        known.destroy()
        for w in np.flatnonzero(windows.asked).tolist():
            if w not in found:  # no row at all
                windows.open[w] = windows.asked[w] = False
                continue
            digit, upto, n = found[w]
            total = int(windows.above[w]) + upto
            low, high = (windows.id_low, windows.id_high) if windows.by_id[w] else (windows.bucket_low, windows.bucket_high)
            a, b = int(low[w]), int(high[w])
            step = (b - a) // windows.digits + 1
            if windows.by_id[w]:
                low[w], high[w] = a + digit * step, min(a + (digit + 1) * step - 1, b)
            else:
                low[w], high[w] = max(a, b - (digit + 1) * step + 1), b - digit * step
            if total <= FEW or total < need or (windows.by_id[w] and step == 1):
                windows.asked[w] = False
                continue
            windows.above[w] += upto - n
            if step == 1:  # more ties than are gathered: the smallest ids
                windows.by_id[w], windows.id_low[w], windows.id_high[w] = True, *ids


def _gathered(rows: DataFrame, windows: Windows, panel: Panel, need: int, same: bool) -> DataFrame:
    """``(window, score, id, rank)`` of the wanted rows, from those down to the windows' buckets."""
    known = rows.sparkSession.sparkContext.broadcast((panel, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        panel, windows = known.value
        search = _Search(panel, windows, windows.open, same)
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        for keys, ids, labels, vectors in _batches(batches):
            parts = [held]
            for w, row, score in search.found(keys, labels, vectors):
                own = ids[row]
                keep = ~windows.by_id[w] | (score > windows.bucket_low[w]) | (own <= windows.id_high[w])
                parts.append((w[keep], score[keep], own[keep]))
            held = tuple(map(np.concatenate, zip(*parts, strict=True)))
            first = _first_of(held[0], need, -held[1], held[2])
            held = tuple(x[first] for x in held)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["window", "score", "id"])

    order = Window.partitionBy("window").orderBy(F.desc("score"), "id")  # at most FEW rows, or a task's first of one id
    return rows.mapInArrow(run, "window long, score long, id long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= need)


def _panels(anchors: DataFrame, size: int) -> Iterator[Panel]:
    """The anchors, ``size`` at a time in the order of their row keys."""
    last = -1
    while len(some := anchors.where(F.col("key") > last).orderBy("key").limit(size).toArrow().combine_chunks()):
        panel = Panel(some.to_batches()[0])
        last = int(panel.keys[-1])
        yield panel


def mine_hard_negatives(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, panel: int = PANEL) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    A component x counts as ``floor(scale * x)``, a score is the inner product
    with the anchor; higher scores come first, then smaller ids.  For each row
    that satisfies ``anchors`` and each of its first ``positives`` other rows
    of the same label, the first ``negatives`` rows of other labels whose
    score is ``low`` to ``high`` percent of the positive's.

    Rows with a null id, label or vector, or a null or non-finite component,
    take no part.  Vectors of different lengths count as if the shorter ended
    in zeros; empty ones score 0.  Rows that repeat an id are rows of their
    own: each can be the other's positive, and each that is an anchor has its
    results.  Scores beyond 64 bits are an error.  Anchors or positives
    without a negative give no row; other columns are ignored; an empty table
    gives an empty one.
    """
    spark = rows.sparkSession
    quantised = F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))  # nan is above infinity here
    chosen = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    valid = chosen.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    columns, kind = ["key", "id", "label", "vector"], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    with Scratch(spark) as scratch:
        table = scratch.stored(valid.select(F.monotonically_increasing_id().alias("key"), "id", "label", quantised.alias("vector"), "is_anchor"), "rows")
        own = scratch.stored(table.where("is_anchor").select(columns), "anchors")
        squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        sizes = table.agg(F.min("id").alias("a"), F.max("id").alias("b"), F.max(F.size("vector")).alias("width"), F.max(squares).alias("longest")).first()
        done = False
        for n, part in enumerate(_panels(own, max(1, min(panel, PANEL_SIZE // max(1, sizes["width"] or 0))))):
            found = _mined(table.select(columns), part, positives, negatives, low, high, (sizes["a"], sizes["b"]), sizes["longest"])
            found.write.parquet(f"{scratch.folder}/mined/panel={n}")
            done = True
        scratch.drop("rows", "anchors")
    if not done:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(f"{scratch.folder}/mined").drop("panel")


def _percent(share: int, score: np.ndarray) -> np.ndarray:
    """``share`` percent of each score, rounded down, without leaving 64 bits."""
    return share * (score // 100) + share * (score % 100) // 100


def _mined(rows: DataFrame, panel: Panel, positives: int, negatives: int, low: int, high: int, ids: tuple[int, int], longest: float) -> DataFrame:
    """The results of a panel's anchors; ``longest`` is the greatest square length of a row."""
    bound = np.ceil(np.sqrt((panel.vectors.astype(float) ** 2).sum(1) * longest)) + 1
    if (bound >= 2**62).any():
        raise ValueError("scores do not fit 64-bit integers; use a smaller scale")
    bound = bound.astype(np.int64)
    windows = Windows(np.arange(len(panel.keys)), -bound, bound)
    _refine(rows, windows, panel, positives, True, ids)
    best = _gathered(rows, windows, panel, positives, True).orderBy("window", "rank").toPandas()  # the panel's anchors times the positives
    anchor, score = best["window"].to_numpy(np.int64), best["score"].to_numpy(np.int64)
    windows = Windows(anchor, -_percent(low, -score), _percent(high, score))  # low * p <= 100 * s <= high * p
    _refine(rows, windows, panel, negatives, False, ids)
    pairs = pa.table({"of": np.arange(len(anchor)), "anchor_id": panel.ids[anchor], "positive_id": best["id"].to_numpy(np.int64), "positive_score": score})
    joined = _gathered(rows, windows, panel, negatives, False).join(F.broadcast(rows.sparkSession.createDataFrame(pairs)), F.col("window") == F.col("of"))
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
