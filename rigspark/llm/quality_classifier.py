"""Quality classifier: a byte-level convolutional network in NumPy.

Bytes are embedded; learned filters eight bytes wide run over the whole text
in steps of four.  Their responses are max-pooled over overlapping chunks of
512 bytes, one every 256, that cover the document.  A small dense layer turns
each chunk's pooled responses into a logit, and the mean of a document's
logits into one probability.

It is trained on the driver from a bounded sample of the labelled rows:
``per_class`` documents a class of at most ``most_bytes``, chosen by a hash of
their id, with all their chunks; each document has the same weight.  Scoring
reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import text_buffers

STEP, EMBED, FILTERS, HIDDEN = 4, 4, 32, 16
BLOCK = 256
GROUPS = BLOCK // STEP
SLICE = 1 << 19


class ByteConv:
    """Weights: byte embedding e, filter halves w and x with bias b, dense layer u, c and output v, d."""

    NAMES = ("e", "w", "x", "b", "u", "c", "v", "d")

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        width = STEP * EMBED
        shapes = {"e": (256, EMBED), "w": (width, FILTERS), "x": (width, FILTERS), "b": (FILTERS,), "u": (FILTERS, HIDDEN), "c": (HIDDEN,), "v": (HIDDEN,), "d": (1,)}
        scale = {"e": 0.5, "w": 0.25, "x": 0.25, "b": 0.0, "u": 0.2, "c": 0.0, "v": 0.3, "d": 0.0}
        for name, shape in shapes.items():
            setattr(self, name, (rng.standard_normal(shape) * scale[name]).astype(np.float32))

    def responses(self, data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Filter responses at every step of padded bytes; a document's last step sees nothing of the next one."""
        a = self.e[data].reshape(-1, STEP * EMBED)
        out = a @ self.w
        ahead = (a @ self.x)[1:]
        out[:-1] += ahead
        ends = firsts[1:] - 1
        out[ends] -= ahead[ends]
        out += self.b
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(pooled, 0) @ self.u + self.c, 0) @ self.v + self.d[0]

    def scores(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """A probability for each text; an empty one is a chunk of padding."""
        sizes = np.diff(cuts)
        blocks = np.maximum(-(-sizes // BLOCK), 1)
        firsts = np.cumsum(blocks) - blocks
        out = np.empty(len(sizes))
        lo = 0
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(firsts + blocks, firsts[lo] + SLICE // BLOCK, "right")))
            tops = np.concatenate([self._pooled(data[cuts[k] : cuts[k + 1]]) for k in (lo,)]) if hi == lo + 1 else self._pooled_rows(data, cuts, firsts, blocks, lo, hi)
            own = blocks[lo:hi]
            at = np.cumsum(own) - own
            chunk = tops.copy()
            chunk[:-1] = np.maximum(tops[:-1], tops[1:])
            last = at + own - 1
            chunk[last] = tops[last]
            logit = self.logits(chunk)
            # a document of several blocks has one chunk less than blocks
            logit[last[own > 1]] = 0
            total = np.add.reduceat(logit, at)
            out[lo:hi] = total / np.maximum(own - 1, 1)
            lo = hi
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    def _pooled_rows(self, data, cuts, firsts, blocks, lo, hi) -> np.ndarray:
        padded = np.zeros(int(firsts[hi - 1] + blocks[hi - 1] - firsts[lo]) * BLOCK, np.uint8)
        sizes = np.diff(cuts[lo : hi + 1])
        spots = np.arange(cuts[hi] - cuts[lo]) + np.repeat((firsts[lo:hi] - firsts[lo]) * BLOCK - (cuts[lo:hi] - cuts[lo]), sizes)
        padded[spots] = data[cuts[lo] : cuts[hi]]
        return self.responses(padded, (firsts[lo:hi] - firsts[lo]) * GROUPS).reshape(-1, GROUPS, FILTERS).max(1)

    def _pooled(self, text: np.ndarray) -> np.ndarray:
        """Block maxima of one text, a piece at a time; pieces overlap by the step that the next one sees."""
        n = max(1, -(-len(text) // BLOCK))
        padded = np.zeros((n + 1) * BLOCK, np.uint8)
        padded[: len(text)] = text
        parts = []
        for k in range(0, n, SLICE // BLOCK):
            m = min(n, k + SLICE // BLOCK)
            piece = padded[k * BLOCK : m * BLOCK + STEP * (m < n)]
            parts.append(self.responses(piece, np.zeros(1, np.int64))[: (m - k) * GROUPS].reshape(-1, GROUPS, FILTERS).max(1))
        return np.concatenate(parts)

    def train(self, chunks: np.ndarray, labels: np.ndarray, weights: np.ndarray, *, epochs: int = 5, batch: int = 64, rate: float = 4e-3, seed: int = 11) -> ByteConv:
        """Adam on the weighted cross-entropy of chunks (rows of two blocks)."""
        rng = np.random.default_rng(seed)
        first, second = {n: 0.0 for n in self.NAMES}, {n: 0.0 for n in self.NAMES}
        steps = 0
        for _ in range(epochs):
            order = rng.permutation(len(chunks))
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                grads = self._gradient(chunks[rows], labels[rows], weights[rows])
                steps += 1
                for n in self.NAMES:
                    g = grads[n]
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.999 * second[n] + 0.001 * g * g
                    move = rate * (first[n] / (1 - 0.9**steps)) / (np.sqrt(second[n] / (1 - 0.999**steps)) + 1e-8)
                    setattr(self, n, (getattr(self, n) - move).astype(np.float32))
        return self

    def _gradient(self, chunks: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        size, per = len(chunks), 2 * GROUPS
        data = chunks.reshape(-1)
        z = self.responses(data, np.arange(size) * per).reshape(size, per, FILTERS)
        at = z.argmax(1)
        top = np.take_along_axis(z, at[:, None, :], 1)[:, 0]
        pooled = np.maximum(top, 0)
        pre = pooled @ self.u + self.c
        hidden = np.maximum(pre, 0)
        logit = hidden @ self.v + self.d[0]
        up = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) * weights / size
        g = {"v": hidden.T @ up, "d": np.array([up.sum()])}
        back = np.outer(up, self.v) * (pre > 0)
        g["u"], g["c"] = pooled.T @ back, back.sum(0)
        back = (back @ self.u.T) * (top > 0)
        g["b"] = back.sum(0)
        groups = data.reshape(-1, STEP)
        spot = at + np.arange(size)[:, None] * per
        inner = (at < per - 1).astype(np.float32)
        g["e"] = np.zeros_like(self.e)
        for name, where, weight in (("w", spot, back), ("x", np.minimum(spot + 1, len(groups) - 1), back * inner)):
            seen = groups[where]
            g[name] = np.einsum("bf,bfk->kf", weight, self.e[seen].reshape(size, FILTERS, -1))
            into = weight[:, :, None] * getattr(self, name).T[None]
            np.add.at(g["e"], seen.reshape(-1), into.reshape(-1, EMBED))
        return g


def chunks_of(text: str | None) -> np.ndarray:
    """All chunks of a text, padded with zero bytes; a row is two blocks."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    blocks = max(2, -(-len(data) // BLOCK))
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, 2 * BLOCK)[::BLOCK]


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 2000, most_bytes: int = 1 << 16) -> ByteConv:
    """The network, from a bounded sample of rows that are not held out.

    At most ``per_class`` ids a class are drawn, and of these the texts of at
    most ``most_bytes`` are used; an id with several texts gives one of them.
    Ids whose labels contradict each other are left out.  With no labelled
    text of one of the classes the untrained network is returned.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~_held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z")).where("y = z")
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class).select("id", "y")
        chosen = part if chosen is None else chosen.unionAll(part)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") <= most_bytes)
    rows = rows.join(F.broadcast(chosen), "id")  # at most 2 * per_class ids
    sample = rows.groupBy("id", "y").agg(F.min("text").alias("text")).collect()  # bounded by per_class and most_bytes
    sample.sort(key=lambda r: (r["id"], r["y"]))
    net = ByteConv()
    if len({r["y"] for r in sample}) < 2:
        return net
    parts = [chunks_of(r["text"]) for r in sample]
    sizes = np.array([len(p) for p in parts])
    weights = np.repeat(sizes.mean() / sizes, sizes).astype(np.float32)
    return net.train(np.concatenate(parts), np.repeat([float(r["y"]) for r in sample], sizes), weights)


def score_quality(docs: DataFrame, net: ByteConv, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of each row, from its text alone.

    A null text is the empty one.  Null ids are not held out; repeated rows
    keep a row each.  Texts of any length are scored whole, a piece at a time;
    an empty table stays empty.  Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = sent.value.scores(*text_buffers(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
