"""Substring dedup by global digests of lines and of word windows.

Units are whole lines of at least ``line_words`` words and all windows of
``min_words`` words.  Words are compared with A-Z lower-cased and white space
as one separator.  Units with equal digest are occurrences of one text; the
earliest by (doc_id, place) stays and the words of all others go, in ranges of
code points of the original text.

Repeats inside a document are seen by the task that reads it, which sends each
unit once a document.  A digest's earliest document is then a minimum with
map-side combination; a digest that a third of all documents hold is a skewed
key whose side of the join is broadcast (``hot_keys``).

Windows are compared in two steps.  The smallest gram hash of every window
marks an anchor; a repeated window's is repeated, so only windows whose own
anchor is repeated go to the comparison.  Two different units count as one
with a chance of 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hot_keys import joined
from .spill import Scratch
from .words import BLANKS, U64, Words, mix, slices, text_buffers

_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _extremes(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of every ``width`` neighbours of ``x``, by doubling."""
    n, size = max(0, len(x) - width + 1), 1
    while 2 * size <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[:n], x[width - size : width - size + n])


class _Prefix:
    """Digests of word runs of a slice in constant time a run."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        with np.errstate(over="ignore"):
            up, self.down = np.full(n, _STEP, np.uint64), np.full(n, _BACK, np.uint64)
            up[:1] = self.down[:1] = 1
            up, self.down = np.cumprod(up), np.cumprod(self.down)
            self.total = np.r_[U64(0), np.cumsum(hashes * up)]

    def runs(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[stop] - self.total[start]) * self.down[start] + (stop - start).astype(np.uint64) * U64(_STEP))


def _anchor_marks(w: Words, prefix: _Prefix, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of a slice's grams, the least one of every window (0: not in one row), and the anchors' places."""
    n, gram = len(w.hashes), max(1, min_words // 2)
    reach = min_words - gram + 1
    if n < min_words:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int64)
    at = np.arange(n - gram + 1)
    digest = prefix.runs(at, at + gram)
    least = _extremes(digest, reach, np.minimum)
    rows = w.rows
    least[rows[: n - min_words + 1] != rows[min_words - 1 :]] = 0
    pad = np.zeros(reach - 1, np.uint64)
    return digest, least, np.flatnonzero(_extremes(np.r_[pad, least, pad], reach, np.maximum) == digest)


def _anchors(min_words: int):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for w in slices(*text_buffers(batch.column(1)), BLANKS, lower=True):
                digest, _, at = _anchor_marks(w, _Prefix(w.hashes), min_words)
                rows = w.rows[at]
                own = at - (np.cumsum(w.counts) - w.counts)[rows]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (digest[at].view(np.int64), keys[rows + w.lo], own)], names=["digest", "key", "at"])

    return anchors


def _merged(rows: np.ndarray, start: np.ndarray, stop: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word runs with their code points, joined where they touch or overlap inside a row."""
    order = np.lexsort((stop, start, rows))
    rows, start, a = rows[order], start[order], a[order]
    stop, b = (np.maximum.accumulate(rows << 32 | x[order]) & 0xFFFFFFFF for x in (stop, b))
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (start[1:] > stop[:-1])
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(rows)][: len(first)] - 1
    return rows[first], start[first], stop[last], a[first], b[last]


def _candidates(min_words: int, line_words: int):
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, cuts = text_buffers(batch.column(2))
            for w in slices(data, cuts, BLANKS, lower=True):
                n = len(w.hashes)
                if not n:
                    continue
                piece, rows, prefix = data[cuts[w.lo] : cuts[w.hi]], w.rows, _Prefix(w.hashes)
                before = np.cumsum(w.counts) - w.counts
                grams, least, _ = _anchor_marks(w, prefix, min_words)
                own = batch.column(3).slice(w.lo, w.hi - w.lo)
                held = pa.compute.list_value_length(own).fill_null(0).to_numpy(zero_copy_only=False)
                twice = np.full(len(grams), ~U64(0))
                at = own.flatten().to_numpy(zero_copy_only=False) + np.repeat(before, held)
                twice[at] = grams[at]
                windows = np.flatnonzero(_extremes(twice, min_words - max(1, min_words // 2) + 1, np.minimum) == least)
                feeds = np.cumsum(piece == 10, dtype=np.int64)
                last = np.ones(n, bool)
                last[:-1] = (rows[1:] != rows[:-1]) | (feeds[w.starts[1:]] != feeds[w.ends[:-1] - 1])
                stop = np.flatnonzero(last) + 1
                start = np.r_[0, stop[:-1]]
                lines = (stop - start >= line_words) & (stop - start < min_words)
                start, stop = np.r_[start[lines], windows], np.r_[stop[lines], windows + min_words]
                digest, owner = prefix.runs(start, stop), rows[start]
                _, first, group = np.unique(mix(digest + owner.astype(np.uint64) * U64(_STEP)), return_index=True, return_inverse=True)
                first = first[group]
                again = first != np.arange(len(start))
                points = np.r_[0, np.cumsum((piece & 0xC0) != 0x80, dtype=np.int64)]
                base = points[cuts[w.lo : w.hi] - cuts[w.lo]]

                def table(digest, owner, start, stop, a, b, again):
                    columns = [digest.view(np.int64), keys[owner + w.lo], ids[owner + w.lo], start - before[owner] << 32 | stop - start, a << 32 | b, np.full(len(owner), again)]
                    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["digest", "key", "doc_id", "place", "span", "again"])

                def spans(owner, start, stop):
                    return points[w.starts[start]] - base[owner], points[w.ends[stop - 1]] - base[owner]

                o, s, e = owner[~again], start[~again], stop[~again]
                yield table(digest[~again], o, s, e, *spans(o, s, e), False)
                # what overlaps its own first occurrence loses only the words beyond it
                o, s, e = owner[again], np.maximum(start, stop[first])[again], stop[again]
                o, s, e, a, b = _merged(o, s, e, *spans(o, s, e))
                yield table(np.zeros(len(o), np.int64), o, s, e, a, b, True)

    return candidates


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = batch.column(2)
        rows = np.repeat(np.arange(len(held)), pa.compute.list_value_length(held).to_numpy(zero_copy_only=False))
        place, span = (x.to_numpy(zero_copy_only=False) for x in held.flatten().flatten())
        start = place >> 32
        rows, start, stop, a, b = _merged(rows, start, start + (place & 0xFFFFFFFF), span >> 32, span & 0xFFFFFFFF)
        words = np.bincount(rows, stop - start, len(held)).astype(np.int64)
        cuts = np.searchsorted(rows, np.arange(len(held) + 1)).astype(np.int32)
        removed = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], names=["start", "end"]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), removed, batch.column(1)], names=["doc_id", "n_removed_words", "removed", "text_hash"])


_PASSAGES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_removed_words", T.LongType()), T.StructField("removed", _SPANS), T.StructField("text_hash", T.LongType())])


def _sum(counts: DataFrame) -> int:
    return counts.agg(F.sum("n")).first()[0] or 0


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, line_words: int = 5) -> DataFrame:
    """``(doc_id, n_removed_words, removed, text_hash)`` of the texts that lose a passage or a line.

    Windows of ``min_words`` words and whole lines of at least ``line_words``
    words go where they stand in a document of a smaller id or earlier in their
    own text; shorter lines stay, as most are headings and closings.  Words are
    compared with A-Z lower-cased.  An occurrence that overlaps the first
    one of its own text loses the words beyond it.  Rows with a null id take no
    part.  Rows that repeat an id do not lose what the id's other rows hold;
    ``text_hash`` (xxhash64 of id and text) tells them apart.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    rows = rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    with Scratch(docs.sparkSession) as scratch:
        anchors = scratch.stored(rows.select("key", "text").mapInArrow(_anchors(min_words), "digest long, key long, at long"), "anchors")
        twice = scratch.stored(anchors.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "n"), "twice")
        known = joined(anchors, twice, "digest", "d", "n", _sum(twice)).groupBy(F.col("key").alias("of")).agg(F.collect_set("at").alias("at"))
        runs = rows.join(known, F.col("key") == F.col("of"), "left").select("key", "doc_id", "text", "at").mapInArrow(_candidates(min_words, line_words), "digest long, key long, doc_id long, place long, span long, again boolean")
        runs = scratch.stored(runs, "runs")
        scratch.drop("anchors", "twice")
        units = runs.where("not again")
        first = units.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").select(F.col("digest").alias("d"), "first", "n")
        first = scratch.stored(first, "first")
        across = joined(units, first, "digest", "d", "n", _sum(first)).where("doc_id > first")
        later = across.select("doc_id", "key", "place", "span").unionAll(runs.where("again").select("doc_id", "key", "place", "span"))
        found = scratch.stored(later.groupBy("doc_id", "key").agg(F.collect_set(F.struct("place", "span")).alias("runs")).mapInArrow(_joined, _PASSAGES), "found")
        scratch.drop("runs", "first")
    return found


def without_spans(text, removed):
    """``text`` without the code-point ranges ``removed`` (sorted, disjoint; null: none)."""
    n = F.size("removed")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(removed, lambda s: s["end"]))
    ends = F.concat(F.transform(removed, lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.substring(text, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")))
    return F.when(removed.isNull() | (n == 0), text).otherwise(F.array_join(pieces, ""))


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", min_words: int = 50, line_words: int = 5) -> DataFrame:
    """``docs`` without the words that ``repeated_passages`` finds.

    Every row and column stays, also of null ids and texts; ``chars_col`` is
    set anew where a text changed.  Rows that repeat an id lose what is
    repeated in their own text only.  Columns may have any names.
    """
    spans = repeated_passages(docs, id_col=id_col, text_col=text_col, min_words=min_words, line_words=line_words).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "removed")
    names = docs.columns
    own_id, own_text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), own_id.alias("__of"), F.xxhash64(own_id, own_text).alias("__key"))
    both = own.join(spans, (F.col("__of") == F.col("__id")) & (F.col("__key") == F.col("__hash")), "left").withColumn("__text", without_spans(F.col(f"row.`{text_col}`"), F.col("removed")))

    def column(c: str):
        old = F.col(f"row.`{c}`")
        if c == text_col:
            return F.col("__text").alias(c)
        if c == chars_col:
            return F.when(F.col("removed").isNull(), old).otherwise(F.char_length("__text")).cast(docs.schema[c].dataType).alias(c)
        return old.alias(c)

    return both.select(*map(column, names))
