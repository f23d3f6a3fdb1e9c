"""Benchmark decontamination by suffix arrays over the training words.

Every shard, a run of documents of bounded size, becomes one sequence of word
numbers with a break after each document.  Its suffix array is sorted by
prefix doubling.  Every suffix of a benchmark item is binary-searched in it by
its first words, all at once: a window's occurrences are a range of the array,
and the words they cover in their documents are hit.  From there the matches
are followed to their ends, which gives each document's longest verbatim match
and its places.

The benchmark is the stated query set.  It is broadcast in blocks of bounded
bytes, all of which a task searches in the same suffix array.  A benchmark
beyond ``PASS_BYTES`` takes several passes over the documents, whose findings
are merged by id and text, so that the number of blocks and passes does not
change the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import NOT_ALNUM, U64, mix, slices, text_buffers

SHARD_WORDS = 1 << 20
BLOCK_BYTES = 8 << 20
#: Benchmark text that an executor's Python worker holds at once, as hashes of about the same size.
PASS_BYTES = 256 << 20


class SuffixArray:
    """Suffixes of ``words`` (0 ends a document) sorted by their first ``depth`` words or more."""

    def __init__(self, words: np.ndarray, depth: int) -> None:
        self.words = words
        n = len(words)
        rank = words.astype(np.int64)
        width = 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: n - width if n > width else 0] = rank[width:] + 1
            # a suffix that has met its document's break is already told apart from longer ones by the break
            key = rank * (int(rank.max(initial=0)) + 2) + ahead
            order = np.argsort(key)
            key = key[order]
            fresh = np.r_[False, key[1:] != key[:-1]] if n else np.zeros(0, bool)
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(fresh)
            width *= 2
            rank = new
            if width >= depth or fresh.sum() == n - 1:
                self.order = order
                return

    def bounds(self, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query row, the range of suffixes that begin with its first ``length`` words."""
        low, high = self._search(queries, lengths, False), self._search(queries, lengths, True)
        return low, high

    def _search(self, queries: np.ndarray, lengths: np.ndarray, after: bool) -> np.ndarray:
        n = len(self.words)
        padded = np.r_[self.words, np.zeros(queries.shape[1], self.words.dtype)]
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), n, np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = self.order[np.minimum(mid, n - 1)]
            sign = np.zeros(len(queries), np.int8)
            for k in range(queries.shape[1]):
                word = padded[at + k]
                undecided = (sign == 0) & (k < lengths)
                sign = np.where(undecided, np.sign(word.astype(np.int64) - queries[:, k]).astype(np.int8), sign)
            right = open_ & ((sign < 0) | (after & (sign == 0)))
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        return lo


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - lengths, lengths) + np.repeat(starts, lengths)


@dataclass
class Block:
    """Items of the benchmark: their names, the hashes of all their words, and how many words each has."""

    names: list[str]
    hashes: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[object, str | None]]) -> Block:
        found = list(slices(*text_buffers(pa.array([t for _, t in items], pa.string())), NOT_ALNUM, lower=True))
        return cls([str(i) for i, _ in items], *(np.concatenate([*(getattr(w, x) for w in found), none]) for x, none in (("hashes", np.zeros(0, np.uint64)), ("counts", np.zeros(0, np.int64)))))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and lengths of the windows: ``width`` words, or a shorter item as a whole."""
        left = np.repeat(np.cumsum(self.counts), self.counts) - np.arange(len(self.hashes))
        whole = np.repeat(self.counts, self.counts)
        starts = np.flatnonzero((left >= width) | ((left == whole) & (whole < width)))
        return starts, np.minimum(left[starts], width)


def _numbered(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers from 1 in hash order with a break after each document, and the place of each document's first word."""
    names, numbers = np.unique(hashes, return_inverse=True)
    ends = np.cumsum(counts + 1) - 1
    words = np.zeros(len(hashes) + len(counts), np.int32)
    inside = np.ones(len(words), bool)
    inside[ends] = False
    words[inside] = numbers + 1
    return names, words, ends - counts


class Matches:
    """How long words agree from two places on, by halving over hashes of runs: a match's length costs its logarithm."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        up, down = np.full(n + 1, _RUN_BASE, np.uint64), np.full(n + 1, _RUN_BACK, np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(up, out=up)
            self.down = np.cumprod(down)
            self.sums = np.r_[U64(0), np.cumsum(mix(words.astype(np.uint64) * U64(0x9E3779B97F4A7C15)) * up[:n])]
        stops = np.where(words <= 1, np.arange(n), n)  # breaks and unknown words agree with nothing
        self.room = np.minimum.accumulate(stops[::-1])[::-1] - np.arange(n)

    def _hash(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[at + size] - self.sums[at]) * self.down[at]

    def length(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), np.minimum(self.room[a], self.room[b])
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = self._hash(a, middle) == self._hash(b, middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low


_RUN_BASE = 0xD1342543DE82EF95
_RUN_BACK = pow(_RUN_BASE, -1, 1 << 64)


@dataclass
class Found:
    """What a shard's document has of the benchmark: hit word ranges, names of items, and its longest match.

    ``longest`` is (words, place in the document, item, place in the item).
    """

    ranges: np.ndarray
    items: set[str]
    longest: tuple[int, int, str, int] | None


class Shard:
    """Documents' words with their suffix array."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, width: int) -> None:
        self.counts, self.width = counts, width
        self.names, self.words, self.firsts = _numbered(hashes, counts)
        self.array = SuffixArray(self.words, width)

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """The shard's numbers of words, -1 for words that it lacks."""
        if not len(self.names):
            return np.full(len(hashes), -1, np.int64)
        spots = np.minimum(np.searchsorted(self.names, hashes), len(self.names) - 1)
        return np.where(self.names[spots] == hashes, spots + 1, -1)

    def search(self, block: Block, longest: bool = True) -> dict[int, Found]:
        """The documents, by number, in which windows of the block occur; without ``longest``, their longest matches are left out."""
        numbers = self.numbered(block.hashes)
        starts, lengths = block.windows(self.width)
        lacking = np.r_[0, np.cumsum(numbers < 0)]
        here = lacking[starts + lengths] == lacking[starts]
        starts, lengths = starts[here], lengths[here]
        if not len(starts):
            return {}
        inside = np.arange(self.width) < lengths[:, None]
        rows = np.where(inside, numbers[np.minimum(starts[:, None] + np.arange(self.width), len(numbers) - 1)], 0)
        rows, of = np.unique(rows, axis=0, return_inverse=True)
        of = of.ravel()
        lengths = (rows > 0).sum(1)
        low, high = self.array.bounds(rows, lengths)
        sizes = high - low
        at, which = self.array.order[_ranges(low, sizes)], np.repeat(np.arange(len(rows)), sizes)
        if not len(at):
            return {}
        o = np.argsort(at, kind="stable")
        at, which = at[o], which[o]
        item_of = np.searchsorted(np.cumsum(block.counts), starts, "right")
        by_window = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[by_window], np.arange(len(rows) + 1))
        owners = item_of[by_window]
        docs = np.searchsorted(self.firsts, at, "right") - 1
        parts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1], True])
        held = np.unique(item_of[sizes[of] > 0])
        best = self._longest(block, numbers, held, docs, at) if longest else {}
        out = {}
        for a, b in zip(parts[:-1], parts[1:], strict=True):
            doc = int(docs[a])
            begin = at[a:b] - self.firsts[doc]
            end = np.maximum.accumulate(begin + lengths[which[a:b]])
            new = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
            names = {block.names[i] for w in np.unique(which[a:b]) for i in np.unique(owners[cuts[w] : cuts[w + 1]])}
            out[doc] = Found(np.stack([begin[new], end[np.r_[new[1:], len(end)] - 1]]), names, best.get(doc))
        return out

    def _longest(self, block: Block, numbers: np.ndarray, held: np.ndarray, docs: np.ndarray, at: np.ndarray) -> dict[int, tuple[int, int, str, int]]:
        """The longest match of each hit document that begins at one of the places ``at``.

        The words of the hit documents and of the items found are sorted in one
        suffix array; a suffix's longest match is with the nearest item suffix
        before or behind it.
        """
        hit = np.unique(docs)
        ends = np.cumsum(block.counts)
        texts = [self.words[self.firsts[d] : self.firsts[d] + self.counts[d]] for d in hit] + [numbers[ends[i] - block.counts[i] : ends[i]] for i in held]
        sizes = np.array([len(x) for x in texts])
        words = np.full(int(sizes.sum()) + len(texts), 0, np.int64)
        firsts = np.cumsum(sizes + 1) - sizes - 1
        words[_ranges(firsts, sizes)] = np.concatenate(texts) + 2  # an item's unknown words are 1, breaks 0
        order = SuffixArray(words, len(words)).order
        from_item = order >= firsts[len(hit)]
        places = np.arange(len(order))
        before = np.maximum.accumulate(np.where(from_item, places, -1))
        behind = np.minimum.accumulate(np.where(from_item, places, len(order))[::-1])[::-1]
        spot = np.empty(len(order), np.int64)
        spot[order] = places
        mine = firsts[np.searchsorted(hit, docs)] + at - self.firsts[docs]
        best, partner = np.zeros(len(mine), np.int64), np.zeros(len(mine), np.int64)
        matches = Matches(words)
        for near in (before[spot[mine]], behind[spot[mine]]):
            real = (near >= 0) & (near < len(order))
            other = order[np.where(real, near, 0)]
            size = np.where(real, matches.length(mine, other), 0)
            better = size > best
            best, partner = np.where(better, size, best), np.where(better, other, partner)
        out = {}
        for k in np.lexsort((mine, -best)):
            doc = int(docs[k])
            if doc not in out:
                text = int(np.searchsorted(firsts, partner[k], "right")) - 1
                out[doc] = int(best[k]), int(at[k] - self.firsts[doc]), block.names[held[text - len(hit)]], int(partner[k] - firsts[text])
        return out


def _joined(a: Found | None, b: Found) -> Found:
    """Findings of two blocks in one document."""
    if a is None:
        return b
    begin, end = (np.concatenate([a.ranges[i], b.ranges[i]]) for i in (0, 1))
    o = np.argsort(begin, kind="stable")
    begin, end = begin[o], np.maximum.accumulate(end[o])
    new = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
    return Found(np.stack([begin[new], end[np.r_[new[1:], len(end)] - 1]]), a.items | b.items, max((m for m in (a.longest, b.longest) if m), key=lambda m: (m[0], -m[1]), default=None))


def search_blocks(hashes: np.ndarray, counts: np.ndarray, blocks: Iterator[Block], width: int, *, longest: bool = True) -> dict[int, Found]:
    """Findings by document of one shard; its suffix array is made once for all blocks."""
    out: dict[int, Found] = {}
    if len(hashes):
        shard = Shard(hashes, counts, width)
        for block in blocks:
            for doc, found in shard.search(block, longest).items():
                out[doc] = _joined(out.get(doc), found)
    return out


def _shards(batches: Iterator[pa.RecordBatch], text_col: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Runs of rows of about ``SHARD_WORDS`` words: the rows, their words' hashes, and their word counts."""
    rows, hashes, counts, held = [], [], [], 0
    for batch in batches:
        for w in slices(*text_buffers(batch.column(text_col)), NOT_ALNUM, lower=True):
            size = len(w.hashes) + w.hi - w.lo
            if held and held + size > SHARD_WORDS:
                yield rows, np.concatenate(hashes), np.concatenate(counts)
                rows, hashes, counts, held = [], [], [], 0
            rows.append(batch.slice(w.lo, w.hi - w.lo))
            hashes.append(w.hashes)
            counts.append(w.counts)
            held += size
    if rows:
        yield rows, np.concatenate(hashes), np.concatenate(counts)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[Block]:
    """The items in blocks of about ``block_bytes``; the text of one block at a time is on the driver."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = int(total) // block_bytes + 1
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else rows
        yield Block.of([tuple(r) for r in part.collect()])


def _passes(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, pass_bytes: int) -> list[list]:
    """Broadcast blocks, by pass over the documents."""
    context = benchmark.sparkSession.sparkContext
    sent = [context.broadcast(block) for block in item_blocks(benchmark, item_col, text_col, block_bytes)]
    per = max(1, pass_bytes // block_bytes)
    return [sent[i : i + per] for i in range(0, len(sent), per)]


_HITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_LONGEST = T.StructType([T.StructField("words", T.LongType()), T.StructField("at", T.LongType()), T.StructField("item", T.StringType()), T.StructField("item_at", T.LongType())])


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``(doc_id, n_words, hits, items, longest)`` of each row: hit word ranges, sorted names of the items with occurring windows, longest match.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
    lower-cased.  A window is ``width`` consecutive words of an item, or a
    shorter item as a whole; an item without words has none.  ``longest`` is
    the longest verbatim match that begins with a window, the earliest in the
    text of equals, with its length in words, its place in the text, and one
    item that holds it with its place there; null without hits.

    A null text has no words; null ids and repeated rows keep a row each, and
    different texts under one id stay apart.  Texts of any length are searched
    whole.  An empty benchmark hits nothing.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("hits", _HITS), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", _LONGEST)])
    kinds = [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()), pa.struct([("words", pa.int64()), ("at", pa.int64()), ("item", pa.string()), ("item_at", pa.int64())])]

    def searched(sent: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for own, hashes, counts in _shards(batches, 1):
                found = search_blocks(hashes, counts, (b.value for b in sent), width)
                columns: list[list] = [[], [], []]
                for k in range(len(counts)):
                    f = found.get(k)
                    for column, x in zip(columns, ([], [], None) if f is None else ([{"start": int(a), "end": int(b)} for a, b in f.ranges.T], sorted(f.items), dict(zip(_LONGEST.names, f.longest, strict=True))), strict=True):
                        column.append(x)
                ids, keys = (pa.concat_arrays([b.column(c) for b in own]) for c in (0, 2))
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array(counts, pa.int64()), *map(pa.array, columns, kinds)], names=schema.names)

        return rows.mapInArrow(run, schema)

    parts = [searched(sent) for sent in _passes(benchmark, item_col, item_text_col, block_bytes, pass_bytes)]
    whole = parts[0]
    if len(parts) > 1:
        for more in parts[1:]:
            whole = whole.unionAll(more)
        # rows of equal id and text have equal findings, so their number is all that has to be kept
        best = F.max_by("longest", F.struct(F.col("longest.words"), -F.col("longest.at")))
        merged = whole.groupBy("doc_id", "text_hash", "n_words").agg(F.array_sort(F.flatten(F.collect_set("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), best.alias("longest"), (F.count("*") / len(parts)).cast("int").alias("copies"))
        joined = F.aggregate(
            "hits", F.array().cast(_HITS),
            lambda acc, h: F.when((F.size(acc) > 0) & (h["start"] <= F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.named_struct(F.lit("start"), F.element_at(acc, -1)["start"], F.lit("end"), F.greatest(F.element_at(acc, -1)["end"], h["end"]))))).otherwise(F.concat(acc, F.array(h))),
        )
        whole = merged.select("doc_id", "n_words", joined.alias("hits"), "items", "longest", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("k"))
    return whole.select("doc_id", "n_words", "hits", "items", "longest")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text no benchmark window occurs in, with all their columns.

    Windows and odd rows are as in ``find_contamination``: null and empty texts
    stay, repeated rows and null ids are judged each by its own text.
    """
    at = docs.columns.index(text_col)

    def without(df: DataFrame, sent: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for own, hashes, counts in _shards(batches, at):
                kept = np.ones(len(counts), bool)
                kept[list(search_blocks(hashes, counts, (b.value for b in sent), width, longest=False))] = False
                first = 0
                for part in own:
                    yield part.filter(pa.array(kept[first : first + len(part)]))
                    first += len(part)

        return df.mapInArrow(run, df.schema)

    for sent in _passes(benchmark, item_col, item_text_col, block_bytes, pass_bytes):
        docs = without(docs, sent)
    return docs


def hit_words(hits: str = "hits"):
    """Words covered by the ranges of ``find_contamination``."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
