"""Byte-level BPE encoding and decoding with a rank queue of bucketed positions.

A pre-token is a linked list of byte pieces.  Every adjacent pair that the
vocabulary can merge waits in the bucket of its merge rank; a two-level bitmap
says which buckets are not empty, so that two find-first-set steps give the
lowest rank.  Inside a bucket the leftmost position comes first.  A merge
leaves the entries of its neighbours where they are: an entry whose pair has
changed since is skipped when it comes up.  A pre-token of n bytes costs
O(n log n), whatever its length.

All short pre-tokens of a slice of text that are new to the worker share one
queue: a bucket then holds positions in many of them, and a step merges the
leftmost one in each.  As pre-tokens do not touch, each goes through the same
merges in the same order as by itself.

The vocabulary is a public file of fixed size that the driver reads and
broadcasts; it is never trained or copied here.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a Python worker's newer cache; beyond, it becomes the older one, from which what is met again is taken over.
CACHE = 250_000
#: Bytes of text encoded at a time.
SLICE = 1 << 22
#: Pre-tokens of more bytes have a queue of their own, and are not kept.
SHORT = 256
WORD = 256


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class RankBits:
    """Which ranks are waiting: a bit for each, and a bit for each word of them that is not zero."""

    def __init__(self) -> None:
        self.words: dict[int, int] = {}
        self.top = 0

    def set(self, rank: int) -> None:
        word, bit = divmod(rank, WORD)
        self.words[word] = self.words.get(word, 0) | 1 << bit
        self.top |= 1 << word

    def first(self) -> int:
        """The lowest rank; -1 if there is none."""
        if not self.top:
            return -1
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        return word * WORD + (bits & -bits).bit_length() - 1

    def clear(self, rank: int) -> None:
        word, bit = divmod(rank, WORD)
        self.words[word] ^= 1 << bit
        if not self.words[word]:
            self.top ^= 1 << word


class RankQueue:
    """Positions by rank; ``pop`` gives the lowest rank's leftmost position."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.bits = RankBits()

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.bits.set(rank)
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        rank = self.bits.first()
        if rank < 0:
            return None
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.bits.clear(rank)
        return rank, position


class ByteBpe:
    """Encoder and decoder of a vocabulary.

    New short pre-tokens go through the shared rank queue (``merge_all``), or
    with ``by_rounds`` through ``merge_rounds``, which gives the same ids.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, *, by_rounds: bool = False) -> None:
        self.ranks, self.by_rounds = ranks, by_rounds
        # \s is Unicode white space; the module's own \s also takes U+001C to U+001F
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        size = max(ranks.values(), default=-1) + 1
        self.pieces = [b""] * size
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.keys: np.ndarray | None = None

    def _pairs(self) -> None:
        """The table of mergeable id pairs; made when the first text is encoded."""
        ranks = self.ranks
        self.bytes = np.array([ranks[bytes([k])] for k in range(256)], np.int32)
        merges = {}
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
                if left is not None and right is not None:
                    merges[left << 32 | right] = rank
        keys = np.fromiter(merges, np.int64, len(merges))
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.fromiter(merges.values(), np.int32, len(merges))[order]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids, -1 for none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens, each as packed little-endian 32-bit integers, by one rank queue."""
        if self.keys is None:
            self._pairs()
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        ids = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        # one more place, n, stands for no neighbour
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1], before[ends - sizes] = n, n
        pair = np.full(n + 1, -1, np.int32)
        inner = np.flatnonzero(after[:n] < n)
        pair[inner] = self.pair_ranks(ids[inner], ids[inner + 1])
        ids = np.append(ids, ids.dtype.type(0))
        alive = np.ones(n + 1, bool)
        waiting = inner[pair[inner] >= 0]
        waiting = waiting[np.argsort(pair[waiting], kind="stable")]
        ranks = pair[waiting]
        cuts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1], True]) if len(ranks) else np.zeros(0, np.int64)
        buckets, bits = defaultdict(list), RankBits()
        positions = waiting.tolist()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rank = int(ranks[a])
            buckets[rank] = positions[a:b]
            bits.set(rank)
        while (rank := bits.first()) >= 0:
            at = np.array(buckets.pop(rank))
            at = at[(pair[at] == rank) & alive[at]]
            if len(at) > 1:
                at.sort()
                of = word[at]
                leftmost = np.r_[True, of[1:] != of[:-1]]
                later = at[~leftmost]
                at = at[leftmost]
            else:
                later = at[:0]
            if len(later):
                buckets[rank] = later.tolist()
            else:
                bits.clear(rank)
            if not len(at):
                continue
            gone = after[at]
            end = after[gone]
            alive[gone] = False
            after[at] = end
            before[end] = at
            ids[at] = rank
            left = before[at]
            spots, lefts, rights = np.concatenate([at, left]), np.concatenate([at, left]), np.concatenate([end, at])
            real = (lefts < n) & (rights < n)
            pair[at] = -1
            spots = spots[real]
            new = self.pair_ranks(ids[lefts[real]], ids[rights[real]])
            pair[spots] = new
            some = new >= 0
            into = new[some].tolist()
            for r in set(into) - buckets.keys():
                bits.set(r)
            for r, i in zip(into, spots[some].tolist(), strict=True):
                buckets[r].append(i)
        left = np.flatnonzero(alive[:n])
        packed = ids[left].astype("<i4").tobytes()
        stops = (np.searchsorted(left, ends) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def merge_rounds(self, words: list[bytes]) -> list[bytes]:
        """As ``merge_all``, without a queue: each round merges the lowest pair, the leftmost of equals, of every word that still has one."""
        if self.keys is None:
            self._pairs()
        none = np.int64(1) << 62
        sizes = np.array([len(w) for w in words])
        ids = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        out: list[bytes] = [b""] * len(words)
        names = np.arange(len(words))

        def keyed(at: np.ndarray) -> np.ndarray:
            rank = self.pair_ranks(ids[at], ids[at + 1]).astype(np.int64)
            return np.where(rank >= 0, rank, none)

        stops = np.cumsum(sizes)
        pair = np.full(len(ids), none)  # rank of the pair that begins here; a word's last id begins none
        inner = np.ones(len(ids), bool)
        inner[stops - 1] = False
        inner = np.flatnonzero(inner)
        pair[inner] = keyed(inner)
        while len(names):
            stops = np.cumsum(sizes)
            starts = stops - sizes
            low = np.minimum.reduceat(pair, starts)
            done = low == none
            if done.any():
                packed = ids.astype("<i4").tobytes()
                for k, a, b in zip(names[done].tolist(), (4 * starts[done]).tolist(), (4 * stops[done]).tolist(), strict=True):
                    out[k] = packed[a:b]
                stay = np.repeat(~done, sizes)
                ids, pair, names, sizes, low = ids[stay], pair[stay], names[~done], sizes[~done], low[~done]
                if not len(names):
                    break
                stops = np.cumsum(sizes)
                starts = stops - sizes
            lowest = np.flatnonzero(pair == np.repeat(low, sizes))
            at = lowest[np.searchsorted(lowest, starts)]
            ids[at] = low
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, pair = ids[stay], pair[stay]
            at -= np.arange(len(at))
            sizes = sizes - 1
            stops = np.cumsum(sizes)
            right = at[at + 1 < stops]
            pair[at] = none
            pair[right] = keyed(right)
            left = at[at > stops - sizes] - 1
            pair[left] = keyed(left)
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair: list[int | None] = [ranks.get(piece[i : i + 2]) for i in range(n - 1)] + [None]
        queue = RankQueue()
        for i, rank in enumerate(pair):
            if rank is not None:
                queue.push(rank, i)
        alive = bytearray(b"\1") * n
        while (entry := queue.pop()) is not None:
            rank, i = entry
            if not alive[i] or pair[i] != rank:
                continue
            gone = after[i]
            alive[gone] = 0
            end = after[gone]
            after[i] = end
            if end < n:
                before[end] = i
            pair[i] = ranks.get(piece[i : after[end]]) if end < n else None
            if pair[i] is not None:
                queue.push(pair[i], i)
            left = before[i]
            if left >= 0:
                pair[left] = ranks.get(piece[left:end])
                if pair[left] is not None:
                    queue.push(pair[left], left)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [self.split.findall(t) for t in texts]
        if len(self.cache) > CACHE:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        ids = [list(map(cache.get, words)) for words in split]
        partly = [k for k, found in enumerate(ids) if not all(found)]
        new = {word for k in partly for word, own in zip(split[k], ids[k], strict=True) if own is None}
        short, raw, long = [], [], []
        for word in new:
            known = older.get(word)
            if known is None:
                piece = word.encode()
                rank = self.ranks.get(piece)
                if rank is not None:
                    known = rank.to_bytes(4, "little")
                elif len(piece) <= SHORT:
                    short.append(word)
                    raw.append(piece)
                    continue
                else:
                    known = np.array(self.merge(piece), "<i4").tobytes()
                    long.append(word)
            cache[word] = known
        if short:
            cache.update(zip(short, (self.merge_rounds if self.by_rounds else self.merge_all)(raw), strict=True))
        for k in partly:
            ids[k] = map(cache.__getitem__, split[k])
        out = [np.frombuffer(b"".join(found), "<i4") for found in ids]
        for word in long:
            del cache[word]
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


_coders: dict[tuple[str, str, bool], ByteBpe] = {}


def coder(raw: bytes, pattern: str, *, by_rounds: bool = False) -> ByteBpe:
    """The worker's coder for a vocabulary; made once a process, so its cache lives across batches."""
    key = hashlib.sha256(raw).hexdigest(), pattern, by_rounds
    if key not in _coders:
        _coders.clear()
        _coders[key] = ByteBpe(read_ranks(raw), pattern, by_rounds=by_rounds)
    return _coders[key]


def _rows(lists: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, lists)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32), pa.int32()))


def _sliced(batch: pa.RecordBatch, of: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose column ``of`` holds about ``most`` bytes."""
    start, held = 0, 0
    sizes = pc.fill_null(pc.binary_length(batch.column(of)), 0).to_pylist()
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(batch):
        yield batch.slice(start)


def bpe_encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", *, decoded: bool = False) -> DataFrame:
    """``(doc_id, ids array<int>)`` of each row: every match of ``pattern`` by itself, no special tokens.

    ``vocabulary`` is the path of a rank file.  A null or empty text has no
    ids.  Rows that repeat, and null ids, keep a row each; other columns are
    ignored.  With ``decoded``, the ids are also decoded again by the same
    task, as in ``bpe_decode``.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(raw.value, pattern)
        for whole in batches:
            for batch in _sliced(whole, 1):
                ids = bpe.encode_all([x or "" for x in batch.column(1).to_pylist()])
                back = [pa.array(map(bpe.decode, ids), pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([batch.column(0), _rows(ids), *back], names=["doc_id", "ids", "decoded"][: 2 + decoded])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded binary" * decoded)


def bpe_decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``encoded(doc_id, ids)`` with ``decoded binary``, the bytes of the ids (null ids: none)."""
    spark = encoded.sparkSession
    with open(vocabulary, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(raw.value, pattern)
        for batch in batches:
            ids = batch.column(1)
            ends, flat = ids.offsets.to_numpy(), ids.values.fill_null(0).to_numpy()
            texts = [bpe.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    rows = encoded.select("doc_id", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")
