"""Token-ID output: best-fit-decreasing packing into fixed-length rows.

A document of more tokens than a row holds is split losslessly: full rows of
its own, and a rest.  The pieces of a run of documents are then taken by
falling length; each goes to the open row with the least room that still holds
it, which a segment tree over capacities finds in O(log row length).

Runs are bounded in tokens and end with the input split, so a task's memory
does not grow with the corpus and rows need no shuffle: a split gives the same
rows whenever it is read again.  Rows are named by (shard, row); a shard is
an input split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens
from .byte_bpe import ByteBpe, _sliced, coder

RUN_TOKENS = 1 << 21
#: Bytes of text encoded at a time.
SLICE = 1 << 20

_encoders: dict[int, pretokens.Encoder] = {}


def _encoder(bpe: ByteBpe, pattern: str) -> ByteBpe | pretokens.Encoder:
    """The array encoder for the pattern that it stands for, kept as long as the worker's coder; else the coder."""
    if pattern != pretokens.PATTERN:
        return bpe
    if id(bpe) not in _encoders:
        _encoders.clear()
        _encoders[id(bpe)] = pretokens.Encoder(bpe)
    return _encoders[id(bpe)]


class CapacityTree:
    """Open rows by room; a node holds how many lie below it."""

    def __init__(self, most: int) -> None:
        self.size = 1
        while self.size <= most:
            self.size *= 2
        self.held = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at:
            self.held[at] += 1
            at //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """The room and row of the fullest row with at least ``need`` room, which is taken out; the latest of equals."""
        held, at = self.held, need + self.size
        if not held[at]:
            while at > 1 and (at & 1 or not held[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if held[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            held[at] -= 1
            at //= 2
        return room, self.rows[room].pop()


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Rows of piece numbers; every length is 1 to ``most``, and each row's sum at most ``most``."""
    tree, rows = CapacityTree(most), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = tree.take(lengths[k])
        if found is None:
            room, row = most, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(k)
        if room > lengths[k]:
            tree.add(room - lengths[k], row)
    return rows


def _row(id_type: T.DataType) -> T.StructType:
    kinds = {"shard": T.IntegerType(), "row": T.LongType(), "n_tokens": T.IntegerType(), "doc_ids": T.ArrayType(id_type), "token_starts": T.ArrayType(T.LongType()), "cu_seqlens": T.ArrayType(T.IntegerType()), "position_resets": T.ArrayType(T.IntegerType()), "input_ids": T.BinaryType()}
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


class Packer:
    """Gathers documents and gives out packed rows."""

    def __init__(self, shard: int, length: int, pad: int, id_type: pa.DataType) -> None:
        self.shard, self.length, self.pad, self.row, self.id_type = shard, length, pad, 0, id_type
        self.pieces: list[tuple[object, int, np.ndarray]] = []
        self.tokens = 0

    def add(self, doc_id: object, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(ids), self.length):
            piece = ids[a : a + self.length]
            self.pieces.append((doc_id, a, piece))
            self.tokens += len(piece)
            if self.tokens >= RUN_TOKENS:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        pieces, self.pieces, self.tokens = self.pieces, [], 0
        rows = best_fit([len(p[2]) for p in pieces], self.length)
        for lo in range(0, len(rows), 512):
            yield self._batch(pieces, rows[lo : lo + 512])

    def _batch(self, pieces, rows) -> pa.RecordBatch:
        matrix = np.full((len(rows), self.length), self.pad, "<i4")
        columns: list[list] = [[] for _ in range(8)]
        for line, row in zip(matrix, rows, strict=True):
            ends = np.cumsum([len(pieces[k][2]) for k in row])
            line[: ends[-1]] = np.concatenate([pieces[k][2] for k in row])
            cuts = [0, *ends.tolist()]
            for column, x in zip(columns, (self.shard, self.row, cuts[-1], [pieces[k][0] for k in row], [pieces[k][1] for k in row], cuts, cuts[:-1], line.tobytes()), strict=True):
                column.append(x)
            self.row += 1
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(self.id_type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_row(T.LongType()).names)


def pack_tokens(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, pad: int = 50256, end: int | None = None) -> DataFrame:
    """Packed rows of the tokens of ``docs``.

    ``input_ids`` is a row of the id matrix, ``length`` little-endian 32-bit
    ids, filled up with ``pad``.  Segment k of a row is tokens ``cu_seqlens[k]``
    to ``cu_seqlens[k + 1]``, comes from ``doc_ids[k]`` at its token
    ``token_starts[k]``, and positions begin anew at ``position_resets[k]``.
    ``end``, if given, closes each document.  Texts that are null or empty
    give no segment (with ``end``: that token); ids may have any type, null
    ids and repeated rows are packed like others.  Texts of any length are
    encoded whole and split into full rows; an empty table gives no rows.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    tail = np.array([] if end is None else [end], "<i4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(coder(raw.value, pattern, by_rounds=True), pattern)
        packer = None
        for whole in batches:
            packer = packer or Packer(TaskContext.get().partitionId(), length, pad, whole.column(0).type)
            for batch in _sliced(whole, 1, SLICE):
                ids = bpe.encode_all([x or "" for x in batch.column(1).to_pylist()])
                for doc_id, own in zip(batch.column(0).to_pylist(), ids, strict=True):
                    yield from packer.add(doc_id, np.concatenate([own, tail]))
        if packer:
            yield from packer.flush()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _row(rows.schema["doc_id"].dataType))


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet, one file for each shard; ``path`` must be new."""
    packed.write.option("compression", "zstd").parquet(path)


def packed_shard(rows: list) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Rows of one shard as a trainer reads them: id matrix, cumulative segment lengths and position resets, in row order."""
    rows = sorted(rows, key=lambda r: r["row"])
    matrix = np.stack([np.frombuffer(r["input_ids"], "<i4") for r in rows]) if rows else np.zeros((0, 0), "<i4")
    return matrix, [np.array(r["cu_seqlens"]) for r in rows], [np.array(r["position_resets"]) for r in rows]
