"""Alignment of two tokenizers over a corpus, and how often their tokens end together.

Both tokenizations of a text cover the same bytes, so the offsets where tokens
of both end cut them into groups, and at each such offset one token of either
is linked.  The corpus-wide counts of linked pairs are kept as packed 64-bit
keys, second id above first: every task reduces its links to distinct keys and
counts, Spark deals these by ranges of the key and sorts them, and each range
becomes a shard of two flat files, keys and counts, in the shared folder.
Lookups map the shards into memory and find all keys of a slice of texts at
once by binary search.

A pair has at most one row a task before the global sort, so no key is hot.
What the driver and the broadcasts hold is bounded by the vocabularies: the
tokenizer files, the highest count of each second id, and a line for a shard.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import sentencepiece
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .byte_bpe import ByteBpe, _sliced
from .pretokens import PATTERN, Encoder
from .spill import Scratch

#: Distinct pairs that a task holds before it passes their counts on.
MOST_PAIRS = 1 << 20
#: Rows of partial counts for one shard.
SHARD_ROWS = 1 << 20
#: Bytes of text aligned at a time.
SLICE_BYTES = 1 << 20
#: Links looked up, or tokens made to text, at a time.
STEP = 1 << 20
#: Code points that the array encoder may see, if it and the library split around them alike; texts with others go to the library.
COMMON = [*range(1, 0x250), *range(0x2010, 0x2030)]


def byte_alphabet() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: printable bytes stand for themselves, the others for 256 and above."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE of a ``tokenizers`` file.

    Texts of common characters go through the array encoder when ids follow
    the order of merges, which makes them ranks; the others to the library.
    """

    def __init__(self, raw: bytes) -> None:
        self.library = Tokenizer.from_str(raw.decode())
        self.library.encode_special_tokens = True
        model, alphabet = json.loads(raw)["model"], byte_alphabet()
        ranks = {}
        self.pieces = [b""] * self.library.get_vocab_size()
        for text, rank in model["vocab"].items():
            if all(c in alphabet for c in text):
                self.pieces[rank] = bytes(alphabet[c] for c in text)
                ranks[self.pieces[rank]] = rank
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        order = [model["vocab"][x] for x in made]
        singles = {model["vocab"].get(c) for c in alphabet}
        in_order = None not in singles and order == sorted(order) and max(singles) < min(order, default=1 << 30)
        added = {x["id"] for x in json.loads(raw)["added_tokens"] or []}
        self.fast = Encoder(ByteBpe({p: r for p, r in ranks.items() if r not in added}, PATTERN, by_rounds=True)) if in_order else None
        self.other = regex.compile("[^" + "".join(regex.escape(chr(c), special_only=False) for c in self._agreed()) + "]") if in_order else None

    def _agreed(self) -> list[int]:
        """The common code points that the library takes for what the array encoder does."""
        classes, found = self.fast.classes, []
        for c in COMMON:
            pieces = [s for _, (s, _) in self.library.pre_tokenizer.pre_tokenize_str(f"a{chr(c)}1!{chr(c)}x")]
            begins = [0, *(k for k in (1, 2, 3, 4, 5) if k in pieces)]
            kinds = [1, int(classes[c]), 2, 3, int(classes[c]), 1]
            blank = c == 0x20
            want = [0, *(k for k in (1, 2, 3, 4, 5) if (kinds[k] != kinds[k - 1] and not (blank and k in (2, 5))))]
            if begins == want or c == 0x27:
                found.append(c)
        return found

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.fast is not None and ("\0" not in t if t.isascii() else not self.other.search(t)) for t in texts]
        fast = iter(self.fast.encode_all([t for t, p in zip(texts, plain, strict=True) if p]) if any(plain) else [])
        return [next(fast) if p else np.array(self.library.encode(t, add_special_tokens=False).ids, np.int32) for t, p in zip(texts, plain, strict=True)]


class Pieces:
    """A ``sentencepiece`` model that adds a space before a text."""

    def __init__(self, raw: bytes) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        names = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        self.pieces = [bytes([int(p[3:5], 16)]) if self.library.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int32) for x in self.library.encode(texts, num_threads=1)]


def _covers(ids: np.ndarray, pieces: list[bytes], text: bytes) -> bool:
    """Whether the pieces of ``ids`` joined are ``text``."""
    at = 0
    for k in range(0, len(ids), STEP):
        part = b"".join(map(pieces.__getitem__, ids[k : k + STEP].tolist()))
        if text[at : at + len(part)] != part:
            return False
        at += len(part)
    return at == len(text)


class Aligner:
    """Groups and links of slices of texts."""

    def __init__(self, first: bytes, second: bytes) -> None:
        self.first, self.second = ByteLevel(first), Pieces(second)
        self.sizes = [np.array([len(p) for p in x.pieces], np.int64) for x in (self.first, self.second)]
        self.above = 2 * len(self.first.pieces)
        self.texts = [f"{k}{end}" for pieces, ends in ((self.first.pieces, ",|"), (self.second.pieces, ",;")) for k in range(len(pieces)) for end in ends]

    def slice(self, texts: list[str | None]) -> Slice:
        given = [t or "" for t in texts]
        raw = [b" " + t.encode() if t else b"" for t in given]
        ids = [self.first.encode_all([" " + t if t else "" for t in given]), self.second.encode_all(given)]
        for k, text in enumerate(raw):
            if not all(_covers(x[k], side.pieces, text) for x, side in zip(ids, (self.first, self.second), strict=True)):
                raw[k], ids[0][k], ids[1][k] = b"", ids[0][k][:0], ids[1][k][:0]
        return Slice(self, [len(x) for x in raw], *ids)


class Slice:
    """Aligned texts set end to end."""

    def __init__(self, aligner: Aligner, sizes: list[int], a: list[np.ndarray], b: list[np.ndarray]) -> None:
        self.aligner = aligner
        self.n_a, self.n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        self.a, self.b = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (a, b))
        ends_a, ends_b = (np.cumsum(size[x]) for size, x in zip(aligner.sizes, (self.a, self.b), strict=True))
        if len(ends_a):
            at = np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)
            both = ends_b[at] == ends_a
            #: Places of the linked tokens.
            self.last_a, self.last_b = np.flatnonzero(both), at[both]
        else:
            self.last_a = self.last_b = np.zeros(0, np.int64)
        self.cuts = np.r_[0, np.searchsorted(ends_a[self.last_a], np.cumsum(sizes), "right")]

    @property
    def keys(self) -> np.ndarray:
        return self.b[self.last_b].astype(np.int64) << 32 | self.a[self.last_a]

    def digests(self) -> list[str]:
        """Hex SHA-256 of each text's groups, ``a1,a2|b1;a3|b2,b3``; nothing for texts without tokens."""
        end_a, end_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        end_a[self.last_a], end_b[self.last_b] = 1, 1
        of_a, of_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
        codes = np.zeros(len(self.a) + len(self.b), np.int32)
        codes[np.arange(len(self.a)) + np.r_[0, self.last_b + 1][of_a]] = 2 * self.a + end_a
        codes[np.arange(len(self.b)) + (self.last_a + 1)[of_b]] = self.aligner.above + 2 * self.b + end_b
        ends, out = np.cumsum(self.n_a + self.n_b), []
        for stop, size in zip(ends.tolist(), (self.n_a + self.n_b).tolist(), strict=True):
            digest = hashlib.sha256()
            for k in range(stop - size, stop, STEP):
                text = "".join(map(self.aligner.texts.__getitem__, codes[k : min(stop, k + STEP)].tolist()))
                digest.update((text[:-1] if k + STEP >= stop else text).encode())
            out.append(digest.hexdigest() if size else "")
        return out

    def groups(self) -> pa.ListArray:
        """Each text's groups, as lists of either's ids."""
        sides = [pa.ListArray.from_arrays(pa.array(np.r_[0, last + 1], pa.int32()), pa.array(x, pa.int32())) for x, last in ((self.a, self.last_a), (self.b, self.last_b))]
        return pa.ListArray.from_arrays(pa.array(self.cuts, pa.int32()), pa.StructArray.from_arrays(sides, ["a", "b"]))


@lru_cache(1)
def _aligner(first: bytes, second: bytes) -> Aligner:
    return Aligner(first, second)


def _files(docs: DataFrame, *paths: str):
    found = []
    for path in paths:
        with open(path, "rb") as f:
            found.append(docs.sparkSession.sparkContext.broadcast(f.read()))
    return found


def token_groups(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, groups)`` of each row: the groups of ids between offsets where tokens of both end.

    ``first`` is a byte-level ``tokenizers`` file, ``second`` a
    ``sentencepiece`` model that adds a space; ``first`` gets the text with a
    space before it, and special tokens in a text are plain text.  Texts that
    are null or empty, or whose tokens do not spell the text with its space,
    have no groups.  Rows that repeat, and null ids, keep a row each; texts of
    any length are encoded whole; other columns are ignored.
    """
    one, two = _files(docs, first, second)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(one.value, two.value)
        for whole in batches:
            for batch in _sliced(whole, 1, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0), aligner.slice(batch.column(1).to_pylist()).groups()], names=["doc_id", "groups"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, groups array<struct<a: array<int>, b: array<int>>>")


_SUMS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _linked(docs: DataFrame, first: str, second: str, id_col: str, text_col: str) -> DataFrame:
    """Sums and digest of each row, and its links packed in 4 bytes, or 8 where a vocabulary has more than 65,536 ids."""
    one, two = _files(docs, first, second)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(one.value, two.value)
        for whole in batches:
            for batch in _sliced(whole, 1, SLICE_BYTES):
                found = aligner.slice(batch.column(1).to_pylist())
                links, n = _packed(found.keys, max(map(len, aligner.sizes))), np.diff(found.cuts)
                width = links.itemsize
                cells = [links[a:b].tobytes() for a, b in zip(found.cuts[:-1].tolist(), found.cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (found.n_a, found.n_b, n, n, found.digests())), pa.array(cells, pa.binary()), pa.array(np.full(len(batch), width, np.int32))], names=["doc_id", *(c.split()[0] for c in _SUMS.split(", ")), "links", "width"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_SUMS}, links binary, width int")


def _packed(keys: np.ndarray, ids: int) -> np.ndarray:
    return ((keys >> 32) << 16 | keys & 0xFFFF).astype("<u4") if ids <= 1 << 16 else keys.astype("<i8")


def _unpacked(cells: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all cells, and where each cell's begin and the last ends."""
    raw, cuts = b"".join(cells.to_pylist()), np.r_[0, np.cumsum([len(x) for x in cells.to_pylist()])] // width
    if width == 8:
        return np.frombuffer(raw, "<i8"), cuts
    packed = np.frombuffer(raw, "<u4").astype(np.int64)
    return (packed >> 16) << 32 | packed & 0xFFFF, cuts


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    return _runs(keys[order], counts[order])


def _runs(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_summed``, for sorted keys."""
    if not len(keys):
        return keys, counts
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[begin], np.add.reduceat(counts, begin)


def _cells(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part in _sliced(batch, column):
        yield part, *_unpacked(part.column(column), int(part.column(width)[0].as_py()))


def _partial_counts(links: DataFrame) -> DataFrame:
    """``(key, n)``: each task's distinct pairs and their counts; a task with more than ``MOST_PAIRS`` passes them on in between."""

    def rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 16)]), pa.array(counts[k : k + (1 << 16)])], names=["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = counts = np.zeros(0, np.int64)
        for batch in batches:
            for _, new, _ in _cells(batch, 0, 1):
                for k in range(0, len(new), STEP):
                    some, n = np.unique(new[k : k + STEP], return_counts=True)
                    keys, counts = _summed(np.r_[keys, some], np.r_[counts, n])
                    if len(keys) > MOST_PAIRS:
                        yield from rows(keys, counts)
                        keys = counts = np.zeros(0, np.int64)
        yield from rows(keys, counts)

    return links.select("links", "width").mapInArrow(run, "key long, n long")


def _store(place: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(place)


def _write_shards(partial: DataFrame, shards: int, folder: str) -> list:
    """Sorted shards of the pair counts: a line for each, with its files' name, its keys' bounds, and the highest count of each second id in it.

    A task writes under a name of its own, and only the names that finished
    tasks return are read; what a lost task leaves goes with the folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(f"{folder}/{uuid.uuid4().hex}")
        store.create_dir(path.rpartition("/")[0], recursive=True)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        bounds, best = [], {}
        with store.open_output_stream(f"{path}.keys") as keys_file, store.open_output_stream(f"{path}.counts") as counts_file:

            def put(keys: np.ndarray, counts: np.ndarray) -> None:
                if not len(keys):
                    return
                keys_file.write(keys.astype("<i8").tobytes())
                counts_file.write(counts.astype("<i8").tobytes())
                bounds.extend((int(keys[0]), int(keys[-1])))
                seconds = keys >> 32
                begin = np.flatnonzero(np.r_[True, seconds[1:] != seconds[:-1]])
                for second, most in zip(seconds[begin].tolist(), np.maximum.reduceat(counts, begin).tolist(), strict=True):
                    best[second] = max(most, best.get(second, 0))

            for batch in batches:
                keys, counts = _runs(np.r_[held[0], batch.column(0).to_numpy()], np.r_[held[1], batch.column(1).to_numpy()])
                put(keys[:-1], counts[:-1])
                held = keys[-1:], counts[-1:]
            put(*held)
        if bounds:
            packed = np.array(sorted(best.items()), "<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rpartition('/')[2]}"]), pa.array([bounds[0]]), pa.array([bounds[-1]]), pa.array([packed], pa.binary())], names=["name", "low", "high", "best"])

    dealt = partial.repartitionByRange(shards, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "name string, low long, high long, best binary").collect()


class Counts:
    """Sorted shards, looked up by binary search; a local or shared POSIX file is mapped into memory, one of another store is read when it is met."""

    def __init__(self, shards: list[tuple[str, int, int]]) -> None:
        self.shards = sorted(shards, key=lambda s: s[1])
        self.mapped: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def _open(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        if name in self.mapped:
            return self.mapped[name]
        store, path = _store(name)
        if isinstance(store, pafs.LocalFileSystem):
            self.mapped[name] = tuple(np.memmap(f"{path}.{kind}", "<i8", "r") for kind in ("keys", "counts"))
            return self.mapped[name]
        return tuple(np.frombuffer(store.open_input_file(f"{path}.{kind}").read(), "<i8") for kind in ("keys", "counts"))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The count of each of the sorted ``keys``; every one is in some shard."""
        out = np.zeros(len(keys), np.int64)
        for name, low, high in self.shards:
            a, b = np.searchsorted(keys, low), np.searchsorted(keys, high, "right")
            if a < b:
                known, counts = self._open(name)
                out[a:b] = counts[np.searchsorted(known, keys[a:b])]
        return out


@lru_cache(1)
def _counts(shards: tuple) -> Counts:
    return Counts(list(shards))


def align_tokenizers(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", *, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Each row's ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``.

    ``n_links`` pairs of tokens end together; ``count_sum`` sums how often
    each one's pair of ids is linked in the whole of ``docs``, and ``n_best``
    counts those whose pair is the most frequent, ties included, of its second
    id.  ``groups_sha256`` is the digest of the text ``token_groups`` would
    have.  Texts that are null or empty, or whose tokens do not spell the text
    with a space before it, have zeros and an empty digest and count for
    nothing.  Rows that repeat count each time and keep a row each, as do null
    ids; texts of any length are taken whole; other columns are ignored; an
    empty table gives an empty one.
    """
    with Scratch(docs.sparkSession) as scratch:
        table = scratch.stored(_linked(docs, first, second, id_col, text_col), "aligned")
        seen = Observation()
        partial = scratch.stored(_partial_counts(table).observe(seen, F.count("*").alias("n")), "partial")
        rows = _write_shards(partial, max(1, -(-seen.get["n"] // shard_rows)), f"{scratch.folder}/pair-counts")
        scratch.drop("partial")
    best = np.zeros(1, np.int64)
    for row in rows:
        found = np.frombuffer(row["best"], "<i8").reshape(-1, 2)
        if len(best) <= found[-1, 0]:
            best = np.r_[best, np.zeros(found[-1, 0] + 1 - len(best), np.int64)]
        best[found[:, 0]] = np.maximum(best[found[:, 0]], found[:, 1])
    known = docs.sparkSession.sparkContext.broadcast((tuple((r["name"], r["low"], r["high"]) for r in rows), best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, most = known.value
        counts = _counts(shards)
        for batch in batches:
            for part, keys, cuts in _cells(batch, 6, 7):
                sums = np.zeros((2, len(part)), np.int64)
                for k in range(0, len(keys), STEP):
                    some, of = np.unique(keys[k : k + STEP], return_inverse=True)
                    n = counts.find(some)
                    inside = np.clip(cuts, k, min(k + STEP, len(keys))) - k
                    for row, values in enumerate((n, (n == most[some >> 32]).astype(np.int64))):
                        sums[row] += np.diff(np.r_[0, np.cumsum(values[of])][inside])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), pa.array(sums[1]), pa.array(sums[0]), part.column(5)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kind = table.schema["doc_id"].dataType.simpleString()
    return table.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
