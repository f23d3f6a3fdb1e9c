"""N-gram Jaccard join: classes of documents linked by shared word n-grams.

Candidate search
    One pass over the texts hashes every document's set of n-grams and deals
    the hashes into buckets.  A bucket tells which n-grams lie in two or more
    documents; only these go back to their documents.  A document with fewer
    of them than any link needs is settled there.  The others get a prefix:
    their n-grams in the order (how common, hash), rarest first, and as many
    of these as a partner must share one of.  Documents that share prefix
    n-grams, directly or over others, form a candidate group.
Join
    Sets are joined by signature trees (``signature_tree``), a group of at most
    ``block`` sets in one task.  In larger groups, one delegate of each class
    found so far meets the delegates of equal minimum hash, which near copies
    mostly share, by several hash functions in turn.  What is then not yet in
    its group's largest class meets, in blocks, every set of another class and
    of fitting size that shares a prefix n-gram with the block.  A link has
    such an n-gram, and every check compares whole sets, so no link between
    different classes is missed.
Hot n-grams
    The order knows an n-gram's count up to ``COMMON``.  An n-gram that a map
    chunk holds that often is known to be common there: the chunk sends one
    marker in place of a row for each document.  Equal sets are one set from
    the candidate step on.
Many buckets
    Beyond ``STEP_BITS`` bits of buckets, hashes are dealt in two steps, to
    coarse buckets first; so a packed row holds hundreds of hashes at any size
    of the corpus.

Hashes have 64 bits, of which the bucket and 48 more are used; two different
n-grams are taken for one with a chance of about 2**-(48 + bucket bits) a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .hot_keys import joined
from .signature_tree import Join, Linked, Sets, build
from .spill import Scratch
from .words import BLANKS, LANES, U64, grams, mix, slices, text_buffers

COMMON = 63
RANK_BITS = 6
CHUNK_GRAMS = 1 << 19
CHUNK_DOCS = 60_000
BUCKET_BYTES = 10 << 20
#: Of a bucket's number; at 100 TB of text a bucket then answers for about 100 MB of it.
MOST_BITS = 20
#: Bits that one deal tells apart.
STEP_BITS = 12
#: N-grams of a coarse bucket that the second deal takes at once.
REDEAL_GRAMS = 1 << 21
DOC_SHARD_BYTES = 16 << 20
BLOCK = 512
#: Minimum hashes of a set, by which delegates of large groups meet.
MINIMA = 4

#: Kinds of packed rows: postings by bucket, set headers by document, answers by document, postings by coarse bucket.
POSTINGS, HEADERS, ANSWERS, COARSE = range(4)

_PACKED = "shard int, kind int, ids binary, sizes binary, tokens binary, marks binary"


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By slice of rows: first row, row count, n-gram hashes with repeats, and the slice's row of each."""
    data, cuts = text_buffers(texts)
    for w in slices(data, cuts, BLANKS, lower=True):
        hashes, at = grams(w.hashes, w.counts, n)
        rows = w.rows
        first = np.cumsum(w.counts) - w.counts
        short = np.flatnonzero((w.counts > 0) & (w.counts < n))
        whole = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n - 1):
                own = w.counts[short] > k
                whole[own] += w.hashes[first[short[own]] + k] * LANES[k]
            whole = mix(whole + LANES[40 + w.counts[short]])
        both, owners = np.concatenate([hashes, whole]), np.concatenate([rows[at], short])
        if len(short):
            o = np.argsort(owners, kind="stable")
            both, owners = both[o], owners[o]
        yield w.lo, w.hi - w.lo, both, owners


def _least_common(sizes, num: int, den: int):
    """The least number of n-grams that a set of this size shares with any partner."""
    return -(-num * sizes // den)


def _fold(shards: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows of the columns by shard."""
    o = np.argsort(shards, kind="stable")
    shards = shards[o]
    cuts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1], True]) if len(shards) else np.zeros(0, np.int64)
    columns = [c[o] for c in columns]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(shards[a]), *(c[a:b] for c in columns)


def _doc_shard(ids: np.ndarray, shards: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % U64(shards)).astype(np.int64)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    names = ["shard", "kind", "ids", "sizes", "tokens", "marks"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _packed_ids(ids: np.ndarray) -> bytes:
    """Ids as 32-bit distances from the smallest where they fit, else whole; the first byte says which."""
    low = ids.min() if len(ids) else 0
    if len(ids) and int(ids.max()) - int(low) < 1 << 32:
        return b"\1" + low.tobytes() + (ids - low).astype(np.uint32).tobytes()
    return b"\0" + ids.tobytes()


def _unpacked_ids(x: bytes) -> np.ndarray:
    if x[:1] == b"\1":
        return np.frombuffer(x, np.uint32, offset=9).astype(np.int64) + np.frombuffer(x[1:9], np.int64)
    return np.frombuffer(x[1:], np.int64)


def _low48(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from48(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _ranked(tokens: np.ndarray, counts) -> np.ndarray:
    """Tokens whose numeric order is (count up to COMMON, hash)."""
    return (np.minimum(counts, COMMON).astype(np.uint64) << U64(64 - RANK_BITS)) | (tokens >> U64(RANK_BITS))


def _packed_postings(kind: int, bits: int, tokens: np.ndarray, docs: np.ndarray, ids: np.ndarray | None, marked: np.ndarray) -> Iterator[tuple]:
    """Rows by the tokens' top bits; ``docs`` are numbers of ``ids``, or the ids themselves."""
    width = _low48 if kind == POSTINGS else np.ndarray.tobytes
    top = lambda x: (x >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)
    marks = dict(_fold(top(marked), marked))
    for b, own, who in _fold(top(tokens), tokens, docs):
        for i in range(0, len(own), CHUNK_DOCS):
            part = who[i : i + CHUNK_DOCS]
            if ids is not None and len(part) >= 4 * len(ids):
                names = ids
            else:
                names, part = np.unique(part, return_inverse=True)
                names = names if ids is None else ids[names]
            yield b, kind, _packed_ids(names), part.astype(np.uint16).tobytes(), width(own[i : i + CHUNK_DOCS]), width(marks.pop(b, own[:0]))
    for b, x in marks.items():
        yield b, kind, b"", b"", b"", width(x)


def _packed_batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 256):
        yield _packed(rows[i : i + 256])


def _packed_answers(owners: np.ndarray, ranked: np.ndarray, shards: int) -> Iterator[tuple]:
    """Ranked n-grams by document shard."""
    for shard, who, own in _fold(_doc_shard(owners, shards), owners, ranked):
        names, order = np.unique(who, return_inverse=True)
        own = own[np.argsort(order, kind="stable")]
        yield shard, ANSWERS, _packed_ids(names), np.bincount(order).astype(np.int64).tobytes(), own.tobytes(), b""


def _kept_bits(bits: int) -> np.uint64:
    return ~U64(0) if bits >= 16 else U64((((1 << bits) - 1) << (64 - bits)) | ((1 << 48) - 1))


def _deal(n: int, bits: int, first_bits: int, shards: int):
    """Map side: (doc_id, text) to packed postings by the first bits, coarse ones if these are not all, and set headers by document."""
    keep, kind = _kept_bits(bits), POSTINGS if first_bits == bits else COARSE

    def flush(ids: np.ndarray, hashes: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        o = np.argsort(hashes, kind="stable")
        hashes, docs = hashes[o], docs[o]
        if len(hashes):
            new = np.r_[True, (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])]
            hashes, docs = hashes[new], docs[new]
        sizes = np.bincount(docs, minlength=len(ids))
        digest = np.zeros((2, len(ids)), np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(digest[0], docs, mix(hashes ^ LANES[60]))
            np.add.at(digest[1], docs, mix(hashes ^ LANES[61]))
        runs = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
        lengths = np.diff(np.r_[runs, len(hashes)])
        common = np.repeat(lengths >= COMMON, lengths)
        marked = hashes[runs[lengths >= COMMON]]
        rows = []
        heavy, owners = _ranked(hashes[common], COMMON), docs[common]
        o = np.argsort(owners, kind="stable")
        heavy, held = heavy[o], np.bincount(owners, minlength=len(ids))
        ends = np.cumsum(held)
        for shard, at in _fold(_doc_shard(ids, shards), np.arange(len(ids))):
            own = np.concatenate([heavy[ends[i] - held[i] : ends[i]] for i in at]) if held[at].any() else heavy[:0]
            rows.append((shard, HEADERS, _packed_ids(ids[at]), np.stack([sizes[at], held[at]]).astype(np.int64).tobytes(), own.tobytes(), digest[:, at].tobytes()))
        rows += _packed_postings(kind, first_bits, hashes[~common], docs[~common], ids, marked)
        yield from _packed_batches(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, docs, held, grams_held = [], [], [], 0, 0
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, count, found, rows in shingle_sets(batch.column(1), n):
                if held and (held + count > CHUNK_DOCS or grams_held + len(found) > CHUNK_GRAMS):
                    yield from flush(np.concatenate(ids), np.concatenate(hashes), np.concatenate(docs))
                    ids, hashes, docs, held, grams_held = [], [], [], 0, 0
                ids.append(names[lo : lo + count])
                hashes.append(found & keep)
                docs.append((rows + held).astype(np.int32))
                held += count
                grams_held += len(found)
        if held:
            yield from flush(np.concatenate(ids), np.concatenate(hashes), np.concatenate(docs))

    return run


def _redeal(bits: int, shards: int):
    """Coarse postings, sorted by bucket, to postings by all bits; what is common in a run of them is answered here."""

    def flush(tokens: list[np.ndarray], owners: list[np.ndarray], marks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        tokens, owners, marks = (np.concatenate(x) for x in (tokens, owners, marks))
        o = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[o], owners[o]
        runs = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)
        lengths = np.diff(np.r_[runs, len(tokens)])
        common = np.repeat(lengths >= COMMON, lengths)
        marks = np.concatenate([marks, tokens[runs[lengths >= COMMON]]])
        rows = list(_packed_answers(owners[common], _ranked(tokens[common], COMMON), shards))
        rows += _packed_postings(POSTINGS, bits, tokens[~common], owners[~common], None, np.unique(marks))
        yield from _packed_batches(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tokens, owners, marks = None, 0, [], [], []
        for batch in batches:
            for shard, who, which, own, more in zip(*(batch.column(c).to_pylist() for c in ("shard", "ids", "sizes", "tokens", "marks")), strict=True):
                if held and (shard != now or held > REDEAL_GRAMS):
                    yield from flush(tokens, owners, marks)
                    held, tokens, owners, marks = 0, [], [], []
                now = shard
                tokens.append(np.frombuffer(own, np.uint64))
                marks.append(np.frombuffer(more, np.uint64))
                owners.append(_unpacked_ids(who)[np.frombuffer(which, np.uint16)])
                held += len(tokens[-1]) + len(marks[-1])
        if held:
            yield from flush(tokens, owners, marks)

    return run


def _answer(bits: int, shards: int):
    """Bucket side: n-grams of two or more documents go back to their documents, with their rank."""

    def run(table: pa.Table) -> pa.Table:
        rows, ids, spots, tokens, weights, base = [], [], [], [], [], 0
        bucket = table.column("shard")[0].as_py()
        top = U64(bucket << (64 - bits)) if bits else U64(0)
        for r in table.to_batches():
            for who, which, own, marks in zip(*(r.column(c).to_pylist() for c in ("ids", "sizes", "tokens", "marks")), strict=True):
                names, own, marks = _unpacked_ids(who), _from48(own), _from48(marks)
                ids.append(names)
                spots += [np.frombuffer(which, np.uint16).astype(np.int32) + np.int32(base), np.full(len(marks), -1, np.int32)]
                tokens += [own, marks]
                weights += [np.ones(len(own), np.int32), np.full(len(marks), COMMON, np.int32)]
                base += len(names)
        ids, spots, tokens, weights = (np.concatenate(x) for x in (ids, spots, tokens, weights))
        if len(tokens):
            o = np.argsort(tokens, kind="stable")
            tokens, spots = tokens[o] | top, spots[o]
            runs = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            counts = np.add.reduceat(weights[o], runs)
            counts = np.repeat(counts, np.diff(np.r_[runs, len(tokens)]))
            shared = (counts > 1) & (spots >= 0)
            owners, ranked = ids[spots[shared]], _ranked(tokens[shared], counts[shared])
            rows += _packed_answers(owners, ranked, shards)
        return pa.Table.from_batches([_packed(rows)])

    return run


_SETS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()),
    T.StructField("d2", T.LongType()), T.StructField("tokens", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("minima", T.ArrayType(T.LongType())),
])


def _gather(num: int, den: int):
    """Document side: set headers and shared n-grams to a row for each document; tokens only where a link is possible."""

    def run(table: pa.Table) -> pa.Table:
        heads, owners, tokens = [], [], []
        for r in table.to_batches():
            for kind, who, sizes, own, marks in zip(*(r.column(c).to_pylist() for c in ("kind", "ids", "sizes", "tokens", "marks")), strict=True):
                names, sizes = _unpacked_ids(who), np.frombuffer(sizes, np.int64)
                if kind == HEADERS:
                    heads.append(np.concatenate([names[None], sizes.reshape(2, -1)[:1], np.frombuffer(marks, np.int64).reshape(2, -1)]))
                    sizes = sizes.reshape(2, -1)[1]
                owners.append(np.repeat(names, sizes))
                tokens.append(np.frombuffer(own, np.uint64))
        heads = np.concatenate(heads, 1) if heads else np.zeros((4, 0), np.int64)
        heads = heads[:, np.lexsort(heads[::-1])]
        owners, tokens = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, tokens))
        o = np.lexsort((tokens, owners))
        owners, tokens = owners[o], tokens[o]
        starts, ends = np.searchsorted(owners, heads[0]), np.searchsorted(owners, heads[0], "right")
        sets, keys, minima = [], [], []
        for n, a, b in zip(heads[1], starts, ends, strict=True):
            own = tokens[a:b]
            if b - a > 1:
                own = own[np.r_[True, own[1:] != own[:-1]]]
            least = int(_least_common(n, num, den))
            if n == 0 or len(own) < least:
                sets.append(None)
                keys.append([])
                minima.append([])
            else:
                sets.append(own.tobytes())
                keys.append(own[: len(own) - least + 1].view(np.int64))
                minima.append([mix(own ^ LANES[40 + k]).min().view(np.int64) for k in range(MINIMA)])
        return pa.table([*(pa.array(h, pa.int64()) for h in heads), pa.array(sets, pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in (keys, minima))], names=_SETS.names)

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Runs of equal keys of sorted batches, one group in memory at a time."""
    now, held = None, {}
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        for i, key in enumerate(zip(*(columns[k] for k in keys), strict=True)):
            if key != now:
                if now is not None:
                    yield now, held
                now, held = key, {c: [] for c in columns}
            for c, x in columns.items():
                held[c].append(x[i])
    if now is not None:
        yield now, held


def _sets(group: dict[str, list]) -> Sets:
    return Sets([np.sort(np.frombuffer(x, np.uint64)) for x in group["tokens"]], group["n"])


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _join_blocks(num: int, den: int):
    """For each set that is linked inside its (label, block): the smallest rep of its class there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches, ["label", "block"]):
            reps, count = group["rep"], len(group["rep"])
            if count > 1:
                sets, linked = _sets(group), Linked(count)
                Join(sets, linked, num, den).within(build(sets, np.arange(count)))
                roots = [linked.root(i) for i in range(count)]  # reps are sorted, so the smallest index has the smallest rep
                moved = [i for i in range(count) if roots[i] != i]
                if moved:
                    yield _pairs([reps[i] for i in moved], [reps[roots[i]] for i in moved])

    return run


def _join_sides(num: int, den: int):
    """Linked classes of the two sides of each (block, other); sets of one class are not compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches, ["block", "other"]):
            side, known = np.array(group["side"]), group["known"]
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            sets, linked, first = _sets(group), Linked(len(side)), {}
            for i, k in enumerate(known):
                linked.join(i, first.setdefault(k, i))
            join = Join(sets, linked, num, den)
            join.between(build(sets, left), build(sets, right))
            if join.found:
                yield _pairs([known[x] for x, _ in join.found], [known[y] for _, y in join.found])

    return run


_PAIRS = "a long, b long"


def _joined_in_blocks(sets: DataFrame, members: DataFrame, total: int, num: int, den: int, block: int, turn: int = 0) -> DataFrame:
    """Classes (a: rep, b: its class) of ``members(rep, label)``, inside blocks of at most about ``block`` of a label; there are at most ``total`` members."""
    counts = members.groupBy("label").agg(F.count("*").alias("c")).where("c > 1").select(F.col("label").alias("l"), F.ceil(F.col("c") / block).cast("int").alias("blocks"), "c")
    dealt = joined(members, counts, "label", "l", "c", total).select("rep", "label", F.pmod(F.xxhash64("rep", F.lit(turn)), F.col("blocks")).cast("int").alias("block"))
    rows = sets.join(dealt, "rep").select("label", "block", "rep", "n", "tokens")
    return rows.repartition("label", "block").sortWithinPartitions("label", "block", "rep").mapInArrow(_join_blocks(num, den), _PAIRS)


def _moved(now: DataFrame, to: DataFrame) -> DataFrame:
    """``now`` with each ``known`` class replaced by what ``to(a, b)`` says of it."""
    return now.join(to, F.col("known") == F.col("a"), "left").withColumn("known", F.coalesce("b", "known")).drop("a", "b")


def _classes(reps: DataFrame, sets: DataFrame, num: int, den: int, block: int, scratch: Scratch) -> DataFrame:
    """``(rep, component)`` for the reps that share a prefix n-gram with another.

    ``reps(rep, n, keys, minima)`` are the distinct sets, ``sets(rep, n, tokens)`` hold their tokens.
    """
    keys = reps.select("rep", F.explode("keys").alias("key"))
    least = keys.groupBy("key").agg(F.min("rep").alias("m"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"), "m", "n")
    least = scratch.stored(least, "least")
    edges = joined(keys, least, "key", "k", "n", least.agg(F.sum("n")).first()[0] or 0).where("rep <> m").select(F.col("rep").alias("a"), F.col("m").alias("b"))
    labels = scratch.stored(components(edges, scratch).select(F.col("node").alias("rep"), "label"), "labels")
    scratch.drop("least", "ends", "star", "large")
    sizes = labels.groupBy("label").agg(F.count("*").alias("c"))
    total = labels.count()
    of_size = scratch.stored(joined(labels, sizes.select(F.col("label").alias("l"), (F.col("c") > block).alias("large"), "c"), "label", "l", "c", total).select("rep", "label", "large"), "sized")
    first = scratch.stored(_joined_in_blocks(sets, of_size.where("not large").select("rep", "label"), total, num, den, block), "blocks")
    found = labels.select("rep").join(first, F.col("rep") == F.col("a"), "left").select("rep", F.coalesce("b", "rep").alias("component"))
    now = of_size.where("large").select("rep", "label").join(reps.select("rep", "n", "keys", "minima"), "rep").withColumn("known", F.col("rep"))
    now = scratch.stored(now, "known")
    if now.isEmpty():
        return found
    idle = turn = 0
    while idle < MINIMA:
        delegates = now.where("rep = known").select("rep", F.xxhash64("label", F.col("minima")[turn % MINIMA]).alias("label"))
        more = scratch.stored(_joined_in_blocks(sets, delegates, total, num, den, block, turn), "delegates")
        turn += 1
        if more.isEmpty():
            idle += 1
        else:
            idle = 0
            now = scratch.stored(_moved(now, more), "known")
    links = scratch.stored(_across(sets, now, total, num, den, block, scratch), "across")
    if not links.isEmpty():
        now = _moved(now, components(links, scratch).select(F.col("node").alias("a"), F.col("label").alias("b")))
    return found.join(now.select(F.col("rep").alias("r"), "known"), F.col("rep") == F.col("r"), "left").select("rep", F.coalesce("known", "component").alias("component"))


def _across(sets: DataFrame, now: DataFrame, total: int, num: int, den: int, block: int, scratch: Scratch) -> DataFrame:
    """Linked classes: what is outside its label's largest class, in blocks, against the sets that may link with one of the block.

    Such a set shares a prefix n-gram with the block, is not of the block's one
    class, and has a size that fits one of its sizes.
    """
    classes = now.groupBy("label", "known").agg(F.count("*").alias("c"))
    main = classes.groupBy("label").agg(F.max_by("known", F.struct("c", F.negate("known"))).alias("main"), F.count("*").alias("k"), F.sum("c").alias("c")).where("k > 1").select(F.col("label").alias("l"), "main", "c")
    rest = joined(now, main, "label", "l", "c", total).where("known <> main").select("rep", "label", "known", "n", "keys", F.xxhash64("label", F.col("minima")[0]).alias("near"))
    rest = scratch.stored(rest, "rest")
    alike = rest.groupBy("near").agg(F.count("*").alias("c")).select(F.col("near").alias("m"), F.ceil(F.col("c") / block).alias("parts"), "c")
    whole = rest.groupBy("label").agg(F.count("*").alias("c")).select(F.col("label").alias("l"), F.ceil(F.col("c") / block).alias("blocks"), "c")
    own = F.when(F.col("parts") > 1, F.xxhash64("near", F.pmod(F.xxhash64("rep"), F.col("parts")))).otherwise(F.xxhash64("label", F.pmod(F.xxhash64("near"), F.col("blocks"))))
    left = joined(joined(rest, alike, "near", "m", "c", total), whole, "label", "l", "c", total).select(own.alias("block"), "rep", "known", "n", "keys")
    left = scratch.stored(left, "left")
    wanted = left.select("block", "known", "n", F.explode("keys").alias("key")).groupBy("key", "block").agg(F.min("known").alias("k0"), F.max("known").alias("k1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    others = now.select("rep", "known", "n", F.explode("keys").alias("key"))
    differs = (F.col("k0") < F.col("k1")) | (F.col("k0") != F.col("known"))
    fits = (den * F.col("n") >= num * F.col("n0")) & (den * F.col("n1") >= num * F.col("n"))
    right = scratch.stored(others.join(wanted, "key").where(differs & fits).select("block", "rep", "known").distinct(), "right")
    counts = right.groupBy("block").agg(F.count("*").alias("c")).select(F.col("block").alias("b"), F.ceil(F.col("c") / block).cast("int").alias("others"), "c")
    right = joined(right, counts, "block", "b", "c", right.count()).select("block", F.pmod(F.xxhash64("rep"), F.col("others")).cast("int").alias("other"), F.lit(1).alias("side"), "rep", "known")
    left = left.join(counts, F.col("block") == F.col("b")).select("block", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"), F.lit(0).alias("side"), "rep", "known")
    rows = sets.join(left.unionAll(right), "rep")
    return rows.repartition("block", "other").sortWithinPartitions("block", "other", "side", "rep").mapInArrow(_join_sides(num, den), _PAIRS)


def _set_table(rows: DataFrame, n: int, num: int, den: int, bucket_bytes: int, step_bits: int, scratch: Scratch) -> DataFrame:
    """A row of ``_SETS`` for each document, in the shared folder."""
    total = int(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    bits = min(MOST_BITS, max(0, (total // bucket_bytes).bit_length()))
    shards = max(1, total // DOC_SHARD_BYTES)
    first_bits = bits if bits <= step_bits else (bits + 1) // 2
    dealt = rows.where("doc_id is not null").mapInArrow(_deal(n, bits, first_bits, shards), _PACKED)
    if first_bits < bits:
        dealt = scratch.stored(dealt, "coarse")
        coarse = dealt.where(F.col("kind") == COARSE)
        parts = max(1, total // (8 * bucket_bytes))
        salted = coarse.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(max(1, parts >> first_bits))))
        fine = salted.repartition(parts, "shard", "salt").sortWithinPartitions("shard").drop("salt").mapInArrow(_redeal(bits, shards), _PACKED)
        dealt = fine.unionAll(dealt.where(F.col("kind") == HEADERS))
    answers = scratch.stored(dealt.groupBy("kind", "shard").applyInArrow(_bucket_or_pass(_answer(bits, shards)), _PACKED), "answers")
    scratch.drop("coarse")
    found = scratch.stored(answers.groupBy("shard").applyInArrow(_gather(num, den), _SETS), "sets")
    scratch.drop("answers")
    return found


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 5, similarity: tuple[int, int] = (75, 100), block: int = BLOCK, bucket_bytes: int = BUCKET_BYTES, step_bits: int = STEP_BITS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every document, by n-gram Jaccard links.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a
    text of fewer than ``n`` words is one n-gram, a null text or one without
    words has none and is linked with nothing.  Two documents link when
    ``den * |x & y| >= num * |x | y|``; ``component_id`` is the smallest id
    that links reach.  Rows that repeat an id each get a row of their own,
    with their own size and the id's component.  A null id is kept, with size
    from its text and a null component.  Ids are cast to long; others than
    numbers are an error.  Texts of any length are read whole; an empty table
    gives an empty one.  Other columns are ignored.  Different texts of one id
    are compared each by itself, and what any of them reaches is the id's.
    """
    num, den = similarity
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        texts = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
        if texts.where("a <> b").isEmpty():
            out = _joined_rows(rows, n, num, den, block, bucket_bytes, step_bits, scratch)
        else:
            keyed = rows.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
            found = _joined_rows(keyed.select(F.col("key").alias("doc_id"), "text"), n, num, den, block, bucket_bytes, step_bits, scratch)
            out = _by_id(keyed.select("doc_id", "key"), found, scratch)
    lost = rows.where("doc_id is null").mapInArrow(_sizes_only(n), "doc_id long, n_shingles long, component_id long")
    return out.unionAll(lost)


def _joined_rows(rows: DataFrame, n: int, num: int, den: int, block: int, bucket_bytes: int, step_bits: int, scratch: Scratch) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` where rows of one id have one text."""
    found = _set_table(rows, n, num, den, bucket_bytes, step_bits, scratch)
    reps = scratch.stored(found.where("tokens is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("minima").alias("minima")), "reps")
    sets = found.where("tokens is not null").select(F.col("doc_id").alias("rep"), "n", "tokens")
    classes = _classes(reps, sets, num, den, block, scratch)
    named = reps.select("d1", "d2", "n", "rep").join(classes, "rep", "left").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("n").alias("en"), F.coalesce("component", "rep").alias("c"))
    out = found.select("doc_id", "n", "d1", "d2").join(named, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n") == F.col("en")), "left")
    out = scratch.stored(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id")), "components")
    scratch.drop("sets", "reps", "labels", "ends", "star", "large", "sized", "blocks", "known", "delegates", "rest", "left", "right", "across")
    return out


def _by_id(rows: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """From classes of ``rows(doc_id, key)`` by key to components of ids: the texts of an id are apart in every comparison, and its classes are one."""
    by_key = found.select(F.col("doc_id").alias("k"), "n_shingles", F.col("component_id").alias("c")).dropDuplicates(["k"])
    members = scratch.stored(rows.join(by_key, F.col("key") == F.col("k")).select("doc_id", "n_shingles", "c"), "members")
    per_id = members.groupBy("doc_id").agg(F.min("c").alias("low"), F.collect_set("c").alias("all")).where(F.size("all") > 1)  # as many as the id has different texts
    links = scratch.stored(per_id.select(F.explode("all").alias("a"), F.col("low").alias("b")), "same_id")
    moved = components(links, scratch).select(F.col("node").alias("a"), F.col("label").alias("b"))
    whole = members.join(moved, F.col("c") == F.col("a"), "left").select("doc_id", "n_shingles", F.coalesce("b", "c").alias("c"))
    whole = scratch.stored(whole, "whole")
    least = whole.groupBy("c").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).select(F.col("c").alias("e"), "component_id", "n")
    out = scratch.stored(joined(whole, least, "c", "e", "n", whole.count()).select("doc_id", "n_shingles", "component_id"), "by_id")
    scratch.drop("members", "same_id", "whole", "ends", "star", "large", "components")
    return out


def _bucket_or_pass(answer):
    """Postings are answered; what is already keyed by document passes."""

    def run(table: pa.Table) -> pa.Table:
        return answer(table) if table.column("kind")[0].as_py() == POSTINGS else table

    return run


def _sizes_only(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(np.unique(found[rows == k])) for _, count, found, rows in shingle_sets(batch.column(1), n) for k in range(count)]
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(sizes, pa.int64()), none], names=["doc_id", "n_shingles", "component_id"])

    return run
