"""Chunked robot logs (the public MCAP container) as a Spark data source.

A bag is a log file, or a folder of part files.  Planning reads only each
file's index: every chunk whose times and channels the pushed filters leave
becomes a partition, and a task reads that chunk alone.  Files that were cut
off before their index was written are walked from record to record instead.

``spark.read.format("rig_log")`` needs ``register(spark)`` once a session and
takes the files as JSON in the option ``bags``; ``read_logs`` finds them.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

MAGIC = b"\x89MCAP0\r\n"
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, MESSAGE_INDEX, CHUNK_INDEX, DATA_END = 1, 2, 3, 4, 5, 6, 7, 8, 15
COLUMNS = "bag string, topic string, time_ns long, publish_ns long, sequence long, type string, encoding string, payload binary"
#: Bytes of messages in a chunk that is written, and in a batch that is read.
CHUNK_BYTES, BATCH_BYTES = 1 << 20, 4 << 20


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, in the spelling of Hadoop or with two slashes more."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!//)", "file:///", path))


class _Bytes:
    """Little-endian fields, one after the other."""

    def __init__(self, raw: bytes | memoryview, at: int = 0) -> None:
        self.raw, self.at = memoryview(raw), at

    def number(self, kind: str) -> int:
        value = struct.unpack_from("<" + kind, self.raw, self.at)[0]
        self.at += struct.calcsize("<" + kind)
        return value

    def take(self, n: int) -> memoryview:
        part = self.raw[self.at : self.at + n]
        self.at += n
        return part

    def text(self) -> str:
        return bytes(self.take(self.number("I"))).decode()


def _text(value: str) -> bytes:
    raw = value.encode()
    return struct.pack("<I", len(raw)) + raw


def _record(kind: int, content: bytes) -> bytes:
    return struct.pack("<BQ", kind, len(content)) + content


def _records(raw: memoryview) -> Iterator[tuple[int, memoryview]]:
    at = 0
    while at + 9 <= len(raw):
        kind, size = struct.unpack_from("<BQ", raw, at)
        if at + 9 + size > len(raw):
            return  # cut off
        yield kind, raw[at + 9 : at + 9 + size]
        at += 9 + size


@dataclass
class Channels:
    """Topics, types and encodings by channel, from schema and channel records."""

    types: dict[int, str] = field(default_factory=dict)
    known: dict[int, tuple[str, str, str]] = field(default_factory=dict)

    def add(self, kind: int, content: memoryview) -> None:
        b = _Bytes(content)
        if kind == SCHEMA:
            number = b.number("H")
            self.types[number] = b.text()
        elif kind == CHANNEL:
            number, of = b.number("H"), b.number("H")
            self.known[number] = b.text(), self.types.get(of, ""), b.text()


@dataclass
class Piece(InputPartition):
    """A chunk of a file, or messages that lie outside chunks: where it is, and the channels known so far."""

    bag: str
    path: str
    start: int
    size: int
    chunked: bool
    first_ns: int
    last_ns: int
    has: tuple[int, ...] | None
    channels: Channels


def _chunk_header(head: bytes) -> tuple[int, int]:
    return struct.unpack_from("<QQ", head)


def pieces(bag: str, path: str) -> list[Piece]:
    """The chunks of a file, from its index if it has one."""
    store, place = _store(path)
    whole = store.get_file_info(place).size
    with store.open_input_file(place) as f:
        if f.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is not a chunked log")
        tail = f.read_at(min(whole, 37), max(0, whole - 37))
        start = struct.unpack_from("<Q", tail, 9)[0] if len(tail) == 37 and tail[29:] == MAGIC and tail[0] == FOOTER else 0
        channels, found = Channels(), []
        if start:
            summary = list(_records(memoryview(f.read_at(whole - 37 - start, start))))
            for kind, content in summary:
                channels.add(kind, content)
            for kind, content in summary:
                if kind == CHUNK_INDEX:
                    b = _Bytes(content)
                    first, last, at, size = (b.number("Q") for _ in range(4))
                    offsets = b.take(b.number("I"))
                    has = tuple(struct.unpack_from("<H", offsets, k)[0] for k in range(0, len(offsets), 10))
                    found.append(Piece(bag, path, at + 9, size - 9, True, first, last, has or None, channels))
            if found:
                return found
            channels = Channels()
        at, loose = 8, None
        while at + 9 <= whole:
            kind, size = struct.unpack("<BQ", f.read_at(9, at))
            if at + 9 + size > whole:
                break
            if kind in (SCHEMA, CHANNEL):
                channels.add(kind, memoryview(f.read_at(size, at + 9)))
            elif kind == CHUNK:
                first, last = _chunk_header(f.read_at(16, at + 9))
                found.append(Piece(bag, path, at + 9, size, True, first, last, None, channels))
            if kind == MESSAGE and loose is None:
                loose = at
            if kind != MESSAGE and loose is not None:
                found.append(Piece(bag, path, loose, at - loose, False, -(1 << 63), (1 << 63) - 1, None, channels))
                loose = None
            if kind in (FOOTER, DATA_END):
                break
            at += 9 + size
        if loose is not None:
            found.append(Piece(bag, path, loose, at - loose, False, -(1 << 63), (1 << 63) - 1, None, channels))
        return found


def _opened(raw: bytes) -> memoryview:
    """The records in a chunk."""
    b = _Bytes(raw)
    b.take(16)
    size = b.number("Q")
    b.take(4)
    compression, records = b.text(), b.take(b.number("Q"))
    if compression == "zstd":
        return memoryview(zstandard.ZstdDecompressor().decompress(records, max_output_size=size))
    if compression:
        raise ValueError(f"compression {compression!r} is not known")
    return records


class LogReader(DataSourceReader):
    """Reads what is left of the bags by the pushed filters on ``bag``, ``topic`` and ``time_ns``."""

    def __init__(self, bags: dict[str, list[str]]) -> None:
        self.bags, self.low, self.high = bags, -(1 << 63), (1 << 63) - 1
        self.only: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("bag", "topic") and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[column] = self.only.get(column, wanted) & wanted
            elif column == "time_ns" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def _wanted(self, column: str, value: str) -> bool:
        return column not in self.only or value in self.only[column]

    def partitions(self) -> list[Piece]:
        out = []
        for bag, files in self.bags.items():
            for path in files if self._wanted("bag", bag) else []:
                for p in pieces(bag, path):
                    topics = None if p.has is None else [p.channels.known[k][0] for k in p.has if k in p.channels.known]
                    if p.first_ns <= self.high and p.last_ns >= self.low and (topics is None or any(self._wanted("topic", t) for t in topics)):
                        out.append(p)
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        store, place = _store(partition.path)
        with store.open_input_file(place) as f:
            raw = f.read_at(partition.size, partition.start)
        channels = Channels(dict(partition.channels.types), dict(partition.channels.known))
        rows, held = [], 0
        for kind, content in _records(_opened(raw) if partition.chunked else memoryview(raw)):
            if kind != MESSAGE:
                channels.add(kind, content)
                continue
            number, sequence, at, published = struct.unpack_from("<HIQQ", content)
            topic, name, encoding = channels.known[number]
            if self.low <= at <= self.high and self._wanted("topic", topic):
                rows.append((partition.bag, topic, at, published, sequence, name, encoding, bytes(content[22:])))
                held += len(content)
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        yield _batch(rows)


_ARROW = pa.schema([("bag", pa.string()), ("topic", pa.string()), ("time_ns", pa.int64()), ("publish_ns", pa.int64()), ("sequence", pa.int64()), ("type", pa.string()), ("encoding", pa.string()), ("payload", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has finished, under their passing and their lasting names."""

    files: list[tuple[str, str]]


class _Part:
    """A part file that is being written: chunks, and behind them their index."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.at = file, 0
        self.schemas: dict[str, int] = {}
        self.channels: dict[tuple[str, str, str], int] = {}
        self.described: list[bytes] = []
        self.index: list[bytes] = []
        self._put(MAGIC + _record(HEADER, _text("") + _text("rigspark")))
        self._fresh()

    def _put(self, raw: bytes) -> None:
        self.file.write(raw)
        self.at += len(raw)

    def _fresh(self) -> None:
        self.held, self.size, self.times, self.places, self.seen = [], 0, [], {}, set()

    def _hold(self, record: bytes) -> None:
        self.held.append(record)
        self.size += len(record)

    def _channel(self, key: tuple[str, str, str]) -> int:
        if key not in self.channels:
            topic, name, encoding = key
            if name not in self.schemas:
                self.schemas[name] = len(self.schemas) + 1
                self.described.append(_record(SCHEMA, struct.pack("<H", self.schemas[name]) + _text(name) + _text("") + struct.pack("<I", 0)))
            self.channels[key] = len(self.channels)
            self.described.append(_record(CHANNEL, struct.pack("<HH", self.channels[key], self.schemas[name]) + _text(topic) + _text(encoding) + struct.pack("<I", 0)))
        return self.channels[key]

    def add(self, topic: str, at: int, published: int, sequence: int, name: str, encoding: str, payload: bytes) -> None:
        number = self._channel((topic, name, encoding))
        self.places.setdefault(number, []).append((at, self.size))
        self.times.append(at)
        self._hold(_record(MESSAGE, struct.pack("<HIQQ", number, sequence, at, published) + payload))
        if self.size >= CHUNK_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.times:
            return
        # every chunk describes its channels, so that it can be read without the file's index
        head = b"".join(self.described)
        records = head + b"".join(self.held)
        packed = zstandard.ZstdCompressor().compress(records)
        content = struct.pack("<QQQI", min(self.times), max(self.times), len(records), 0) + _text("zstd") + struct.pack("<Q", len(packed)) + packed
        start = self.at
        self._put(_record(CHUNK, content))
        length, offsets = self.at - start, b""
        for number, places in sorted(self.places.items()):
            offsets += struct.pack("<HQ", number, self.at)
            entries = b"".join(struct.pack("<QQ", t, len(head) + p) for t, p in places)
            self._put(_record(MESSAGE_INDEX, struct.pack("<HI", number, len(entries)) + entries))
        index = struct.pack("<QQQQI", min(self.times), max(self.times), start, length, len(offsets)) + offsets
        self.index.append(_record(CHUNK_INDEX, index + struct.pack("<Q", self.at - start - length) + _text("zstd") + struct.pack("<QQ", len(packed), len(records))))
        self._fresh()

    def close(self) -> None:
        self.flush()
        self._put(_record(DATA_END, struct.pack("<I", 0)))
        start = self.at
        self._put(b"".join([*self.described, *self.index]))
        self._put(_record(FOOTER, struct.pack("<QQI", start if self.index else 0, 0, 0)) + MAGIC)
        self.file.close()


class LogWriter(DataSourceArrowWriter):
    """A part file for each bag of a task's rows; they get their lasting names when all tasks have ended well."""

    def __init__(self, folder: str) -> None:
        self.folder, self.run = folder.rstrip("/"), uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        parts: dict[str, tuple[_Part, str, str]] = {}
        store, root = _store(self.folder)
        try:
            for batch in batches:
                columns = {name: batch.column(name).to_pylist() for name in _ARROW.names if name in batch.schema.names}
                missing = {"bag", "topic", "time_ns", "payload"} - columns.keys()
                if missing:
                    raise ValueError(f"a log needs the columns {sorted(missing)}")
                none = [None] * len(batch)
                for bag, topic, at, published, sequence, name, encoding, payload in zip(*(columns.get(n, none) for n in _ARROW.names), strict=True):
                    if bag is None or topic is None or at is None or at < 0 or "/" in bag or bag in ("", ".", ".."):
                        raise ValueError(f"a message needs a bag name, a topic and a time from 0, not {bag!r}, {topic!r}, {at!r}")
                    if bag not in parts:
                        own = f"part-{uuid.uuid4().hex}.mcap"
                        passing = f"{root}/_temporary-{self.run}/{own}"
                        store.create_dir(f"{root}/_temporary-{self.run}", recursive=True)
                        parts[bag] = _Part(store.open_output_stream(passing)), passing, f"{root}/{bag}/{own}"
                    parts[bag][0].add(topic, at, at if published is None else published, sequence or 0, name or "", encoding or "", payload or b"")
            for part, _, _ in parts.values():
                part.close()
        except BaseException:
            for part, passing, _ in parts.values():
                part.file.close()
                store.delete_file(passing)
            raise
        return Written([(passing, lasting) for _, passing, lasting in parts.values()])

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.folder)
        for m in messages:
            for passing, lasting in m.files if m else []:
                store.create_dir(lasting.rpartition("/")[0], recursive=True)
                store.move(passing, lasting)
        self._cleared(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._cleared(*_store(self.folder))

    def _cleared(self, store: pafs.FileSystem, root: str) -> None:
        place = f"{root}/_temporary-{self.run}"
        if store.get_file_info(place).type != pafs.FileType.NotFound:
            store.delete_dir(place)


class RigLog(DataSource):
    """Options: ``bags`` (JSON, bag to files) to read, ``path`` (a folder) to write."""

    @classmethod
    def name(cls) -> str:
        return "rig_log"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(json.loads(self.options["bags"]))

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a log is only added to")
        return LogWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RigLog)


def find_bags(spark: SparkSession, pattern: str, exclude: list[str] = ()) -> dict[str, list[str]]:
    """Bags that match a glob, in order, without those in whose path an ``exclude`` expression is found; none is an error.

    The glob is resolved by Hadoop where the logs are.  A bag's name is that of
    its file, without the ending, or of its folder.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(pattern)
    store = place.getFileSystem(conf)
    found: dict[str, list[str]] = {}
    for status in store.globStatus(place) or []:
        path = status.getPath().toString()
        name = status.getPath().getName()
        if any(re.search(e, path) for e in exclude) or name.startswith(("_", ".")):
            continue
        if status.isDirectory():
            files = sorted(p for s in store.listStatus(status.getPath()) if (p := s.getPath().toString()).endswith(".mcap"))
        else:
            files, name = [path], name.removesuffix(".mcap")
        if files:
            found.setdefault(name, []).extend(files)
    if not found:
        raise FileNotFoundError(f"nothing matches {pattern!r}")
    return dict(sorted(found.items()))


def read_logs(spark: SparkSession, pattern: str, exclude: list[str] = ()) -> DataFrame:
    """Messages of the bags that match, ``(bag, topic, time_ns, publish_ns, sequence, type, encoding, payload)``; filters on the first three reach the reader's planning."""
    register(spark)
    return spark.read.format("rig_log").option("bags", json.dumps(find_bags(spark, pattern, exclude))).load()


def write_logs(messages: DataFrame, folder: str) -> None:
    """Add messages to the bags in ``folder``: a part file for each bag and task.  Messages without a bag, topic or time from 0 are an error; a failed write leaves nothing."""
    register(messages.sparkSession)
    messages.write.format("rig_log").mode("append").option("path", folder).save()


def as_messages(log: DataFrame) -> DataFrame:
    """A log as the operators on messages take it, ``(bag, topic, time_us, msg_id, value)``."""
    return log.select("bag", "topic", F.floor(F.col("time_ns") / 1000).alias("time_us"), _message_id().alias("msg_id"), F.lit(None).cast("double").alias("value"))


def _message_id():
    return F.xxhash64("bag", "topic", "time_ns")


# ---- point clouds in messages

#: Type numbers of a point field, as NumPy kinds.
FIELD_KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}
POINT_TYPES = ("sensor_msgs/msg/PointCloud2", "sensor_msgs/PointCloud2")


class _Cdr(_Bytes):
    """Fields of a serialised message; numbers are aligned to their size behind the four leading bytes."""

    def __init__(self, raw: bytes) -> None:
        super().__init__(raw, 4)
        if len(raw) < 4 or raw[1] != 1:
            raise ValueError("only little-endian messages are known")

    def number(self, kind: str) -> int:
        size = struct.calcsize("<" + kind)
        self.at += -(self.at - 4) % size
        return super().number(kind)

    def text(self) -> str:
        return bytes(self.take(self.number("I"))).rstrip(b"\0").decode()


def cloud(payload: bytes) -> tuple[int, dict[str, np.ndarray]]:
    """Header time in nanoseconds, and the fields of a point cloud."""
    b = _Cdr(payload)
    stamp = b.number("i") * 1_000_000_000 + b.number("I")
    b.text()
    height, width = b.number("I"), b.number("I")
    fields = []
    for _ in range(b.number("I")):
        name, offset, kind, count = b.text(), b.number("I"), b.number("B"), b.number("I")
        if count == 1 and kind in FIELD_KINDS:
            fields.append((name, offset, kind))
    order = ">" if b.number("B") else "<"
    step, row = b.number("I"), b.number("I")
    data = b.take(b.number("I"))
    kind = np.dtype({"names": [f[0] for f in fields], "formats": [order + FIELD_KINDS[f[2]] for f in fields], "offsets": [f[1] for f in fields], "itemsize": step})
    points = np.concatenate([np.frombuffer(data, kind, width, k * row) for k in range(height)]) if height and width else np.zeros(0, kind)
    return stamp, {f[0]: points[f[0]] for f in fields}


def points_of(log: DataFrame) -> DataFrame:
    """``(bag, topic, time_ns, header_ns, msg_id, ring, point_idx, x, y, z)`` of the point clouds in a log; other messages have no points.

    Clouds without rings have ring 0 throughout; a cloud is decoded where its
    message is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bag, topic, at, payload in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                stamp, p = cloud(payload)
                n = len(p["x"])
                ring = p["ring"] if "ring" in p else np.zeros(n)
                columns = [pa.array([bag] * n, pa.string()), pa.array([topic] * n, pa.string()), pa.array(np.full(n, at)), pa.array(np.full(n, stamp)), pa.array(ring.astype(np.int32)), pa.array(np.arange(n)), *(pa.array(p[c].astype(np.float64)) for c in "xyz")]
                yield pa.RecordBatch.from_arrays(columns, names=["bag", "topic", "time_ns", "header_ns", "ring", "point_idx", *"xyz"])

    clouds = log.where(log["type"].isin(*POINT_TYPES)).select("bag", "topic", "time_ns", "payload")
    return clouds.mapInArrow(run, "bag string, topic string, time_ns long, header_ns long, ring int, point_idx long, x double, y double, z double").withColumn("msg_id", _message_id())


def cloud_payload(stamp_ns: int, frame: str, xyz: np.ndarray, ring: np.ndarray, *, wide: bool = False) -> bytes:
    """A serialised point cloud with fields x, y, z and ring; ``wide`` places have eight bytes a number and come back as they are, others are rounded to four."""
    size, code = (8, 8) if wide else (4, 7)
    kind = np.dtype([("x", f"<f{size}"), ("y", f"<f{size}"), ("z", f"<f{size}"), ("ring", "<u2")])
    points = np.zeros(len(xyz), kind)
    points["x"], points["y"], points["z"], points["ring"] = *np.asarray(xyz, f"f{size}").T, ring
    out = bytearray(b"\0\1\0\0")

    def put(code: str, value: int) -> None:
        size = struct.calcsize("<" + code)
        out.extend(b"\0" * (-(len(out) - 4) % size) + struct.pack("<" + code, value))

    def text(value: str) -> None:
        raw = value.encode() + b"\0"
        put("I", len(raw))
        out.extend(raw)

    put("i", stamp_ns // 1_000_000_000)
    put("I", stamp_ns % 1_000_000_000)
    text(frame)
    put("I", 1)
    put("I", len(points))
    put("I", 4)
    for name, offset, number in (("x", 0, code), ("y", size, code), ("z", 2 * size, code), ("ring", 3 * size, 4)):
        text(name)
        put("I", offset)
        put("B", number)
        put("I", 1)
    put("B", 0)
    put("I", kind.itemsize)
    put("I", kind.itemsize * len(points))
    put("I", kind.itemsize * len(points))
    out.extend(points.tobytes())
    put("B", 1)
    return bytes(out)
