"""Frames as image files of their own: a sink of portable grey maps (``.pgm``) and pixel maps (``.ppm``).

Tasks write under passing names; the files get their lasting ones when all
tasks have ended well, and a run that fails leaves none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .logs import _store

COLUMNS = "name string, h int, w int, format string, data binary"


def image(h: int, w: int, kind: str, data: bytes) -> tuple[str, bytes]:
    """The ending and content of a frame's file; levels of sixteen bits are stored as they are."""
    if kind == "bgr8":
        return ".ppm", b"P6 %d %d 255\n" % (w, h) + np.frombuffer(data, np.uint8).reshape(-1, 3)[:, ::-1].tobytes()
    if kind == "mono16":
        return ".pgm", b"P5 %d %d 65535\n" % (w, h) + np.frombuffer(data, "<u2").astype(">u2").tobytes()
    return ".pgm", b"P5 %d %d 255\n" % (w, h) + data


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has finished, under their passing and their lasting names."""

    files: list[tuple[str, str]]


class FrameWriter(DataSourceArrowWriter):
    """A file a row, named by its column ``name``."""

    def __init__(self, folder: str) -> None:
        self.folder, self.run = folder.rstrip("/"), uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.folder)
        files = []
        for batch in batches:
            for row in batch.select(["name", "h", "w", "format", "data"]).to_pylist():
                if not row["name"] or {"/", "\0"} & set(row["name"]):
                    raise ValueError(f"a frame's file needs a name without a slash, not {row['name']!r}")
                ending, content = image(row["h"], row["w"], row["format"], row["data"])
                passing = f"{root}/_temporary-{self.run}/{uuid.uuid4().hex}"
                store.create_dir(f"{root}/_temporary-{self.run}", recursive=True)
                with store.open_output_stream(passing) as out:
                    out.write(content)
                files.append((passing, f"{root}/{row['name']}{ending}"))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.folder)
        files = [f for m in messages if m for f in m.files]
        lasting = {name for _, name in files}
        if len(lasting) < len(files):
            raise ValueError("two frames have one name")
        for passing, name in files:
            store.move(passing, name)
        self._cleared(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._cleared(*_store(self.folder))

    def _cleared(self, store: pafs.FileSystem, root: str) -> None:
        place = f"{root}/_temporary-{self.run}"
        if store.get_file_info(place).type != pafs.FileType.NotFound:
            store.delete_dir(place)


class FrameFiles(DataSource):
    """Option: ``path`` (a folder) to write."""

    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return COLUMNS

    def writer(self, schema: StructType, overwrite: bool) -> FrameWriter:
        if overwrite:
            raise ValueError("frames are only added")
        return FrameWriter(self.options["path"])


def write_frames(frames: DataFrame, folder: str, first: int | None = None) -> None:
    """Write usable frames ``(name, h, w, format, data)``; ``first`` keeps the first so many by name."""
    frames.sparkSession.dataSource.register(FrameFiles)
    rows = frames.select("name", "h", "w", "format", "data")
    (rows if first is None else rows.orderBy("name").limit(first)).write.format("frame_files").mode("append").save(folder)
