"""Archive files of any size as a source of member rows.

    spark.read.format("archive_members").load(folder).filter("name LIKE 'logs/%'")

A file is read as a stream, so memory stays within one member's content.  What lies
beside a file as `<name>.frames` tells where independent streams start inside it (see
`sinks.bundle_parts`); then several tasks share one archive.  Without it a compressed
file has no place to start but its beginning, and one task reads it.  Small archives
share a task: there are as many tasks as there is to read, not as there are files.

Filters on the member's name, type and size and on the file's path are pushed into the
reader: content of other members is passed over without being kept, and files of other
paths are not opened.
"""

from __future__ import annotations

import gzip
import os
import tarfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringEndsWith,
    StringStartsWith,
)
from pyspark.sql.types import StructType

from stowage.session import tune
from stowage.sources.archives import BATCH_BYTES, BATCH_ROWS, kind_of
from stowage.sources.store import Range, files_below, open_store

FRAMES = ".frames"
SUFFIXES = {".tar.gz": "gzip", ".tgz": "gzip", ".tar.zst": "zstd"}
#: Frames next to each other, and small archives, are read by one task until they hold so many bytes.
TASK_BYTES = 64 << 20
#: To open an archive costs as much as to read so many bytes, at a share of a task.
OPEN_SHARE = 256

MEMBERS = (
    "path string, member_idx bigint, name string, member_type string, size_bytes bigint, content binary, error string"
)
_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("member_idx", pa.int64()),
        ("name", pa.string()),
        ("member_type", pa.string()),
        ("size_bytes", pa.int64()),
        ("content", pa.binary()),
        ("error", pa.string()),
    ]
)


def inflated(stream, codec: str):
    """The bytes of one compressed stream, or of several after each other."""
    if codec == "gzip":
        return gzip.GzipFile(fileobj=stream)
    if codec == "zstd":
        return zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True)
    raise ValueError(f"unknown codec {codec!r}")


def codec_of(name: str) -> str | None:
    return next((codec for suffix, codec in SUFFIXES.items() if name.endswith(suffix)), None)


def stream_members(
    stream, codec: str, first: int, wanted: Callable[[str, str, int], bool], max_content_bytes: int | None, keep_content: bool
) -> Iterator[tuple]:
    """(member_idx, name, member_type, size_bytes, content, error) of a compressed stretch of an archive.

    Damage ends the stretch with a row that names it.
    """
    index = first - 1
    try:
        with inflated(stream, codec) as plain, tarfile.open(fileobj=plain, mode="r|") as tar:
            for index, item in enumerate(tar, first):
                kind = kind_of(item)
                if not wanted(item.name, kind, item.size):
                    continue
                content = None
                if keep_content and kind == "file" and (max_content_bytes is None or item.size <= max_content_bytes):
                    content = tar.extractfile(item).read()
                yield index, item.name, kind, item.size, content, None
    except Exception as problem:  # noqa: BLE001 - any damage is reported, not raised
        yield index + 1, None, "unreadable", 0, None, f"{type(problem).__name__}: {problem}"


def batches_of(rows: Iterator[tuple], schema: pa.Schema, content_at: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches that are small in rows and in bytes of content."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[content_at] or b"")
        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, field.type) for c, field in zip(columns, schema, strict=True)], schema=schema
    )


@dataclass(frozen=True)
class Stretch:
    path: str
    offset: int
    length: int | None
    first: int


class Task(InputPartition):
    """Stretches that one task reads after each other; what their paths begin with is held once."""

    def __init__(self, stretches: list[Stretch]) -> None:
        super().__init__(None)
        self.start = os.path.commonprefix([s.path for s in stretches])
        self.rest = [(s.path[len(self.start) :], s.offset, s.length, s.first) for s in stretches]

    def stretches(self) -> Iterator[Stretch]:
        return (Stretch(self.start + rest, *where) for rest, *where in self.rest)


def tasks_of(stretches: Iterable[Stretch]) -> Iterator[Task]:
    """Stretches in order, together until they would hold more than TASK_BYTES."""
    held, size = [], 0
    for stretch in stretches:
        cost = (stretch.length or 0) + TASK_BYTES // OPEN_SHARE
        if held and size + cost > TASK_BYTES:
            yield Task(held)
            held, size = [], 0
        held.append(stretch)
        size += cost
    if held:
        yield Task(held)


_TESTS = {
    EqualTo: lambda value, wanted: value == wanted,
    In: lambda value, wanted: value in wanted,
    LessThan: lambda value, wanted: value < wanted,
    LessThanOrEqual: lambda value, wanted: value <= wanted,
    GreaterThan: lambda value, wanted: value > wanted,
    GreaterThanOrEqual: lambda value, wanted: value >= wanted,
    StringStartsWith: lambda value, wanted: value.startswith(wanted),
    StringEndsWith: lambda value, wanted: value.endswith(wanted),
}


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.content = options.get("content", "true").lower() == "true"
        most = options.get("max_content_bytes")
        self.max_content_bytes = int(most) if most else None
        self.tests: dict[str, list[tuple[type, object]]] = {"path": [], "name": [], "member_type": [], "size_bytes": []}

    def pushFilters(self, filters):
        """Take what a member's header or its file's path decides; hand the rest back.

        Rows of damage have no name and type, and a filter on these drops them, as it
        would in the plan.
        """
        for test in filters:
            column = ".".join(getattr(test, "attribute", ()))
            if column in self.tests and type(test) in _TESTS and test.value is not None:
                self.tests[column].append((type(test), test.value))
            else:
                yield test

    def _passes(self, column: str, value) -> bool:
        return all(value is not None and _TESTS[kind](value, wanted) for kind, wanted in self.tests[column])

    def partitions(self):
        store, path = open_store(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        every = [(path, info.size)] if info.type == fs.FileType.File else files_below(store, path)
        found = [(name, size) for name, size in every if codec_of(name) is not None and self._passes("path", name)]
        found.sort()
        return list(tasks_of(self._stretches(store, found))) or [Task([])]

    def _stretches(self, store: fs.FileSystem, found: list[tuple[str, int | None]]) -> Iterator[Stretch]:
        for name, size in found:
            # Frames are only looked for where they can cut a file.
            if size is None or 0 < size < TASK_BYTES or store.get_file_info(name + FRAMES).type != fs.FileType.File:
                yield Stretch(name, 0, size, 0)
                continue
            with store.open_input_stream(name + FRAMES) as opened:
                frames = np.frombuffer(opened.read(), "<i8").reshape(-1, 3).tolist()
            start, first, members = 0, 0, 0
            for offset, length, n in frames:
                if offset + length - start >= TASK_BYTES:
                    yield Stretch(name, start, offset + length - start, first)
                    start, first = offset + length, members + n
                members += n
            if start < size:
                yield Stretch(name, start, size - start, first)

    def read(self, partition: Task):
        store, _ = open_store(self.path)
        member = ("name", "member_type", "size_bytes")

        def wanted(*values) -> bool:
            return all(self._passes(column, value) for column, value in zip(member, values, strict=True))

        def rows() -> Iterator[tuple]:
            for at in partition.stretches():
                with store.open_input_file(at.path) as opened:
                    stretch = Range(opened, at.offset, at.length)
                    found = stream_members(
                        stretch, codec_of(at.path), at.first, wanted, self.max_content_bytes, self.content
                    )
                    for row in found:
                        if row[-1] is None or not (self.tests["name"] or self.tests["member_type"]):
                            yield (at.path, *row)

        yield from batches_of(rows(), _ARROW, content_at=5)


class ArchiveMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options)


def with_archives(spark: SparkSession) -> SparkSession:
    """Make the format known to the session, with filters pushed into it."""
    tune(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveMembers)
    return spark
