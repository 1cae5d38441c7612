"""Tar archives as tables: members, listings, validity, packing.

An archive is a stream, so one worker reads one archive from front to back; the
work spreads over archives.  Members are emitted in small batches and a member
above the byte cap is not read, so memory stays within a few files.
"""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.operators.validate import BUNDLE
from stowage.schemas import Limits
from stowage.session import through_table

BATCH_BYTES = 8 * 1024 * 1024
BATCH_ROWS = 512
#: Refused bundles up to this number are sent to every task, a few MB of keys.
BROADCAST_ROWS = 50_000


def _opened(data: bytes, codec: str):
    raw = io.BytesIO(data)
    if codec == "gzip":
        return gzip.GzipFile(fileobj=raw)
    if codec == "zstd":
        return zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    raise ValueError(f"unknown codec {codec!r}")


def kind_of(member: tarfile.TarInfo) -> str:
    if member.isfile():
        return "file"
    if member.isdir():
        return "dir"
    if member.issym() or member.islnk():
        return "link"
    return "special"


_MEMBER_COLUMNS = {
    "member_idx": pa.int64(),
    "name": pa.string(),
    "member_type": pa.string(),
    "size_bytes": pa.int64(),
    "running_files": pa.int64(),
    "running_bytes": pa.int64(),
    "content": pa.binary(),
    "error": pa.string(),
}
_SQL_TYPES = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
_MEMBER_FIELDS = ", ".join(f"{name} {_SQL_TYPES[kind]}" for name, kind in _MEMBER_COLUMNS.items())


def read_members(
    archives: DataFrame,
    keys: list[str],
    codec: str = "gzip",
    max_content_bytes: int | None = Limits().max_file_bytes,
    with_content: bool = True,
    stop_at: Limits | None = None,
) -> DataFrame:
    """One row per member in archive order.

    `archives` has the keys and `archive`.  Content above the byte cap is null:
    a file that large is rejected by its size already.  The running count and
    bytes of members that are no directories come along, since the reader passes
    them in order anyway.  An unreadable archive ends with one row whose `error`
    is set.  With `stop_at` the first member past the count or a size cap is the
    last one read: what follows cannot change the verdict, so an archive that
    inflates without end costs no more than the caps allow.
    """
    types = dict(archives.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys]) + ", " + _MEMBER_FIELDS

    def over(files: int, size: int, total: int) -> bool:
        return files > stop_at.max_files or size > stop_at.max_file_bytes or total > stop_at.max_bundle_bytes

    def members(data: bytes):
        index, files, total = -1, 0, 0
        try:
            with _opened(data, codec) as stream, tarfile.open(fileobj=stream, mode="r|") as tar:
                for index, item in enumerate(tar):
                    content = None
                    if not item.isdir():
                        files, total = files + 1, total + item.size
                    wanted = max_content_bytes is None or item.size <= max_content_bytes
                    if with_content and item.isfile() and wanted:
                        content = tar.extractfile(item).read()
                    yield index, item.name, kind_of(item), item.size, files, total, content, None
                    if stop_at is not None and over(files, item.size, total):
                        return
        except Exception as problem:  # noqa: BLE001 - any damage is reported, not raised
            reason = f"{type(problem).__name__}: {problem}"
            yield index + 1, None, "unreadable", 0, files + 1, total, None, reason

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            ids = zip(*[batch.column(k).to_pylist() for k in keys])
            blobs = batch.column("archive")

            def flush(rows):
                columns = list(zip(*rows))
                arrays = [pa.array(c, t) for c, t in zip(columns, [*kinds, *_MEMBER_COLUMNS.values()])]
                return pa.RecordBatch.from_arrays(arrays, names=[*keys, *_MEMBER_COLUMNS])

            rows, held = [], 0
            for position, key in enumerate(ids):
                for row in members(blobs[position].as_py() or b""):
                    rows.append((*key, *row))
                    held += len(row[-2] or b"")
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield flush(rows)
                        rows, held = [], 0
            if rows:
                yield flush(rows)

    return archives.select(*keys, "archive").mapInArrow(explode, schema)


def list_members(archives: DataFrame, keys: list[str], codec: str = "zstd") -> DataFrame:
    """Member names in archive order, content never kept."""
    return read_members(archives, keys, codec, with_content=False).select(
        *keys, "member_idx", "name", "member_type", "size_bytes", "error"
    )


def _first_header_ok(stream) -> bool:
    """Is the first block a member header, or the end of an archive without members?"""
    try:
        tarfile.TarInfo.frombuf(stream.read(tarfile.BLOCKSIZE), tarfile.ENCODING, "surrogateescape")
    except (tarfile.EmptyHeaderError, tarfile.EOFHeaderError):
        return True
    except tarfile.HeaderError:
        return False
    return True


def _all_headers_ok(stream) -> bool:
    try:
        with tarfile.open(fileobj=stream, mode="r|*") as tar:
            for _ in tar:
                pass
    except Exception:  # noqa: BLE001
        return False
    return True


def check_archives(archives: DataFrame, keys: list[str], codec: str = "zstd") -> DataFrame:
    """Is each archive readable?

    An empty payload counts as valid, and so does one whose first header parses;
    otherwise all headers must.  Damage never fails the job.
    """

    def verdict(data: bytes) -> tuple[bool, str | None]:
        for readable in (_first_header_ok, _all_headers_ok):
            try:
                with _opened(data, codec) as stream:
                    if readable(stream):
                        return True, None
            except Exception as problem:  # noqa: BLE001
                return False, f"{type(problem).__name__}: {problem}"
        return False, "not a tar archive"

    return _per_archive(archives, keys, "valid boolean, error string", [pa.bool_(), pa.string()], verdict)


def check_backup_files(archives: DataFrame, keys: list[str], codec: str = "zstd") -> DataFrame:
    """Stricter test before a backup is published: decompress all, then list all.

    `failed_stage` names the stage: 'zstd' for damage in the compression, 'tar'
    for damage in the archive inside.
    """

    def verdict(data: bytes) -> tuple[bool, str | None]:
        try:
            size = 0
            with _opened(data, codec) as stream:
                while chunk := stream.read(1 << 20):
                    size += len(chunk)
            if not data:
                return False, codec
        except Exception:  # noqa: BLE001
            return False, codec
        if size == 0:
            return True, None
        if size % tarfile.BLOCKSIZE:
            return False, "tar"
        with _opened(data, codec) as stream:
            return (True, None) if _all_headers_ok(stream) else (False, "tar")

    return _per_archive(
        archives, keys, "valid boolean, failed_stage string", [pa.bool_(), pa.string()], verdict
    )


def _per_archive(archives: DataFrame, keys: list[str], fields: str, types: list, verdict) -> DataFrame:
    column_types = dict(archives.dtypes)
    schema = ", ".join([f"`{k}` {column_types[k]}" for k in keys]) + ", " + fields
    names = [part.split()[0] for part in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("archive")
            found = list(zip(*[verdict(blobs[i].as_py() or b"") for i in range(batch.num_rows)]))
            if not found:
                continue
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keys] + [pa.array(c, t) for c, t in zip(found, types)],
                names=[*keys, *names],
            )

    return archives.select(*keys, "archive").mapInArrow(run, schema)


class _Packer:
    """One archive under construction; only its compressed bytes are held."""

    def __init__(self, codec: str) -> None:
        self.count, self.size, self._out = 0, 0, io.BytesIO()
        if codec == "gzip":
            self._squeezed = gzip.GzipFile(fileobj=self._out, mode="wb", mtime=0)
        elif codec == "zstd":
            self._squeezed = zstandard.ZstdCompressor(level=3).stream_writer(self._out, closefd=False)
        else:
            raise ValueError(f"unknown codec {codec!r}")
        self._tar = tarfile.open(fileobj=self._squeezed, mode="w|")

    def add(self, path: str, content: bytes) -> None:
        info = tarfile.TarInfo(path)
        info.size = len(content)
        self._tar.addfile(info, io.BytesIO(content))
        self.count, self.size = self.count + 1, self.size + len(content)

    def close(self) -> bytes:
        self._tar.close()
        self._squeezed.close()
        return self._out.getvalue()


def pack_bundles(
    files: DataFrame,
    limits: Limits | None = None,
    keys: tuple[str, ...] = BUNDLE,
    codec: str = "gzip",
) -> DataFrame:
    """One row per bundle: n_files, n_bytes, status and the archive, members in order.

    `files` has the keys, member_idx, relative_path and content.  Without limits
    every bundle is packed, as the receiver judges counts and sizes.  With limits
    a bundle over the file cap or the byte cap gets a status and no archive: sizes are added up on the scan and the refused
    bundles, few as each fills a cap, are taken out there, so content is shuffled
    once, for packing (twice beyond BROADCAST_ROWS refused bundles).  Rows arrive
    sorted and are packed as they stream by.
    """
    content = files.select(*keys, "member_idx", "relative_path", "content")
    if limits is None:
        return _packed(content, dict(files.dtypes), keys, codec)
    too_many, too_large = F.col("n_files") > limits.max_files, F.col("n_bytes") > limits.max_bundle_bytes
    refused = through_table(
        files.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("n_bytes"),
        )
        .filter(too_many | too_large)
        .withColumn("status", F.when(too_many, "too_many_files").otherwise("bundle_too_large")),
        "refused",
    )
    shut = refused.select(*keys)
    small = shut.count() <= BROADCAST_ROWS
    light = content.join(F.broadcast(shut) if small else shut, list(keys), "left_anti")
    packed = _packed(light, dict(files.dtypes), keys, codec)
    return packed.unionByName(refused.withColumn("archive", F.lit(None).cast("binary")))


def _packed(content: DataFrame, types: dict[str, str], keys: tuple[str, ...], codec: str) -> DataFrame:
    """Every bundle packed as its sorted rows stream by; only compressed bytes are held."""
    kept_keys = ", ".join(f"`{k}` {types[k]}" for k in keys)
    schema = f"{kept_keys}, n_files bigint, n_bytes bigint, archive binary"
    ordered = content.repartition(*keys).sortWithinPartitions(*keys, "member_idx")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def row(key, archive):
            values = [*key, archive.count, archive.size, archive.close()]
            types_ = [*kinds, pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array([v], t) for v, t in zip(values, types_)]
            return pa.RecordBatch.from_arrays(arrays, names=[*keys, "n_files", "n_bytes", "archive"])

        current, archive = None, None
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            key_rows = zip(*[batch.column(k).to_pylist() for k in keys])
            contents = batch.column("content")
            for at, (key, path) in enumerate(zip(key_rows, batch.column("relative_path").to_pylist())):
                if key != current:
                    if archive is not None:
                        yield row(current, archive)
                    current, archive = key, _Packer(codec)
                archive.add(path, contents[at].as_py() or b"")
        if archive is not None:
            yield row(current, archive)

    return ordered.mapInArrow(pack, schema).withColumn("status", F.lit("ok"))
