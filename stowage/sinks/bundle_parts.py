"""Bundles packed by many tasks: parts of archives in shared files, and an index of them.

The members of a bundle are cut into parts along their order.  A part is a compressed
stream of its own, and formats of compressed streams read several after each other as
one: the parts of a bundle in order, and an end mark, are its archive.  So a bundle that
holds a third of all rows is packed by as many tasks as it has parts.

A task writes the parts that it is given one after another into files of its own, which
are named anew on every attempt; the index, a table, names the stretches that count.
What a lost or repeated task left behind is named nowhere.  Content is shuffled once and
never comes back; nothing is gathered but one index row a part.

Manifests are written the same way: as texts of entries a slice, whose concatenation is
the canonical text, and which are signed as they stream by.
"""

from __future__ import annotations

import hashlib
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions import canonical, text
from stowage.operators.validate import BUNDLE
from stowage.plans.sliced import SlicedOrder, by_number
from stowage.schemas import MANIFEST_VERSION, SIGNATURE_PREFIX
from stowage.sources.archive_files import FRAMES, batches_of, stream_members
from stowage.sources.store import Range, open_store

#: Members of a part, and entries in one text of a manifest.
PART_MEMBERS, SLICE_ENTRIES = 1024, 1000
#: A task begins another file when one holds so many bytes.
FILE_BYTES = 1 << 30
#: Parts of a bundle that are placed in one task.
PLACED_PARTS = 10_000
SUFFIX = {"gzip": ".tar.gz", "zstd": ".tar.zst"}

_END = b"\0" * (2 * tarfile.BLOCKSIZE)


def _squeezer(codec: str):
    if codec == "gzip":
        return zlib.compressobj(wbits=31)
    if codec == "zstd":
        return zstandard.ZstdCompressor(level=3).compressobj()
    raise ValueError(f"unknown codec {codec!r}")


def end_mark(codec: str) -> bytes:
    """The stream that ends an archive."""
    squeezer = _squeezer(codec)
    return squeezer.compress(_END) + squeezer.flush()


class _PartFile:
    """The file that a task is writing parts to."""

    def __init__(self, folder: str, codec: str) -> None:
        self.store, self.folder = open_store(folder)
        self.codec, self.name, self.out, self.at = codec, None, None, 0

    def begin(self) -> None:
        if self.out is None or self.at >= FILE_BYTES:
            self.close()
            self.store.create_dir(self.folder, recursive=True)
            self.name, self.at = f"parts-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0
            self.out = self.store.open_output_stream(f"{self.folder}/{self.name}")
        self.squeezer, self.start, self.n_files, self.n_bytes = _squeezer(self.codec), self.at, 0, 0

    def add(self, path: str, content: bytes) -> None:
        info = tarfile.TarInfo(path)
        info.size = len(content)
        for piece in (info.tobuf(), content, b"\0" * (-len(content) % tarfile.BLOCKSIZE)):
            self._write(self.squeezer.compress(piece))
        self.n_files, self.n_bytes = self.n_files + 1, self.n_bytes + len(content)

    def _write(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.at += len(data)

    def end(self) -> tuple[str, int, int, int, int]:
        self._write(self.squeezer.flush())
        return self.name, self.start, self.at - self.start, self.n_files, self.n_bytes

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
        self.out = None


def write_parts(
    files: DataFrame,
    folder: str,
    keys: tuple[str, ...] = BUNDLE,
    codec: str = "gzip",
    part_members: int = PART_MEMBERS,
) -> DataFrame:
    """Pack all bundles into a shared folder; the index: one row a part.

    `files` has the keys, member_idx (no two alike in a bundle), relative_path and
    content; null content counts as empty.  The index has keys, part, file, offset,
    length, n_files and n_bytes.
    """
    types = dict(files.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    schema += ", part bigint, file string, offset bigint, length bigint, n_files bigint, n_bytes bigint"
    rows = files.select(*keys, "member_idx", "relative_path", "content").withColumns(by_number("member_idx", part_members, "part"))
    group = [*keys, "part"]
    ordered = rows.repartition(*group).sortWithinPartitions(*group, "member_idx")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, kinds = _PartFile(folder, codec), None, []

        def done() -> pa.RecordBatch:
            values = [*current, *out.end()]
            arrays = [pa.array([v], t) for v, t in zip(values, [*kinds, pa.string(), *[pa.int64()] * 4], strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[*group, "file", "offset", "length", "n_files", "n_bytes"])

        try:
            for batch in batches:
                kinds = [batch.schema.field(c).type for c in group]
                owners = zip(*[batch.column(c).to_pylist() for c in group], strict=True)
                contents = batch.column("content")
                for at, (owner, path) in enumerate(zip(owners, batch.column("relative_path").to_pylist(), strict=True)):
                    if owner != current:
                        if current is not None:
                            yield done()
                        current = owner
                        out.begin()
                    out.add(path, contents[at].as_py() or b"")
            if current is not None:
                yield done()
        finally:
            out.close()

    index = f"{folder.rstrip('/')}/index"
    ordered.mapInArrow(pack, schema).write.mode("overwrite").parquet(index)
    return files.sparkSession.read.parquet(index)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/index")


def placed(index: DataFrame, keys: tuple[str, ...] = BUNDLE) -> DataFrame:
    """Add where each part begins in its archive (`archive_offset`) and its first member's number (`first_member`)."""
    order = SlicedOrder(keys, by_number("part", PLACED_PARTS, "_parts"), ("part",))
    return order.running(
        index, {"archive_offset": F.col("length"), "first_member": F.col("n_files")}, inclusive=False
    )


def read_part_members(
    index: DataFrame,
    folder: str,
    keys: tuple[str, ...] = BUNDLE,
    codec: str = "gzip",
    max_content_bytes: int | None = None,
    with_content: bool = True,
) -> DataFrame:
    """Members of packed bundles, every part read on its own: keys, member_idx, name, member_type, size_bytes, content, error."""
    types = dict(index.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    schema += ", member_idx bigint, name string, member_type string, size_bytes bigint, content binary, error string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        for batch in batches:
            fields = [batch.schema.field(k) for k in keys]
            fields += [
                pa.field("member_idx", pa.int64()), pa.field("name", pa.string()), pa.field("member_type", pa.string()),
                pa.field("size_bytes", pa.int64()), pa.field("content", pa.binary()), pa.field("error", pa.string()),
            ]

            def rows():
                names = [*keys, "file", "offset", "length", "first_member"]
                for *own, file, offset, length, first in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                    with store.open_input_file(f"{path}/{file}") as opened:
                        every = lambda *_: True
                        stretch = Range(opened, offset, length)
                        for row in stream_members(stretch, codec, first, every, max_content_bytes, with_content):
                            yield (*own, *row)

            yield from batches_of(rows(), pa.schema(fields), content_at=len(keys) + 4)

    # A row of the index is a task's worth of reading; spread them.
    spread = placed(index, keys).select(*keys, "part", "file", "offset", "length", "first_member")
    return spread.repartition(*keys, "part").mapInArrow(read, schema)


def join_parts(
    index: DataFrame, folder: str, target: str, name: Column, keys: tuple[str, ...] = BUNDLE, codec: str = "gzip"
) -> DataFrame:
    """One archive file a bundle, for receivers that need one: keys, path, length, n_parts.

    Parts are copied block by block.  Beside each file its `.frames` tell where the
    parts lie, so that it can be read by many tasks again.  A file that is there
    already is replaced by its like.
    """
    types = dict(index.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", path string, length bigint, n_parts bigint"
    named = index.select(*keys, "part", "file", "offset", "length", "n_files", name.alias("name"))
    ordered = named.repartition(*keys).sortWithinPartitions(*keys, "part")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, source = open_store(folder)
        into, goal = open_store(target)
        into.create_dir(goal, recursive=True)
        current, out, path, frames, kinds = None, None, "", [], []

        def done() -> pa.RecordBatch:
            with out:
                out.write(end_mark(codec))
            with into.open_output_stream(path + FRAMES) as side:
                side.write(np.array(frames, "<i8").tobytes())
            last = frames[-1]
            values = [*current, path, last[0] + last[1] + len(end_mark(codec)), len(frames)]
            arrays = [pa.array([v], t) for v, t in zip(values, [*kinds, pa.string(), pa.int64(), pa.int64()], strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[*keys, "path", "length", "n_parts"])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            owners = zip(*[batch.column(k).to_pylist() for k in keys], strict=True)
            parts = zip(*[batch.column(c).to_pylist() for c in ("name", "file", "offset", "length", "n_files")], strict=True)
            for owner, (label, file, offset, length, n_files) in zip(owners, parts, strict=True):
                if owner != current:
                    if current is not None:
                        yield done()
                    current, frames, path = owner, [], f"{goal}/{label}{SUFFIX[codec]}"
                    out = into.open_output_stream(path, compression=None)  # as it is, whatever its name
                with store.open_input_file(f"{source}/{file}") as opened:
                    for block in Range(opened, offset, length).blocks():
                        out.write(block)
                frames.append((sum(frames[-1][:2]) if frames else 0, length, n_files))
        if current is not None:
            yield done()

    return ordered.mapInArrow(join, schema)


# -- manifests ----------------------------------------------------------------
def manifest_chunks(
    selected: DataFrame,
    sent_at: Column,
    source_root: Column,
    keys: tuple[str, ...] = BUNDLE,
    entries: int = SLICE_ENTRIES,
) -> DataFrame:
    """Texts whose concatenation by `slice` is a bundle's canonical manifest: keys, slice, n_files, chunk.

    `selected` is as `manifest.build_manifests` takes it.  A text holds `entries`
    entries at most; the first brings what stands before them and the last what
    stands after.
    """
    entry = F.to_json(
        F.struct(
            text.utc_text_from_epoch(F.col("mtime")).alias("mtime"),
            "relative_path",
            "sha256",
            F.col("size_bytes").cast("long").alias("size_bytes"),
        )
    )
    rows = selected.select(*keys, "member_idx", canonical.lower_escapes(entry).alias("_entry")).withColumns(
        by_number("member_idx", entries, "slice")
    )
    # `entries` positions at most fall into one slice.
    gathered = F.array_sort(F.collect_list(F.struct("member_idx", "_entry")))
    slices = rows.groupBy(*keys, "slice").agg(
        F.array_join(F.transform(gathered, lambda e: e["_entry"]), ",").alias("_text"), F.count(F.lit(1)).alias("n_files")
    )
    ends = rows.groupBy(*keys).agg(F.min("slice").alias("_first"), F.max("slice").alias("_last"))
    whole = canonical.manifest_text(
        bundle_id=F.col("bundle_id"),
        files=F.array().cast("array<string>"),
        sender_id=F.col("sender_id"),
        sent_at=sent_at,
        source_root=source_root,
        schema_version=F.lit(MANIFEST_VERSION).cast("long"),
    )
    # The empty list of files stands after the id, whose quotes are escaped.
    cut = F.position(F.lit('","files":[]'), whole) + F.lit(len('","files":['))
    head, tail = F.substr(whole, F.lit(1), cut - 1), F.substr(whole, cut)
    is_first, is_last = F.col("slice") == F.col("_first"), F.col("slice") == F.col("_last")
    return slices.join(ends, list(keys)).select(
        *keys,
        "slice",
        "n_files",
        F.concat(
            F.when(is_first, head).otherwise(F.lit(",")), F.col("_text"), F.when(is_last, tail).otherwise(F.lit(""))
        ).alias("chunk"),
    )


def sign_chunks(chunks: DataFrame, senders: DataFrame, keys: tuple[str, ...] = BUNDLE) -> DataFrame:
    """keys, n_files, n_bytes, signature: the keyed signature over each whole manifest, chunk after chunk.

    One digest runs through a bundle's chunks in order, so its task holds a chunk at a
    time.  Senders that are not known sign nothing: their signature is null.
    """
    types = dict(chunks.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n_files bigint, n_bytes bigint, signature string"
    pads = senders.select("sender_id", "ipad", "opad")
    keyed = chunks.join(pads, "sender_id", "left").select(*keys, "slice", "n_files", F.col("chunk").cast("binary"), "ipad", "opad")
    ordered = keyed.repartition(*keys).sortWithinPartitions(*keys, "slice")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, inner, outer, n_files, n_bytes, kinds = None, None, None, 0, 0, []

        def done() -> pa.RecordBatch:
            signed = None
            if outer is not None:
                signed = SIGNATURE_PREFIX + hashlib.sha256(outer + inner.digest()).hexdigest()
            values = [*current, n_files, n_bytes, signed]
            arrays = [pa.array([v], t) for v, t in zip(values, [*kinds, pa.int64(), pa.int64(), pa.string()], strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[*keys, "n_files", "n_bytes", "signature"])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            owners = zip(*[batch.column(k).to_pylist() for k in keys], strict=True)
            parts = zip(*[batch.column(c).to_pylist() for c in ("n_files", "chunk", "ipad", "opad")], strict=True)
            for owner, (n, chunk, ipad, opad) in zip(owners, parts, strict=True):
                if owner != current:
                    if current is not None:
                        yield done()
                    current, n_files, n_bytes = owner, 0, 0
                    inner, outer = hashlib.sha256(ipad or b""), opad
                inner.update(chunk)
                n_files, n_bytes = n_files + n, n_bytes + len(chunk)
        if current is not None:
            yield done()

    return ordered.mapInArrow(sign, schema)
