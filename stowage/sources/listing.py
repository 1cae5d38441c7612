"""File listings and backup catalogs as tables."""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.functions import paths
from stowage.session import through_table

# ---- fixed values -----------------------------------------------------------
ARCHIVE_SUFFIX = ".tar.zst"
PROBE_BYTES = 8192
# ---- end of fixed values ----------------------------------------------------
BLOCK_BYTES = 1 << 20
_MOUNTED = re.compile(r"(?:file:)?/+(?=[^/]|$)")
_FILE_COLUMNS = ("root", "root_ord", "root_is_file", "relative_path", "size_bytes", "mtime")


def _local(path: Column) -> Column:
    return F.regexp_replace(path, r"^[a-z0-9]+:/+", "/")


def scan_root(spark: SparkSession, root: str, root_ord: int, with_content: bool = True) -> DataFrame:
    """File table of one directory tree or one file, listed by Spark.

    The file source leaves out empty files and names that start with '.' or
    '_', and follows links; where that matters, use `from_listing` over a
    listing table.  A filter on size_bytes reaches the scan, and content that
    nobody asks for is not read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    top = root.rstrip("/")
    local = _local(F.col("path"))
    below = F.substring(local, len(top) + 2, 1 << 30)
    is_file = local == top
    columns = {
        "root": F.lit(top),
        "root_ord": F.lit(root_ord),
        "root_is_file": is_file,
        "relative_path": F.when(is_file, paths.base_name(F.lit(top))).otherwise(below),
        "size_bytes": F.col("length"),
        "mtime": F.unix_micros("modificationTime") / F.lit(1e6),
    }
    if with_content:
        columns["content"] = F.col("content")
    return raw.select(*[value.alias(name) for name, value in columns.items()])


def scan_roots(spark: SparkSession, roots: list[str], with_content: bool = True) -> DataFrame:
    """File table of several roots in order; roots that do not exist are skipped.

    Roots on a mount that every executor sees are listed exactly: hidden and empty
    files are there, links and special files are not.  Roots in another store are
    listed by Spark, see `scan_root`.  Content is one value a file, for files that fit
    into one; `with_digests` reads files of any size.
    """
    mounted = [(number, root) for number, root in enumerate(roots) if _MOUNTED.match(root)]
    frames = []
    if mounted:
        tops = [(_MOUNTED.sub("/", root).rstrip("/"), number) for number, root in mounted]
        listed = from_listing(_walked(spark, tops))
        chosen = listed.select(*_FILE_COLUMNS)
        frames.append(_content_of(chosen) if with_content else chosen)
    for number, root in enumerate(roots):
        if not _MOUNTED.match(root) and _exists(spark, root):
            frames.append(scan_root(spark, root, number, with_content).withColumn("size_bytes", F.col("size_bytes").cast("long")))
    if not frames:
        schema = "root string, root_ord int, root_is_file boolean, relative_path string, size_bytes bigint, mtime double"
        return spark.createDataFrame([], schema + (", content binary" if with_content else ""))
    joined = frames[0]
    for frame in frames[1:]:
        joined = joined.unionByName(frame)
    return joined


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hadoop_path))


LISTING = "root string, root_ord int, path string, kind string, size_bytes bigint, mtime double"


def walk(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Exact listing of trees on a mount every executor sees.

    Hidden and empty files are listed, links are named and not followed, missing
    roots give nothing.  One job per level of depth; the directories of a level
    are dealt over the executors, and entries stream out while one is read.
    """
    return _walked(spark, [(r.rstrip("/"), n) for n, r in enumerate(roots)])


def _walked(spark: SparkSession, numbered: list[tuple[str, int]]) -> DataFrame:
    tops = [(root, number, root) for root, number in numbered]
    level = spark.createDataFrame(tops, "root string, root_ord int, path string")
    levels = [through_table(level.mapInPandas(_describe, LISTING), "level")]
    while not (folders := levels[-1].filter("kind = 'dir'")).isEmpty():
        dealt = folders.select("root", "root_ord", "path").repartition("path")
        levels.append(through_table(dealt.mapInPandas(_children, LISTING), "level"))
    listed = levels[0]
    for deeper in levels[1:]:
        listed = listed.unionByName(deeper)
    return listed


def _row(root: str, root_ord: int, path: str) -> tuple:
    found = os.lstat(path)
    if stat.S_ISLNK(found.st_mode):
        kind = "link"
    elif stat.S_ISDIR(found.st_mode):
        kind = "dir"
    else:
        kind = "file" if stat.S_ISREG(found.st_mode) else "other"
    return root, root_ord, path, kind, found.st_size, found.st_mtime


def _frames(rows: Iterator[tuple], size: int = 10_000) -> Iterator[pd.DataFrame]:
    names = ["root", "root_ord", "path", "kind", "size_bytes", "mtime"]
    while chunk := list(itertools.islice(rows, size)):
        yield pd.DataFrame(chunk, columns=names)


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    named = (row for batch in batches for row in batch.itertuples(index=False))
    yield from _frames(_row(*row) for row in named if os.path.lexists(row.path))


def _children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    named = (row for batch in batches for row in batch.itertuples(index=False))
    yield from _frames(
        _row(row.root, row.root_ord, f"{row.path}/{entry.name}") for row in named for entry in os.scandir(row.path)
    )


def with_content(files: DataFrame) -> DataFrame:
    """Add the bytes of listed files, read where the rows are.

    Filter by size first; batches are kept small for the wide column.
    """
    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])
    path = F.when(F.col("root_is_file"), F.col("root")).otherwise(F.concat_ws("/", "root", "relative_path"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 64):
                part = batch.iloc[start : start + 64]
                content = [_bytes(p) for p in part["_path"]]
                yield part.drop(columns="_path").assign(content=content)

    return files.withColumn("_path", path).mapInPandas(read, schema)


#: The same under a name that a parameter of `scan_roots` does not hide.
_content_of = with_content


def with_digests(files: DataFrame, probe_bytes: int = PROBE_BYTES, max_bytes: int | None = None) -> DataFrame:
    """Add sha256, has_nul and error of listed files of any size, read block by block.

    One digest runs through a file, so a task holds one block.  has_nul tells whether
    the first probe_bytes hold a zero byte.  Files above max_bytes are not opened, and
    their digest is null, as is that of a file that cannot be read, whose error says
    why.  Files are dealt over the tasks by name, not by folder.
    """
    added = "sha256 string, has_nul boolean, error string"
    schema = T.StructType([*files.schema.fields, *T.StructType.fromDDL(added).fields])
    path = F.when(F.col("root_is_file"), F.col("root")).otherwise(F.concat_ws("/", "root", "relative_path"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wanted = batch["size_bytes"].map(lambda size: max_bytes is None or size <= max_bytes)
            found = [_digest(p, probe_bytes) if ok else (None, None, None) for p, ok in zip(batch["_path"], wanted)]
            sha256, has_nul, error = (list(c) for c in zip(*found)) if found else ([], [], [])
            columns = {"sha256": sha256, "has_nul": pd.array(has_nul, "boolean"), "error": error}
            yield batch.drop(columns="_path").assign(**columns)

    dealt = files.withColumn("_path", path).repartition("root", "relative_path")
    return dealt.mapInPandas(read, schema)


def _digest(path: str, probe_bytes: int) -> tuple[str | None, bool | None, str | None]:
    """(digest, zero byte near the start, error) of one file."""
    running, head = hashlib.sha256(), b""
    try:
        with open(path, "rb") as handle:
            while block := handle.read(BLOCK_BYTES):
                running.update(block)
                if len(head) < probe_bytes:
                    head += block[: probe_bytes - len(head)]
    except OSError as problem:
        return None, None, f"{type(problem).__name__}: {problem.strerror}"
    return running.hexdigest(), b"\0" in head, None


def _bytes(path: str) -> bytes:
    with open(path, "rb") as handle:
        return handle.read()


def from_listing(listing: DataFrame) -> DataFrame:
    """File table from a listing that knows links, hidden and empty files.

    `listing` has root, root_ord, path, kind ('file', 'dir', 'link', 'other'),
    size_bytes and mtime; links and special files are skipped, as are entries
    outside their root.
    """
    inside = F.startswith(F.col("path"), F.concat(F.col("root"), F.lit("/")))
    is_root = F.col("path") == F.col("root")
    return (
        listing.filter((F.col("kind") == "file") & (inside | is_root))
        .withColumns(
            {
                "root_is_file": is_root,
                "relative_path": F.when(is_root, paths.base_name(F.col("path"))).otherwise(
                    F.substr("path", F.length("root") + 2)
                ),
            }
        )
        .drop("path", "kind")
    )


def directories(listing: DataFrame) -> DataFrame:
    """Folders of a listing, for roll-ups that must show empty ones."""
    inside = F.startswith(F.col("path"), F.concat(F.col("root"), F.lit("/")))
    return listing.filter((F.col("kind") == "dir") & inside).select(
        "root", "root_ord", F.substr("path", F.length("root") + 2).alias("folder")
    )


def backups_in(listing: DataFrame) -> DataFrame:
    """Archives directly in the roots of a listing, hidden and empty ones included.

    Gives location, name, modified_time and size_bytes.  `walk(spark, [directory])`
    makes such a listing; an empty archive is the one an operator must see.
    """
    inside = F.startswith(F.col("path"), F.concat(F.col("root"), F.lit("/")))
    name = F.substr("path", F.length("root") + 2)
    found = inside & ~F.contains(name, F.lit("/")) & name.endswith(ARCHIVE_SUFFIX)
    return listing.filter((F.col("kind") == "file") & found).select(
        F.col("root").alias("location"),
        name.alias("name"),
        F.timestamp_micros(F.round(F.col("mtime") * 1e6).cast("long")).alias("modified_time"),
        "size_bytes",
    )


def read_backups(spark: SparkSession, directory: str) -> DataFrame:
    """Archives directly in a directory: location, name, time and size.

    Spark's file source leaves out hidden and empty files; `backups_in` does not.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{ARCHIVE_SUFFIX}")
        .load(directory)
        .select("path", "modificationTime", "length")
    )
    return raw.select(
        F.lit(directory.rstrip("/")).alias("location"),
        paths.base_name(F.col("path")).alias("name"),
        F.col("modificationTime").alias("modified_time"),
        F.col("length").alias("size_bytes"),
    )


def read_catalog(rows: DataFrame) -> DataFrame:
    """Typed catalog from text fields; blank or odd times and sizes become null."""
    return rows.select(
        "id",
        "name",
        F.try_to_timestamp(F.col("modifiedTime")).alias("modified_time"),
        F.expr("try_cast(size AS BIGINT)").alias("size_bytes"),
        *[c for c in ("trashed", "parent") if c in rows.columns],
    )


def remote_backups(
    catalog: DataFrame, pattern: str, folder: str | None = None
) -> DataFrame:
    """Catalog entries whose name holds the pattern, not trashed, newest first."""
    chosen = catalog.filter(F.contains(F.col("name"), F.lit(pattern)) & ~F.col("trashed"))
    if folder is not None:
        chosen = chosen.filter(F.col("parent") == folder)
    return chosen.orderBy(F.col("modified_time").desc(), F.col("id"))


def by_id(catalog: DataFrame, file_id: str) -> DataFrame:
    return catalog.filter(F.col("id") == file_id)
