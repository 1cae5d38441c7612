"""Writers over plain Parquet folders.

Every write of a batch goes to a folder of its own named after the batch and
replaces it, so a batch that is run again leaves the same table behind.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions import text
from stowage.operators.validate import BUNDLE
from stowage.session import through_table

# ---- fixed values -----------------------------------------------------------
ZSTD_LEVEL = "3"
# ---- end of fixed values ----------------------------------------------------
#: Copies that are made at the same time.
COPIES = 4


class QuarantineCollision(ValueError):
    """A bundle to be stored is stored already."""


def collisions(bundles: DataFrame, stored: DataFrame) -> DataFrame:
    """Bundles of this write that the store already holds."""
    return bundles.select(*BUNDLE).distinct().join(
        stored.select(*BUNDLE).distinct(), list(BUNDLE), "left_semi"
    )


def quarantined(members: DataFrame, received_at: Column) -> DataFrame:
    """Rows as they are stored, with the received date and the bundle's folder."""
    dated = members.select("*", *text.date_parts(received_at))
    return dated.withColumn(
        "path", F.concat_ws("/", "sender_id", "yyyy", "mm", "dd", "bundle_id")
    )


def write_quarantine(
    members: DataFrame, received_at: Column, root: str, stored: DataFrame | None = None
) -> None:
    """Store members under sender and received date; refuse a known bundle.

    With `stored` the members are written once before they are looked at twice.
    """
    if stored is not None:
        members = through_table(members, "to-store")
    if stored is not None and collisions(members, stored).limit(1).count():
        raise QuarantineCollision("a bundle of this write is already stored")
    folders = ("sender_id", "yyyy", "mm", "dd")
    # Rebalancing gives each folder few files, and a busy sender several tasks.
    rows = quarantined(members, received_at).hint("rebalance", *folders)
    rows.write.partitionBy(*folders).mode("append").parquet(root)


def write_batch(df: DataFrame, root: str, batch_id: int, partition_by: tuple[str, ...] = ()) -> None:
    """Store one batch; the same batch again replaces itself."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/batch_id={batch_id}")


def read_batches(spark: SparkSession, root: str, schema: str, before: int | None = None) -> DataFrame:
    """All batches of a table, or those before one; empty when there are none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], schema + ", batch_id bigint")
    table = spark.read.schema(schema + ", batch_id bigint").parquet(root)
    return table if before is None else table.filter(F.col("batch_id") < before)


def _numbered(spark: SparkSession, root: str, prefix: str) -> tuple[list[int], object]:
    """Numbers of the folders `prefix`N below a root, and the file system they are on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [entry.getPath().getName() for entry in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix)), fs


def newest_batch(spark: SparkSession, root: str, schema: str, before: int) -> DataFrame:
    """The last batch of a table before the given one, found by folder name; nothing else is opened."""
    newest = max((i for i in _numbered(spark, root, "batch_id=")[0] if i < before), default=None)
    if newest is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/batch_id={newest}")


def write_snapshot(
    files: DataFrame, root: str, name: str, exclusions: tuple[str, ...] = (), path: str = "path"
) -> str:
    """Store a tree as one snapshot folder, zstd-compressed, without excluded paths."""
    from stowage.operators.restore import without_excluded

    kept = without_excluded(files, exclusions, path=path) if exclusions else files
    target = f"{root}/snapshot={name}"
    kept.write.mode("errorifexists").option("compression", "zstd").option(
        "parquet.compression.codec.zstd.level", ZSTD_LEVEL
    ).parquet(target)
    return target


def snapshot_name(directory: str, taken_at: Column) -> Column:
    """Default name: directory, dash, date, dash, time."""
    return F.concat(F.lit(f"{directory}-"), F.date_format(taken_at, "yyyyMMdd-HHmmss"))


def copy_to_all(source: str, targets: list[str], spark: SparkSession) -> DataFrame:
    """Copy a stored table to every target, several at a time; one failing target stops no other.

    Returns one row per target; the copy succeeded when any is ok.  The source is a
    written table, so each copy is one distributed read and write; a source that is not
    there is the caller's error and no target's.  A copy takes its target's place when
    it is complete: a target whose copy fails keeps what it held.
    """
    stored = spark.read.parquet(source)

    def copy(target: str) -> tuple[str, bool, str | None]:
        try:
            attempt = f"{target.rstrip('/')}.copying-{uuid.uuid4().hex}"
            stored.write.parquet(attempt)
            _replace(spark, attempt, target)
            return target, True, None
        except Exception as problem:  # noqa: BLE001 - reported per target
            return target, False, type(problem).__name__

    with ThreadPoolExecutor(max_workers=max(1, min(COPIES, len(targets)))) as pool:
        rows = list(pool.map(copy, targets))
    return spark.createDataFrame(rows, "target string, ok boolean, error string")


def _replace(spark: SparkSession, made: str, target: str) -> None:
    made, target = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (made, target))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(made, target):
        raise OSError(f"could not put {made} in the place of {target}")


def copied_anywhere(status: DataFrame) -> DataFrame:
    return status.agg(
        F.coalesce(F.bool_or("ok"), F.lit(False)).alias("ok"), F.count_if("ok").alias("copies")
    )


def append_audit(lines: DataFrame, root: str, batch_id: int) -> None:
    write_batch(lines, f"{root}/lines", batch_id)
