"""Build, sign and read manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions import canonical, digests, text
from stowage.operators.validate import BUNDLE, SLICE_MEMBERS, member_order
from stowage.schemas import MANIFEST, MANIFEST_VERSION, Limits


def file_digests(files: DataFrame, content: str = "content") -> DataFrame:
    """Replace file content by its SHA-256."""
    return files.withColumn("sha256", digests.sha256_hex(F.col(content))).drop(content)


def build_manifests(
    selected: DataFrame,
    sent_at: Column,
    source_root: Column,
    limits: Limits | None = None,
    keys: tuple[str, ...] = BUNDLE,
    width: int = SLICE_MEMBERS,
) -> DataFrame:
    """One row per bundle: n_files, status and the canonical manifest, files in selection order.

    `selected` has the bundle keys, member_idx, relative_path, sha256,
    size_bytes and mtime (epoch seconds).  Without limits every bundle gets its
    manifest, as the receiver judges counts.  With limits the rows of a bundle over
    the file cap are not gathered: its status is `too_many_files`, its manifest null.
    """
    fits, too_large = (selected, None) if limits is None else member_order(keys, width).within(selected, limits.max_files)
    entry = F.struct(
        "member_idx",
        F.struct(
            text.utc_text_from_epoch(F.col("mtime")).alias("mtime"),
            "relative_path",
            "sha256",
            F.col("size_bytes").cast("long").alias("size_bytes"),
        ).alias("file"),
    )
    gathered = fits.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    manifests = gathered.select(
        *keys,
        F.size("_entries").cast("long").alias("n_files"),
        canonical.manifest_text(
            bundle_id=F.col("bundle_id"),
            files=F.transform("_entries", lambda e: e["file"]),
            sender_id=F.col("sender_id"),
            sent_at=sent_at,
            source_root=source_root,
            schema_version=F.lit(MANIFEST_VERSION).cast("long"),
        ).alias("manifest"),
    )
    manifests = manifests.withColumn("status", F.lit("ok"))
    if too_large is None:
        return manifests
    refused = too_large.select(
        *keys,
        F.col("n_rows").alias("n_files"),
        F.lit(None).cast("string").alias("manifest"),
        F.lit("too_many_files").alias("status"),
    )
    return manifests.unionByName(refused)


def sign(manifests: DataFrame, senders: DataFrame) -> DataFrame:
    """Add the keyed signature; `senders` has sender_id, ipad and opad."""
    return manifests.join(senders.select("sender_id", "ipad", "opad"), "sender_id", "left").withColumn(
        "signature", digests.signature(F.col("manifest"), F.col("ipad"), F.col("opad"))
    ).drop("ipad", "opad")


def parsed(manifest_text: Column) -> Column:
    return F.from_json(manifest_text, MANIFEST, {"mode": "PERMISSIVE"})


def _complete(m: Column) -> Column:
    """Every required field is there, on the manifest and on each file entry."""
    top = F.lit(True)
    for field in MANIFEST.fieldNames():
        top = top & m[field].isNotNull()
    entries = F.forall(
        m["files"],
        lambda f: f.isNotNull()
        & f["mtime"].isNotNull()
        & f["relative_path"].isNotNull()
        & f["sha256"].isNotNull()
        & f["size_bytes"].isNotNull(),
    )
    return F.coalesce(top & entries, F.lit(False))


def read_manifests(arrivals: DataFrame, column: str = "manifest") -> DataFrame:
    """Parse manifests; add `m` and `manifest_reason`.

    Text that is no manifest is reported as path_unsafe, an unknown version as
    schema_unsupported; null means readable.  Unknown keys are ignored.
    """
    body = F.col(column).cast("string")
    return arrivals.withColumn("m", parsed(body)).withColumn(
        "manifest_reason",
        F.when(F.col("m").isNull() | ~_complete(F.col("m")), "path_unsafe").when(
            F.col("m.schema_version") != MANIFEST_VERSION, "schema_unsupported"
        ),
    )


def manifest_entries(read: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per declared file, numbered in manifest order."""
    return (
        read.filter("manifest_reason IS NULL")
        .select(*keys, F.posexplode("m.files").alias("idx", "f"))
        .select(
            *keys,
            F.col("idx").cast("long").alias("idx"),
            "f.relative_path",
            "f.sha256",
            "f.size_bytes",
            "f.mtime",
        )
    )
