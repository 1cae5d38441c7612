"""Table schemas, limits and closed vocabularies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------
REASONS = (
    "ext_not_allowed",
    "path_unsafe",
    "not_text",
    "file_too_large",
    "bundle_too_large",
    "too_many_files",
    "hash_mismatch",
    "schema_unsupported",
)
PREFLIGHT_STATUSES = ("ok", "ext_not_allowed", "not_text", "file_too_large")
DEFAULT_EXTENSIONS = (".log",)
TEXT_PROBE_BYTES = 8192
MAX_FILE_BYTES = 1024 * 1024
MAX_BUNDLE_BYTES = 500 * 1024 * 1024
MAX_FILES_PER_BUNDLE = 1000
MANIFEST_VERSION = 1
SIGNATURE_PREFIX = "sha256="
GENESIS_HASH = "0" * 64
# ---- end of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class Limits:
    """Caps a bundle and its files must respect; every cap is inclusive."""

    max_file_bytes: int = MAX_FILE_BYTES
    max_bundle_bytes: int = MAX_BUNDLE_BYTES
    max_files: int = MAX_FILES_PER_BUNDLE
    extensions: tuple[str, ...] = DEFAULT_EXTENSIONS
    probe_bytes: int = TEXT_PROBE_BYTES

    def __post_init__(self) -> None:
        if min(self.max_file_bytes, self.max_bundle_bytes, self.max_files, self.probe_bytes) <= 0:
            raise ValueError("limits must be positive")


# Field order is the canonical (sorted) key order, so to_json yields canonical text.
MANIFEST_FILE = T.StructType(
    [
        T.StructField("mtime", T.StringType()),
        T.StructField("relative_path", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
    ]
)
MANIFEST = T.StructType(
    [
        T.StructField("bundle_id", T.StringType()),
        T.StructField("files", T.ArrayType(MANIFEST_FILE)),
        T.StructField("schema_version", T.LongType()),
        T.StructField("sender_id", T.StringType()),
        T.StructField("sent_at", T.StringType()),
        T.StructField("source_root", T.StringType()),
    ]
)
RECEIPT_FILE = T.StructType(
    [
        T.StructField("relative_path", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
    ]
)
RECEIPT = T.StructType(
    [
        T.StructField("bundle_id", T.StringType()),
        T.StructField("received_at", T.StringType()),
        T.StructField("per_file_sha256_verified", T.ArrayType(RECEIPT_FILE)),
        T.StructField("audit_log_offset", T.LongType()),
        T.StructField("status", T.StringType()),
    ]
)
# One landed upload: what the sender claimed in its headers, and the two parts.
ARRIVAL = T.StructType(
    [
        T.StructField("attempt_id", T.LongType()),
        T.StructField("sender_id", T.StringType()),
        T.StructField("bundle_id", T.StringType()),
        T.StructField("token", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("remote_addr", T.StringType()),
        T.StructField("manifest", T.BinaryType()),
        T.StructField("archive", T.BinaryType()),
    ]
)
MEMBER = T.StructType(
    [
        T.StructField("sender_id", T.StringType()),
        T.StructField("bundle_id", T.StringType()),
        T.StructField("member_idx", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("member_type", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
# Audit fields in the order they are written to a line.
AUDIT_FIELDS = (
    "ts",
    "event",
    "sender_id",
    "bundle_id",
    "remote_addr",
    "byte_count",
    "file_count",
    "reject_reason",
    "receipt_sha256",
    "prev_hash",
)
SEAL_FIELDS = ("ts", "event", "prev_hash", "seal_hash")
AUDIT_LINE = T.StructType(
    [
        T.StructField(
            name,
            T.LongType() if name in ("byte_count", "file_count") else T.StringType(),
        )
        for name in (*AUDIT_FIELDS, "seal_hash")
    ]
)
