"""Continuous intake: landed uploads in, quarantine, receipts and audit out.

Tables under the output root, each written batch by batch:

  outcomes, members, manifests, receipts, answers, audit/lines, audit/heads

`known`, the bundles of all receipts in hash buckets, of which a batch reads those its
own bundles fall into, and `stage`, which holds what the current batch passes between
its steps.
A batch reads only earlier batches and replaces its own folders, so running it
again after a failure gives the same tables and appends nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.operators import audit, intake
from stowage.operators.validate import BUNDLE
from stowage.schemas import ARRIVAL, Limits
from stowage.session import through_table
from stowage.sinks import known, tables
from stowage.sources.archives import read_members

RECEIPTS_SCHEMA = (
    "sender_id string, bundle_id string, received_at string, "
    "per_file_sha256_verified array<struct<relative_path:string,sha256:string,size_bytes:bigint>>, "
    "audit_log_offset bigint, status string"
)
HEADS_SCHEMA = "sender_id string, head_hash string, log_bytes bigint"
CHAIN = ["sender_id"]


def read_arrivals(spark: SparkSession, landing: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of uploads landed as Parquet rows."""
    return (
        spark.readStream.schema(ARRIVAL)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(landing)
    )


def batch_writer(
    root: str,
    senders: DataFrame,
    limits: Limits = Limits(),
    clock: Callable[[int], datetime] | None = None,
    audit_all: bool = False,
) -> Callable[[DataFrame, int], None]:
    """Function for foreachBatch that takes one batch through the whole intake.

    `senders` has sender_id, token_sha, ipad and opad.  Each sender has its own
    audit chain, so chains grow side by side.
    """
    now = clock or (lambda _batch: datetime.now(tz=timezone.utc))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        received_at = F.lit(now(batch_id)).cast("timestamp")
        stored = known.stored_among(batch, f"{root}/receipts", f"{root}/known", batch_id)
        # The gate is read several times below; a written table keeps it stable.
        gated = through_table(
            intake.gate(intake.described(batch), senders, stored, limits), "gate", f"{root}/stage"
        )
        opened = intake.archives_to_open(batch, gated)
        members = read_members(opened, ["attempt_id"], "gzip", limits.max_file_bytes, stop_at=limits)
        result = intake.accept_bundles(
            gated,
            members,
            received_at,
            limits,
            audit_all,
            stage=lambda df, label: through_table(df, label, f"{root}/stage"),
        )
        tables.write_batch(result.accepted, f"{root}/members", batch_id)
        tables.write_batch(result.manifests, f"{root}/manifests", batch_id)
        tables.write_batch(result.receipts, f"{root}/receipts", batch_id)
        lines, heads = _extend_audit(spark, result.audit, root, batch_id)
        receipts = spark.read.parquet(f"{root}/receipts/batch_id={batch_id}")
        offsets = audit.byte_offsets(lines, tuple(CHAIN), order="attempt_id", heads=heads)
        tables.write_batch(intake.answered(receipts, offsets), f"{root}/answers", batch_id)
        tables.write_batch(result.outcomes, f"{root}/outcomes", batch_id)
        known.merge(spark, f"{root}/receipts", f"{root}/known", batch_id)

    return write


def _extend_audit(
    spark: SparkSession, records: DataFrame, root: str, batch_id: int
) -> tuple[DataFrame, DataFrame]:
    """Store the batch's audit lines and the new heads; give lines and old heads."""
    heads = tables.newest_batch(spark, f"{root}/audit/heads", HEADS_SCHEMA, batch_id)
    lines = audit.build_chain(records, CHAIN, "attempt_id", heads, keep=["bundle_id", "event"])
    tables.append_audit(lines, f"{root}/audit", batch_id)
    written = spark.read.parquet(f"{root}/audit/lines/batch_id={batch_id}")
    # One row per sender: the full set of heads is written every time.
    tables.write_batch(
        audit.next_heads(heads, written, CHAIN, "attempt_id"), f"{root}/audit/heads", batch_id
    )
    return written, heads


def run_available(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    senders: DataFrame,
    limits: Limits = Limits(),
    clock: Callable[[int], datetime] | None = None,
    files_per_batch: int = 1000,
) -> None:
    """Process everything that has landed and return."""
    query = (
        read_arrivals(spark, landing, files_per_batch)
        .writeStream.foreachBatch(batch_writer(root, senders, limits, clock))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stored_bundles(spark: SparkSession, root: str) -> DataFrame:
    return tables.read_batches(spark, f"{root}/receipts", RECEIPTS_SCHEMA).select(*BUNDLE)
