"""Running intake counters over a stream of audit records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.operators.audit import intake_metrics
from stowage.sinks import tables

RECORD_SCHEMA = (
    "sender_id string, bundle_id string, ts string, event string, reject_reason string, "
    "file_count bigint, byte_count bigint, remote_addr string, receipt_sha256 string"
)
COUNT_SCHEMA = "sender_id string, outcome string, bundles bigint"


def running_counts(records: DataFrame) -> DataFrame:
    """Bundles per sender and outcome, kept as streaming state.

    The state has one row per sender and outcome, so it needs no watermark.
    """
    return intake_metrics(records)["bundles_received"]


def running_rejects(records: DataFrame) -> DataFrame:
    """Rejected bundles per reason; the reasons are a closed set."""
    return intake_metrics(records)["rejected"]


def run_available(spark: SparkSession, landing: str, root: str, checkpoint: str) -> DataFrame:
    """Count everything that has landed; returns the newest totals."""
    records = spark.readStream.schema(RECORD_SCHEMA).parquet(landing)

    def store(totals: DataFrame, batch_id: int) -> None:
        tables.write_batch(totals, root, batch_id)

    query = (
        running_counts(records)
        .writeStream.outputMode("complete")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    written = tables.read_batches(spark, root, COUNT_SCHEMA)
    newest = written.agg(F.max("batch_id").alias("batch_id"))
    return written.join(newest, "batch_id").drop("batch_id")
