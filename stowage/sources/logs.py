"""Audit logs and scraped metrics as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions import paths
from stowage.plans.sliced import SlicedOrder

# ---- fixed values -----------------------------------------------------------
CONNECTIONS_METRIC = "cloudflared_tunnel_ha_connections"
# ---- end of fixed values ----------------------------------------------------


def read_audit_lines(spark: SparkSession, path: str, active_name: str = "audit.log") -> DataFrame:
    """Lines of audit logs in physical order, read in parallel by file block.

    One chain per directory above the logs (an `audit` folder of sealed files
    belongs to the directory that holds it).  A block is read front to back by one
    task, so (block, line_id) orders the lines of a file, and the block is a
    natural slice of bounded size.  Lines end at LF, CR or CRLF; blank ones are
    dropped.
    """
    raw = (
        spark.read.option("recursiveFileLookup", "true")
        .text(path)
        .select(
            F.col("value").alias("line"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line_id"),
        )
    )
    local = F.regexp_replace("file_path", r"^[a-z0-9]+:/+", "/")
    folder = paths.parent(local)
    name = paths.base_name(local)
    return raw.filter("line <> ''").select(
        F.regexp_replace(folder, "/audit$", "").alias("chain_id"),
        name.alias("file_id"),
        (name == active_name).alias("active"),
        "block",
        "line_id",
        "line",
    )


def block_order() -> SlicedOrder:
    """Line order of `read_audit_lines`: file, block, line."""
    return SlicedOrder(
        ("chain_id",),
        {"_active": F.col("active"), "_file": F.col("file_id"), "_block": F.col("block")},
        ("line_id",),
    )


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Replace block and line_id by seq, the line's place in its file."""
    in_file = SlicedOrder(
        ("chain_id", "file_id"), {"_block": F.col("block")}, ("line_id",)
    )
    return in_file.running(lines, {"seq": F.lit(1).cast("long")}, inclusive=False).drop("block", "line_id")


def connections(body: Column) -> Column:
    """Connection count in a metrics page: first matching line, last word, 0 when unclear."""
    lines = F.filter(
        F.split(body, "\r\n|\n|\r"), lambda line: line.startswith(CONNECTIONS_METRIC)
    )
    first = F.rtrim(F.get(lines, F.lit(0)))
    word = F.substring_index(F.regexp_replace(first, r"\s+", " "), " ", -1)
    number = word.try_cast("double")
    return F.coalesce(
        F.when(F.abs(number) < 9e18, number.try_cast("bigint")), F.lit(0).cast("bigint")
    )
