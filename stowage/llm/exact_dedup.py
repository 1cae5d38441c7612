"""Exact dedup: counting quotient filters route repeated fingerprints to byte verification.

1. Every task folds the 64-bit fingerprints of its rows into counting quotient
   filters, one for each block of the fingerprint space (`build_filters`).
2. The filters of a block are merged by their sorted remainders, without loss
   (`merge_filters`).  A text that a third of all rows hold is one entry a task.
3. Only rows whose fingerprint counts more than one are routed on, with their
   text; their bytes are compared by grouping on the text itself.

Every row's own answer is found by a join of narrow rows, so no text moves that
is not suspect, beyond the few that share a routing bucket with a suspect one.

Defined cases: a null text counts as empty, and all empty texts are equal.  A
null id is never chosen to stay unless the group has no other.  Rows that repeat
both id and text get the same answer; `kept_rows` keeps one of them, the first in
order of all columns, which may have any name and type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm import quotient_filter as qf
from stowage.llm.common import free_name, in_order, own_columns, prepared, signed, text_of, through_table

#: A block of the fingerprint space holds about so many rows when all are distinct ...
ROWS_A_BLOCK = 1 << 20
#: ... and there are this many blocks at least, so that merging is spread.
LEAST_BLOCK_BITS = 8
#: A task folds its fingerprints whenever it holds so many.
FOLD_ROWS = 1 << 20
#: Buckets of the broadcast routing table: its size has this bound whatever the data.
ROUTES = 1 << 18


def block_bits(n_rows: int) -> int:
    return max(LEAST_BLOCK_BITS, (max(1, n_rows) // ROWS_A_BLOCK).bit_length())


def build_filters(fingerprints: DataFrame, bits: int) -> DataFrame:
    """(block, filter) from a frame with one long column: one filter a task and block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            held.append(np.unique(values, return_counts=True))
            size += len(values)
            if size >= FOLD_ROWS:
                held, size = [qf.merged(held)], 0
        values, counts = qf.merged(held)
        if not len(values):
            return
        blocks = (values >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
        rows = []
        for start, stop in zip(edges, [*edges[1:], len(values)], strict=True):
            rows.append((int(blocks[start]), qf.encode(values[start:stop], counts[start:stop], bits)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
            names=["block", "filter"],
        )

    return fingerprints.mapInArrow(build, "block long, filter binary")


def merge_filters(filters: DataFrame, bits: int) -> DataFrame:
    """One filter a block.  A block gets at most one filter from each task."""

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        values, counts = qf.merged([qf.decode(f, int(key[0]), bits) for f in group["filter"]])
        return pd.DataFrame({"block": [int(key[0])], "filter": [qf.encode(values, counts, bits)]})

    return filters.groupBy("block").applyInPandas(merge, "block long, filter binary")


def repeated(filters: DataFrame, bits: int) -> DataFrame:
    """(fp, n) of all fingerprints that merged filters count more than once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values, counts = qf.decode(data, block, bits)
                often = counts > 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(values[often])), pa.array(counts[often])], names=["fp", "n"]
                )

    return filters.select("block", "filter").mapInArrow(read, "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.
    """
    prepared(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(F.col(f"`{text_col}`")).alias("body"))
    base = base.withColumn("fp", F.xxhash64("body"))
    bits = block_bits(docs.count())
    filters = merge_filters(build_filters(base.select("fp"), bits), bits)
    often = through_table(repeated(filters, bits), "repeated-fingerprints")

    route = F.pmod("fp", F.lit(ROUTES)).cast("int")
    routes = often.select(route.alias("route")).distinct()  # ROUTES rows at most
    suspects = (
        base.withColumn("route", route)
        .join(F.broadcast(routes), "route", "left_semi")
        .join(often.select("fp"), "fp", "left_semi")
    )
    classes = (
        suspects.groupBy("fp", "body")
        .agg(F.max("doc_id").alias("top_id"), F.count(F.lit(1)).alias("size"))
        .filter("size > 1")
        .select("fp", F.sha2("body", 256).alias("text_sha256"), "top_id", "size")
    )
    narrow = base.select("doc_id", "fp", F.sha2("body", 256).alias("text_sha256"))
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("top_id"))
    return narrow.join(classes, ["fp", "text_sha256"], "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def one_a_row(keyed: DataFrame, key: str, docs: DataFrame) -> DataFrame:
    """The columns of docs; of rows equal in the key the first in order of these columns."""
    rank = free_name(keyed, "rank")
    ordered = Window.partitionBy(key).orderBy(*in_order(docs))
    return keyed.withColumn(rank, F.row_number().over(ordered)).filter(F.col(rank) == 1).select(*own_columns(docs))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all columns of docs; one of each text."""
    name = free_name(docs, "key")
    found = exact_dedup(docs, id_col, text_col).filter("kept")
    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.sha2(text_of(F.col(f"`{text_col}`")), 256).alias("sha"))
    found = found.select(F.struct(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).alias(name)).distinct()
    return one_a_row(docs.withColumn(name, key).join(found, name), name, docs)
