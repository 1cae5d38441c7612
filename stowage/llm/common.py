"""What the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.session import shared_folder, through_table, tune

#: Rows of an Arrow batch.  Texts are long, so batches hold few of them.
BATCH_ROWS = 1000

#: Texts of a batch are worked off in blocks of about so many characters.
BLOCK_CHARS = 500_000

__all__ = [
    "BATCH_ROWS",
    "blocks",
    "free_name",
    "fresh_folder",
    "in_order",
    "own_columns",
    "prepared",
    "text_of",
    "through_table",
    "words_of",
]


def prepared(spark: SparkSession) -> SparkSession:
    """Settings for frames of whole texts."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def fresh_folder(spark: SparkSession, label: str) -> str:
    """Name of a new folder that the driver and all executors share."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def text_of(column: str | Column) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """How many maximal runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def blocks(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches cut so that the texts of one add up to about BLOCK_CHARS."""
    for batch in batches:
        texts = batch.column(text).to_pylist()
        start, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t or "")
            if held >= BLOCK_CHARS:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, held = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def free_name(df: DataFrame, stem: str) -> str:
    """A name that no column of the frame has, whatever the letters' case."""
    taken = {c.lower() for c in df.columns}
    while f"__{stem}" in taken:
        stem += "_"
    return f"__{stem}"


def own_columns(df: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def _sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_sortable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _sortable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def in_order(df: DataFrame) -> list[Column]:
    """All columns to sort by; maps and the like by their JSON text."""
    return [
        column if _sortable(field.dataType) else F.to_json(F.struct(column.alias("value")))
        for column, field in zip(own_columns(df), df.schema.fields, strict=True)
    ]


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the longs that Spark holds."""
    return values.astype(np.uint64, copy=False).view(np.int64)


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))
