"""From raw documents to token ids: five stages, each written and read again.

toxicity      documents that score as toxic go
exact dedup   one document of each text stays, that with the largest id
near dedup    one document of each SimHash component stays, that with the smallest id
mixing        documents are repeated or left out as the mix of sources takes them
pieces        texts become SentencePiece ids, whose decoded text is summed up
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stowage.llm import exact_dedup, mixing, pieces, simhash, toxicity
from stowage.llm.common import prepared, through_table
from stowage.llm.queries import PIECE_MODEL, toxic_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half stay.  Labels train the model, on the documents given.

    Null texts count as empty and are scored like others; every row is judged by itself,
    so repeated rows stay or go together.  All columns come along.
    """
    prepared(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.kept_rows(docs, toxic_model(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays, null texts being empty ones.

    A null id stays only where its text has no other; of rows that repeat id and text
    the first in order of all columns.  An empty table stays empty.
    """
    prepared(spark)
    return exact_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest id stays, nulls last.

    Texts without words are near copies of each other.  Rows that share an id but not
    their text are documents of their own; ties go by the text's hash, then by all columns.
    """
    prepared(spark)
    return simhash.kept_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, three times at most; texts without words never.

    A null source is a source of its own, last in order.  Rows that share id, source and
    size are taken as evenly as whole numbers allow.
    """
    prepared(spark)
    return mixing.mixed_rows(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a row: doc_id, n_tokens, span_bytes, digests of ids and decoded text, ids."""
    prepared(spark)
    return pieces.round_trip(docs, PIECE_MODEL, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", to_pieces),
]

#: Trained weights, balanced rates and pieces are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of each but the last is a written table."""
    prepared(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = through_table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
