"""The registered queries of this package, beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import (
    blob_ledger,
    exact_dedup,
    fill_middle,
    forest,
    language,
    mixing,
    outliers,
    pieces,
    records,
    resample,
    simhash,
    toxicity,
    warc,
)
from stowage.llm.common import fresh_folder, prepared

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Model files; a job may set its own.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LANGUAGE_FOLDS, TOXIC_FOLDS = 4, 5


def register(name: str, sql: str | None = None):
    def keep(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(prepared(spark), sf_dir.rstrip("/"))

        run.__name__, run.__doc__ = name, query.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(folds: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


@register(
    "op1_exact_dedup",
    """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf, "documents"))


@register("op2_secrets")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """A first scan, into a new ledger: every blob is unseen."""
    found = blob_ledger.scan(table(spark, sf, "documents"), fresh_folder(spark, "secret-ledger"))
    spans = blob_ledger.listed(found)
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"), "blob"
    )


@register("op3_mixing")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@register(
    "op4_warc",
    """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
FROM q""",
)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archive(table(spark, sf, "pages"))


@register("op5_neighbours")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return forest.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


@register("op6_language")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Learned from three folds of four, predicted for all documents."""
    docs = table(spark, sf, "documents")
    model = language.fit(docs.filter(fold(LANGUAGE_FOLDS) != 2))
    return language.predict(docs, model).select(
        "doc_id", (fold(LANGUAGE_FOLDS) == 2).alias("held_out"), "lang_pred", "score"
    )


@register("op7_records")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return records.records(table(spark, sf, "documents"), WORD_TOKENIZER)


@register("op8_pieces")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf, "documents"), PIECE_MODEL)


def toxic_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Trained on labels of all folds but the held-out one."""
    return toxicity.train(docs, labels.filter(fold(TOXIC_FOLDS) != 0))


@register("op9_toxicity")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scored = toxicity.score(docs, toxic_model(docs, table(spark, sf, "labels")))
    return scored.select(
        "doc_id",
        (fold(TOXIC_FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@register("op10_simhash")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", "fingerprint", "component_id", "fingerprint_size")


@register("op11_outliers")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.judged(table(spark, sf, "documents"))


@register(
    "op12_fill_middle",
    """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
t AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tokens,
    CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT doc_id, text, tokens, CAST(len(tokens) AS BIGINT) AS n,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b FROM t),
p AS (
  SELECT *, array_to_string(tokens[1:a], '') AS pre, array_to_string(tokens[a + 1:b], '') AS mid,
    array_to_string(tokens[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p""",
)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    made = fill_middle.transform(table(spark, sf, "documents"))
    back = fill_middle.restored(F.col("form"), F.col("output"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )


@register("op13_resample")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
