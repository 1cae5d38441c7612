"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are the character 1-, 2- and 3-grams of the lower-cased text, hashed
into WIDTH buckets.  Training counts buckets by language over all labelled
documents, added up by Spark.  The log probabilities are one matrix of languages
by buckets, sent to every task; its size is languages * WIDTH * 4 bytes, and
`fit` refuses more than MOST_LANGUAGES.  A task scores texts in blocks with numpy:
the rows of the sparse document-by-bucket matrix are summed against the matrix
without being spelled out.

Defined cases: a null text, or one without any letter, is `und` with score 0.
Null languages take no part in training.  With no training text all is `und`.
Of equally likely languages the first by name wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import blocks, prepared

WIDTH = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
MOST_LANGUAGES = 500
UNKNOWN = "und"

_FACTORS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, one text after the other, and how many each has."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    length = np.array([len(t) for t in lowered], np.int64)
    text = np.repeat(np.arange(len(texts)), length)
    found, owner = [], []
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        mixed = np.full(m, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            mixed = (mixed ^ points[k : k + m]) * np.uint32(_FACTORS[k])
            mixed ^= mixed >> np.uint32(15)
        inside = text[:m] == text[n - 1 :]
        found.append((mixed[inside] & np.uint32(WIDTH - 1)).astype(np.int32))
        owner.append(text[:m][inside])
    if not found:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    buckets, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return buckets[order], np.bincount(owner, minlength=len(texts))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    prior: np.ndarray
    #: Log probability of each bucket, one row a language.
    matrix: np.ndarray

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The place of the likeliest language of each text, and its probability."""
        buckets, counts = ngrams(texts)
        start = np.concatenate([[0], np.cumsum(counts)])
        logits = np.empty((len(texts), len(self.languages)))
        for k, row in enumerate(self.matrix):
            total = np.concatenate([[0.0], np.cumsum(row[buckets], dtype=np.float64)])
            logits[:, k] = self.prior[k] + total[start[1:]] - total[start[:-1]]
        best = logits.argmax(axis=1)
        chance = 1.0 / np.exp(logits - logits.max(axis=1, keepdims=True)).sum(axis=1)
        return best, chance


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count the n-grams of every row with a language."""
    prepared(docs.sparkSession)
    known = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("body")).filter(
        "lang IS NOT NULL AND body IS NOT NULL"
    )
    prior = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(prior) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the model would be too large to send to every task")
    languages = sorted(prior)
    place = {lang: k for k, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), WIDTH), np.int64)
        for batch, texts in blocks(batches, "body"):
            buckets, counts = ngrams(texts)
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            total += np.bincount(np.repeat(lang, counts) * WIDTH + buckets, minlength=total.size).reshape(total.shape)
        for k, row in enumerate(total):
            at = np.flatnonzero(row)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(row[at])],
                    names=["lang", "bucket", "n"],
                )

    counted = known.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most languages * WIDTH rows, the matrix itself.
    rows = counted.toArrow()
    matrix = np.full((len(languages), WIDTH), SMOOTHING)
    matrix[rows["lang"].to_numpy(), rows["bucket"].to_numpy()] += rows["n"].to_numpy()
    matrix = np.log(matrix / matrix.sum(axis=1, keepdims=True)) if languages else matrix
    shares = np.array([prior[x] for x in languages], float)
    return Model(languages, np.log(shares / shares.sum()) if languages else shares, matrix.astype(np.float32))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    spark = prepared(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    text = F.col(f"`{text_col}`")
    narrow = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        text.alias("body"),
        F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False)).alias("lettered"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        names = np.array([*own.languages, UNKNOWN], dtype=object)
        for batch, texts in blocks(batches, "body"):
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            if own.languages:
                best, chance = own.predict([t or "" for t in texts])
            else:
                best, chance, lettered = np.zeros(len(texts), int), np.zeros(len(texts)), lettered & False
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(names[np.where(lettered, best, len(own.languages))], pa.string()),
                    pa.array(np.where(lettered, chance, 0.0)),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
