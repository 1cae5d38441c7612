"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has its own score, a logistic
model of hashed words and word beginnings, and the document's score is their
noisy-or: 1 - product of (1 - score).  Only documents carry labels; the noisy-or
passes the blame of a toxic document on to the sentences that earn it, so the
same weights then say which sentences offend (`locate`).

Training: features of at most TRAIN_DOCS labelled documents (those of smallest
hashed id, a documented bound) are written to the shared folder.  Features that
toxic documents hold clearly more often than others are learned, from their log
odds as a start; all others weigh nothing, so chance words do not count.  Each
step sends the weights out, every task adds up the gradient of its rows, and the
driver adds one short vector a task and moves the weights (Adam).  Scoring covers
every sentence of every whole text.

Defined cases: a null text counts as empty; a text without words has the bias
alone as its one sentence.  Labels that are null, or whose document does not
exist, take no part.  A document with several labels takes part with the largest.
With no labels, or with one class only, the model scores the share of toxic
labels (0 without any) for each document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import blocks, prepared, text_of, through_table

#: Hashed features.
WIDTH = 1 << 18
#: Beginnings of a word that are features beside it.
STEMS = (4, 5)
#: At most so many labelled documents train the model ...
TRAIN_DOCS = 12_000
#: ... from so many files of features.
TRAIN_PARTS = 12
#: A feature is learned if its share of toxic documents is this many standard
#: deviations above chance, and its odds this many times those of other features.
LEAST_Z, LEAST_RATIO = 4.0, 4.0
STEPS = 30
RATE = 0.3
DECAY = 1e-3
START_BIAS = -6.0
#: Words a task remembers the features of.
MEMORY = 100_000

_SENTENCE = re.compile(r"[^.!?\n\r]+")
_WORD = re.compile(r"[^\W_]+")


def word_features(word: str) -> list[int]:
    """Hashed features of one lower-case word."""
    data = word.encode("utf-8", "surrogatepass")
    found = [zlib.crc32(b"w" + data) % WIDTH]
    found += [zlib.crc32(b"%d" % n + word[:n].encode("utf-8", "surrogatepass")) % WIDTH for n in STEMS if len(word) > n]
    return found


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, in code points."""
    return [m.span() for m in _SENTENCE.finditer(text) if _WORD.search(m.group())]


def sentence_words(text: str) -> Iterator[list[str]]:
    """The lower-case words of each sentence of a text; one empty sentence if it has none."""
    any_ = False
    for sentence in _SENTENCE.findall(text.lower()):
        words = _WORD.findall(sentence)
        if words:
            any_ = True
            yield words
    if not any_:
        yield []


@dataclass(frozen=True)
class Model:
    """Weights of hashed features and the bias; `share` alone if nothing was learned."""

    weights: np.ndarray | None
    bias: float
    share: float = 0.0


def _log1pexp(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _features(labelled: DataFrame) -> DataFrame:
    """(label, lengths, features): words of sentences as hashed features, one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, list[int]] = {}
        for batch, texts in blocks(batches, "body"):
            lengths, features = [], []
            for text in texts:
                counts, found = [], []
                for words in sentence_words(text):
                    before = len(found)
                    for word in words:
                        known = memory.get(word)
                        if known is None:
                            if len(memory) >= MEMORY:
                                memory.clear()
                            known = memory[word] = word_features(word)
                        found += known
                    counts.append(len(found) - before)
                lengths.append(np.array(counts, "<i4").tobytes())
                features.append(np.array(found, "<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(lengths, pa.binary()), pa.array(features, pa.binary())],
                names=["label", "lengths", "features"],
            )

    return labelled.select("label", "body").mapInArrow(run, "label int, lengths binary, features binary")


def bag_gradient(
    label: np.ndarray, sentences_of: np.ndarray, lengths: np.ndarray, features: np.ndarray, weights: np.ndarray, bias: float
) -> tuple[np.ndarray, float]:
    """Gradient of the noisy-or's log loss over whole documents, by weight and last by bias, and the loss.

    sentences_of: how many sentences each document has; lengths: how many
    features each sentence has.
    """
    owner = np.repeat(np.arange(len(lengths)), lengths)
    z = bias + np.bincount(owner, weights[features], minlength=len(lengths))
    doc = np.repeat(np.arange(len(label)), sentences_of)
    none = -np.bincount(doc, _log1pexp(z), minlength=len(label))  # log of the chance that no sentence offends
    some = np.maximum(-np.expm1(none), 1e-12)
    toxic = label == 1
    loss = -np.where(toxic, np.log(some), none).sum()
    blame = np.where(toxic, -np.exp(none) / some, 1.0)
    by_sentence = blame[doc] / (1.0 + np.exp(-np.clip(z, -500, 500)))
    gradient = np.bincount(features, np.repeat(by_sentence, lengths), minlength=len(weights))
    return np.append(gradient, by_sentence.sum()), float(loss)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Labels, sentences a document, features a sentence and features of up to 100 documents at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 100):
            part = batch.slice(start, 100)
            lengths = [np.frombuffer(x, "<i4") for x in part.column("lengths").to_pylist()]
            features = np.frombuffer(b"".join(part.column("features").to_pylist()), "<i4")
            label = part.column("label").to_numpy(zero_copy_only=False)
            yield label, np.array([len(x) for x in lengths]), np.concatenate(lengths), features


def _total(table: DataFrame, add, size: int) -> np.ndarray:
    """Sum of add(bag) over all bags, vectors of one size; one row a task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for bag in _bags(batches):
            total += add(bag)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([total[at].tobytes()], pa.binary())],
            names=["at", "by"],
        )

    total = np.zeros(size)
    for part in sorted(table.mapInArrow(run, "at binary, by binary").collect()):  # the same order of addition each time
        total[np.frombuffer(part["at"], "<i4")] += np.frombuffer(part["by"], "<f8")
    return total


def _presence(bag: tuple) -> np.ndarray:
    """How many documents hold each feature, then how many toxic ones do."""
    label, sentences_of, lengths, features = bag
    doc = np.repeat(np.repeat(np.arange(len(label)), sentences_of), lengths)
    pairs = np.unique(doc.astype(np.int64) * WIDTH + features)
    held, toxic = pairs % WIDTH, label[pairs // WIDTH] == 1
    return np.concatenate([np.bincount(held, minlength=WIDTH), np.bincount(held[toxic], minlength=WIDTH)])


def _only(table: DataFrame, place: np.ndarray) -> DataFrame:
    """The table with learned features alone, named by their place among them."""
    sent = table.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, features = [], []
            for by_sentence, held in zip(*(batch.column(c).to_pylist() for c in ("lengths", "features")), strict=True):
                by_sentence, held = np.frombuffer(by_sentence, "<i4"), sent.value[np.frombuffer(held, "<i4")]
                owner = np.repeat(np.arange(len(by_sentence)), by_sentence)[held >= 0]
                lengths.append(np.bincount(owner, minlength=len(by_sentence)).astype("<i4").tobytes())
                features.append(held[held >= 0].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(lengths, pa.binary()), pa.array(features, pa.binary())],
                names=["label", "lengths", "features"],
            )

    return table.mapInArrow(run, table.schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the documents that `labels` (id, label) marks."""
    spark = prepared(docs.sparkSession)
    known = (
        labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
        .filter("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)  # so it can be broadcast
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(F.col(f"`{text_col}`")).alias("body"))
    labelled = texts.join(F.broadcast(chosen), "doc_id").repartition(TRAIN_PARTS, F.xxhash64("doc_id"))
    table = through_table(_features(labelled), "toxicity-features")
    count = {r["label"]: r["n"] for r in table.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, n_toxic = sum(count.values()), count.get(1, 0)
    if len(count) < 2:
        return Model(None, 0.0, float(n_toxic > 0))

    held, toxic = np.split(_total(table, _presence, 2 * WIDTH), 2)
    share = n_toxic / n
    z = (toxic - held * share) / np.sqrt(np.maximum(held * share * (1 - share), 0.1))
    ratio = (toxic + 0.5) / (n_toxic + 1) / ((held - toxic + 0.5) / (n - n_toxic + 1))
    learned = np.flatnonzero((z >= LEAST_Z) & (ratio >= LEAST_RATIO))
    place = np.full(WIDTH, -1, np.int32)
    place[learned] = np.arange(len(learned))
    table = through_table(_only(table, place), "toxicity-learned")

    # Weights of the learned features, and last the bias.
    state = np.append(np.log(ratio[learned]), START_BIAS)
    first, second = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, STEPS + 1):
        gradient = _total(table, lambda bag, s=state: bag_gradient(*bag, s[:-1], s[-1])[0], len(state)) / n
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        rate = RATE * (1.0 if step <= STEPS * 0.6 else 0.4)
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1.0 / n)
        state = state - move
        state[:-1] *= 1 - DECAY * rate
    weights = np.zeros(WIDTH, np.float32)
    weights[learned] = state[:-1]
    return Model(weights, float(state[-1]), share)


def _scorer(model: Model):
    """A function from a text to the scores of its sentences; it remembers words."""
    memory: dict[str, float] = {}
    weights = model.weights

    def weight(word: str) -> float:
        if len(memory) >= MEMORY:
            memory.clear()
        found = memory[word] = float(weights[word_features(word)].sum())
        return found

    def score(text: str) -> np.ndarray:
        get = memory.get
        z = [
            model.bias + sum([x if (x := get(w)) is not None else weight(w) for w in words])
            for words in sentence_words(text)
        ]
        return np.array(z)

    return score


def noisy_or(z: np.ndarray) -> float:
    """The document's score from the logits of its sentences."""
    return float(-np.expm1(-_log1pexp(z).sum()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    spark = prepared(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(F.col(f"`{text_col}`")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        scorer = None if own.weights is None else _scorer(own)
        for batch, texts in blocks(batches, "body"):
            found = [own.share if scorer is None else noisy_or(scorer(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"]
            )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, score double")


def locate(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """(doc_id, start, end, sentence, score) of the sentences that score at least the threshold."""
    spark = prepared(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(F.col(f"`{text_col}`")).alias("body"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        scorer = None if own.weights is None else _scorer(own)
        for batch, texts in blocks(batches, "body"):
            rows, ends = [], []
            for i, text in enumerate(texts if scorer else []):
                for start, end in sentences(text):
                    p = noisy_or(scorer(text[start:end]))
                    if p >= threshold:
                        rows.append(i)
                        ends.append((start, end, text[start:end], p))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array([e[0] for e in ends], pa.int64()),
                    pa.array([e[1] for e in ends], pa.int64()),
                    pa.array([e[2] for e in ends], pa.string()),
                    pa.array([e[3] for e in ends], pa.float64()),
                ],
                names=["doc_id", "start", "end", "sentence", "score"],
            )

    return narrow.mapInArrow(run, f"doc_id {kind}, start long, end long, sentence string, score double")


def kept_rows(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    spark = prepared(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        scorer = None if own.weights is None else _scorer(own)
        for batch, texts in blocks(batches, text_col):
            found = [own.share if scorer is None else noisy_or(scorer(t or "")) for t in texts]
            yield batch.filter(pa.array([p < threshold for p in found]))

    return docs.mapInArrow(run, docs.schema)
