"""Quality rules: plain limits, then robust multivariate outliers.

Every text is counted once (words, their code points, symbols, repeated lines, words
in repeated five-word windows).  Texts within the plain limits become vectors of five
transformed statistics, and each language and source gets a minimum-covariance-
determinant estimate of centre and scatter from the vectors of all its documents: the
mean and covariance of those H_SHARE of them whose covariance has the least
determinant.  A document is rejected if its squared Mahalanobis distance to the
estimate of its own group exceeds the chi-squared quantile that a clean one exceeds
with a probability of TAIL.

The estimate is found by concentration steps from three deterministic starts: medians
and median deviations alone, the same with the correlation of hyperbolic tangents, and
with that of spatial signs.  A step is one aggregation.  Documents are counted by group
and by the logarithm of their distance, with the sums and products of their vectors;
the bins that hold the nearest H_SHARE (the last of them by a fraction) give the next
mean and covariance.  So nothing is sorted, no group meets in one task, and what a
task hands on is a bounded number of bins a group.  After WARM_STEPS steps only the
start with the least determinant goes on, until no logarithm of a determinant falls by
more than SETTLED.

Statistics are whole thousandths and their sums are exact, so reruns agree.

FLOORS are added to the covariance as the scatter of the measurement itself: most
groups have no symbol and no repeated line in most of their documents, and without
them any other document would be infinitely far away.  The floor of the length is
wide, since a text is not poor for being long; its length tells beside the others.

Groups below LEAST_ROWS documents share one pooled estimate; if they have fewer than
that together, none of them is an outlier.

Defined cases: a null text counts as empty and fails the plain limits.  A null
language or source is one of its own.  Repeated rows count as often as they are there
and get equal verdicts; null ids are kept as they are.  An empty table has an empty
result.  A text is counted whole, whatever its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import blocks, prepared, text_of, through_table

#: Plain limits: words at least, and percent of words in repeated windows at most.
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW_WORDS = 5
SYMBOLS = b"#*$%&|<>"
#: Share of a group's documents that the estimate rests on.
H_SHARE = 0.75
#: A clean document is rejected with this probability, if statistics are normal.
TAIL = 1e-6
#: Groups of fewer documents are pooled.
LEAST_ROWS = 100
#: Words and letters that are added to every text, so that rates of short texts scatter no more than those of long ones.
ADDED_WORDS, ADDED_LETTERS = 50, 250
#: Least standard deviation of each transformed statistic.
FLOORS = (1.5, 0.05, 0.3, 0.3, 0.5)
NAMES = ("length", "letters", "symbols", "lines", "repeats")
UNIT = 1000
#: Bins of a distance: so many a doubling, between its smallest and largest doubling.
BINS, LOWEST, HIGHEST = 8, -20, 60
WARM_STEPS, MOST_STEPS, SETTLED = 2, 60, 1e-3

_SPACE = b" \t\n\x0b\x0c\r"
_NOT_A_POINT = _SPACE + bytes(range(0x80, 0xC0))
_PAIRS = list(combinations_with_replacement(range(len(NAMES)), 2))
_GROUP = ["lang_key", "source_key"]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(texts: list[list[bytes]], window: int = WINDOW_WORDS) -> list[int]:
    """Of each text, how many words lie in a window of so many that the text holds twice or more."""
    sizes = np.array([len(words) for words in texts], np.int64)
    ids: dict[bytes, int] = {}
    word = np.fromiter((ids.setdefault(w, len(ids)) for words in texts for w in words), np.int64, int(sizes.sum()))
    if len(word) < window:
        return [0] * len(texts)
    own = np.repeat(np.arange(len(texts)), sizes)
    # Numbers of ever longer runs, each from the numbers of two shorter ones: equal numbers are equal runs.
    number, length = own * (len(ids) + 1) + word, 1
    while length < window:
        step = min(length, window - length)
        number = np.unique(number, return_inverse=True)[1].astype(np.int64)
        number = number[:-step] * (len(number) + 1) + number[step:]
        length += step
    inside = own[: len(number)] == own[window - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return [0] * len(texts)
    _, which, often = np.unique(number[at], return_inverse=True, return_counts=True)
    starts = at[often[which] > 1]
    edges = np.zeros(len(word) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    covered = np.cumsum(edges[:-1]) > 0
    return np.bincount(own[covered], minlength=len(texts)).tolist()


def counts_of(texts: list[bytes]) -> list[tuple[int, ...]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    words = [t.split() for t in texts]  # bytes split at ASCII white space alone
    rows = []
    for text, found, repeats in zip(texts, words, repeated_words(words), strict=True):
        lines = [line for line in text.split(b"\n") if line.strip()]
        rows.append(
            (
                len(found),
                len(text.translate(None, _NOT_A_POINT)),
                len(text) - len(text.translate(None, SYMBOLS)),
                len(lines) - len(set(lines)),
                repeats,
            )
        )
    return rows


def measured(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """One row a row of docs: doc_id, the counts, base_failed, the group's keys and the vector x0 to x4."""
    prepared(docs.sparkSession)
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit(""))
    narrow = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        key(lang_col).alias("lang_key"),
        key(source_col).alias("source_key"),
        text_of(F.col(f"`{text_col}`")).cast("binary").alias("body"),
    )
    kept = narrow.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "body"):
            columns = zip(*counts_of(texts), strict=True)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(pa.array(c, pa.int64()) for c in columns)], names=[*kept, *COUNTS]
            )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    found = narrow.mapInArrow(
        run, f"doc_id {kind}, lang_key string, source_key string, " + ", ".join(f"{c} long" for c in COUNTS)
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rate = lambda count, whole: F.log1p(100 * F.col(count) / whole)
    letters = (F.col("word_chars") + ADDED_LETTERS) / (F.col("n_words") + ADDED_WORDS)
    vector = (
        F.log1p("n_words"),
        F.log(letters),
        rate("n_symbols", F.col("word_chars") + ADDED_LETTERS),
        rate("n_dup_lines", F.col("n_words") + ADDED_WORDS),
        rate("n_repeat_words", F.col("n_words") + ADDED_WORDS),
    )
    whole = [F.round(UNIT * x).cast("long").alias(f"x{i}") for i, x in enumerate(vector)]
    return found.select("*", failed.alias("base_failed"), *whole)


def chi2_cdf(x: float, k: int) -> float:
    """Distribution function of chi-squared with k degrees of freedom."""
    if x <= 0:
        return 0.0
    a, half = k / 2, x / 2
    if half > a + 40 * math.sqrt(a) + 200:
        return 1.0
    term = math.exp(a * math.log(half) - half - math.lgamma(a + 1))
    total, n = term, 0
    while term > total * 1e-16:
        n += 1
        term *= half / (a + n)
        total += term
    return min(1.0, total)


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < p else (low, middle)
    return high


def consistency(share: float, dimensions: int) -> float:
    """What the covariance of the nearest share of normal vectors has to be multiplied with."""
    return share / chi2_cdf(chi2_quantile(share, dimensions), dimensions + 2)


def _floored(covariance: np.ndarray) -> np.ndarray:
    return covariance + np.diag((UNIT * np.array(FLOORS)) ** 2)


def estimate_of(mean: np.ndarray, covariance: np.ndarray) -> tuple[list[float], list[float], float]:
    """(centre, inverse of the floored covariance pair by pair, logarithm of its determinant)."""
    whole = _floored(covariance)
    inverse = np.linalg.inv(whole)
    # Off the diagonal a pair stands for both of its products.
    packed = [float(inverse[i, j] * (1 if i == j else 2)) for i, j in _PAIRS]
    return mean.tolist(), packed, float(np.linalg.slogdet(whole)[1])


def distance(vector: list[Column], centre: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance."""
    off = [x - F.get(centre, F.lit(i)) for i, x in enumerate(vector)]
    total = F.lit(0.0)
    for n, (i, j) in enumerate(_PAIRS):
        total = total + F.get(inverse, F.lit(n)) * off[i] * off[j]
    return F.greatest(total, F.lit(0.0))


def _vector(prefix: str = "x") -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(len(NAMES))]


def _sums(vector: list[Column]) -> list[Column]:
    return [F.sum(v).alias(f"s{i}") for i, v in enumerate(vector)] + [
        F.sum(vector[i] * vector[j]).alias(f"p{i}{j}") for i, j in _PAIRS
    ]


_SUM_NAMES = [f"s{i}" for i in range(len(NAMES))] + [f"p{i}{j}" for i, j in _PAIRS]
_STATE = "lang_key string, source_key string, start int, centre array<double>, inverse array<double>, logdet double"


def _moments(sums: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
    d = len(NAMES)
    mean = sums[:d] / n
    covariance = np.zeros((d, d))
    for value, (i, j) in zip(sums[d:], _PAIRS, strict=True):
        covariance[i, j] = covariance[j, i] = value / n - mean[i] * mean[j]
    return mean, covariance


def _state_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["lang_key", "source_key", "start", "centre", "inverse", "logdet"])


def starts(vectors: DataFrame) -> DataFrame:
    """The three first estimates of every group: lang_key, source_key, start, centre, inverse, logdet."""
    d = len(NAMES)
    # Values are whole thousandths of logarithms, so an exact percentile keeps few distinct ones.
    middles = vectors.groupBy(*_GROUP).agg(*(F.percentile(f"x{i}", 0.5).alias(f"m{i}") for i in range(d)))
    middles = through_table(middles, "outlier-middles")
    spread = (
        vectors.join(middles, _GROUP)
        .groupBy(*_GROUP)
        .agg(
            *(F.first(f"m{i}").alias(f"m{i}") for i in range(d)),
            *(F.percentile(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5).alias(f"a{i}") for i in range(d)),
        )
    )
    spread = spread.select(
        *_GROUP,
        *(f"m{i}" for i in range(d)),
        *(F.sqrt((1.4826 * F.col(f"a{i}")) ** 2 + (UNIT * FLOORS[i]) ** 2).alias(f"a{i}") for i in range(d)),
    )
    spread = through_table(spread, "outlier-spread")
    scaled = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"a{i}") for i in range(d)]
    length = F.sqrt(sum((z * z for z in scaled), F.lit(0.0)))
    bent = [F.round(UNIT * F.tanh(z)).cast("long").alias(f"t{i}") for i, z in enumerate(scaled)]
    signs = [F.round(UNIT * F.when(length > 0, z / length).otherwise(0.0)).cast("long").alias(f"g{i}") for i, z in enumerate(scaled)]
    products = lambda prefix: [
        F.sum(F.col(f"{prefix}{i}") * F.col(f"{prefix}{j}")).alias(f"{prefix}{i}{j}") for i, j in _PAIRS
    ]
    shaped = (
        vectors.join(spread, _GROUP)
        .select(*_GROUP, *bent, *signs)
        .groupBy(*_GROUP)
        .agg(F.count(F.lit(1)).alias("n"), *products("t"), *products("g"))
    )

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                mean = np.array([getattr(row, f"m{i}") for i in range(d)])
                scale = np.array([getattr(row, f"a{i}") for i in range(d)])
                for start, prefix in enumerate(("", "t", "g")):
                    shape = np.eye(d)
                    for i, j in _PAIRS if prefix else []:
                        shape[i, j] = shape[j, i] = getattr(row, f"{prefix}{i}{j}") / row.n
                    own = np.sqrt(np.maximum(np.diag(shape), 1e-9))
                    shape = shape / own / own[:, None]
                    rows.append((row.lang_key, row.source_key, start, *estimate_of(mean, shape * scale * scale[:, None])))
            yield _state_rows(rows)

    return through_table(spread.join(shaped, _GROUP).mapInPandas(first, _STATE), "outlier-state")


def concentrate(vectors: DataFrame, state: DataFrame) -> DataFrame:
    """One step: the estimates from the nearest H_SHARE of every group under the present ones."""
    d2 = distance(_vector(), F.col("centre"), F.col("inverse"))
    octave = F.when(d2 > 0, F.log2(d2)).otherwise(F.lit(float(LOWEST)))
    bin_ = F.floor(BINS * F.greatest(F.lit(float(LOWEST)), F.least(F.lit(float(HIGHEST)), octave))).cast("int")
    binned = (
        vectors.join(state.drop("logdet"), _GROUP)
        .withColumn("bin", bin_)
        .groupBy(*_GROUP, "start", "bin")
        .agg(F.count(F.lit(1)).alias("n"), *_sums(_vector()))
    )

    def step(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin")
        n = bins["n"].to_numpy(np.float64)
        wanted = H_SHARE * n.sum()
        share = np.clip((wanted - (np.cumsum(n) - n)) / n, 0.0, 1.0)
        sums = (bins[_SUM_NAMES].to_numpy(np.float64) * share[:, None]).sum(axis=0)
        return _state_rows([(*key, *estimate_of(*_moments(sums, wanted)))])

    return through_table(binned.groupBy(*_GROUP, "start").applyInPandas(step, _STATE), "outlier-state")


def estimates(vectors: DataFrame) -> DataFrame:
    """lang_key, source_key, centre, inverse, logdet: the minimum-covariance-determinant estimate of every group."""
    state = starts(vectors)
    for _ in range(WARM_STEPS):
        state = concentrate(vectors, state)
    best = state.groupBy(*_GROUP).agg(F.min(F.struct("logdet", "start")).alias("best"))
    chosen = state.join(best, _GROUP).filter(F.col("start") == F.col("best.start")).drop("best")
    state = through_table(chosen, "outlier-state")
    for _ in range(MOST_STEPS):
        now = concentrate(vectors, state)
        before = state.select(*_GROUP, F.col("logdet").alias("before"))
        moved = now.join(before, _GROUP).filter(F.col("before") - F.col("logdet") > SETTLED)
        state = now
        if moved.isEmpty():
            break
    return state.drop("start")


def pooled(vectors: DataFrame, least_rows: int) -> DataFrame:
    """Vectors under the key of their group; groups that are too small share the key (null, null) as ('', '*')."""
    small = vectors.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") < least_rows)
    small = small.select(*_GROUP, F.lit(True).alias("small"))
    joined = vectors.join(small, _GROUP, "left")
    own = lambda key, other: F.when(F.col("small"), F.lit(other)).otherwise(F.col(key)).alias(key)
    rest = [c for c in vectors.columns if c not in _GROUP]
    return joined.select(*rest, own("lang_key", ""), own("source_key", "*"))


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_rows: int = LEAST_ROWS,
    tail: float = TAIL,
) -> DataFrame:
    """One row a row of docs: doc_id, the counts, base_failed, distance (null without one), kept.

    distance is the squared Mahalanobis distance to the estimate of the document's
    language and source, corrected for the share the estimate rests on.
    """
    rows = through_table(measured(docs, id_col, text_col, lang_col, source_col), "outlier-counts")
    passed = pooled(rows.filter("NOT base_failed"), least_rows)
    passed = through_table(passed, "outlier-vectors")
    enough = passed.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= least_rows)
    vectors = passed.join(enough.select(*_GROUP), _GROUP, "left_semi").select(*_GROUP, *_vector())
    found = estimates(through_table(vectors, "outlier-grouped"))
    d2 = distance(_vector(), F.col("centre"), F.col("inverse")) / consistency(H_SHARE, len(NAMES))
    limit = chi2_quantile(1 - tail, len(NAMES))
    columns = ["doc_id", *COUNTS, "base_failed"]
    told = passed.join(found, _GROUP, "left").select(*columns, F.when(F.col("centre").isNotNull(), d2).alias("distance"))
    failed = rows.filter("base_failed").select(*columns, F.lit(None).cast("double").alias("distance"))
    near = F.coalesce(F.col("distance") <= limit, F.lit(True))
    return told.unionByName(failed).withColumn("kept", ~F.col("base_failed") & near)
