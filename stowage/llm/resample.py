"""Target-distribution importance resampling by bit-sliced aggregation.

The features of a text are its runs of one to three words, each falling into a bucket
by its CRC-32.  A bucket gains where a target set of texts has more of it than the
corpus, and a document weighs the sum of the gains over its features.

A document's counts by bucket are kept as bit planes: plane k has a bit for every
bucket, set where bit k of the count is.  The gains are cut into planes as well, in
two's complement.  The weight is then exact and needs no list of features:

    sum over k, j of 2^k * 2^j * popcount(count plane k AND gain plane j),

where the topmost gain plane, the sign, counts negatively.  Texts are read once; the
planes, a few times 1.2 KB a document and mostly zeros above the first two, are a
written table from which the corpus's own counts are summed and documents weighed.

CRCs of runs are not computed byte by byte: the CRC of joined strings follows from
those of the parts (it is linear), by table for all words of a block at once.

The draw is a Gumbel top-k: documents with the highest weight plus seeded noise.  Rows
are range-partitioned by score, numbered within their range, and shifted by the number
of rows in the ranges before, so no task orders more than its own range.

Defined cases: a null text has no words, so no features and weight 0.  A null id is
hashed as an empty one and comes last among equal scores.  Rows that repeat id and
text are documents of their own with equal scores and consecutive ranks.  With no
document long enough, or no documents, nothing is drawn; an empty target set is one
without features.  A text's length bounds the time it takes, not the size of its row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import blocks, prepared, text_of, through_table

BUCKETS = 10_000
MOST_WORDS = 3
#: Words that a document needs to be drawn, and the percentage of such documents that is.
LEAST_WORDS, PERCENT = 20, 5
SEED = 42
#: Gains are whole thousandths.
UNIT = 1000

_PLANE = -(-BUCKETS // 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_CRC_BYTE = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
#: The register's change for one byte: CRC-32 of a byte without the inversions before and after.
_STEP = _CRC_BYTE ^ _CRC_BYTE[0]
_SPACE = np.uint32(zlib.crc32(b" "))
#: Texts whose counts are laid out side by side at once.
_DENSE = 64
#: Lengths for which a table says how a CRC moves past so many bytes.
_FAR = 64


def _shift_tables() -> np.ndarray:
    """[length, byte of the register, its value]: the register after `length` zero bytes."""
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    tables = [now]
    for _ in range(_FAR):
        now = _STEP[now & 0xFF] ^ (now >> np.uint32(8))
        tables.append(now)
    return np.stack(tables).reshape(-1)


_SHIFT = _shift_tables()


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs moved past so many further bytes: XOR with the CRC of these bytes gives that of the whole."""
    crc, left = crc.copy(), lengths.astype(np.int64)
    far = np.flatnonzero(left > _FAR)
    while len(far):
        crc[far] = _move(crc[far], np.full(len(far), _FAR, np.int64))
        left[far] -= _FAR
        far = far[left[far] > _FAR]
    return _move(crc, left)


def _move(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    at = length * 1024
    found = _SHIFT[at + (crc & 0xFF)]
    for part in (1, 2, 3):
        found ^= _SHIFT[at + (256 * part) + ((crc >> np.uint32(8 * part)) & 0xFF)]
    return found


def word_crcs(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of slices of raw bytes, all slices a byte further at a time."""
    order = np.argsort(-lengths, kind="stable")
    start, length = starts[order], lengths[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    reach = np.searchsorted(-length, -np.arange(min(int(length[0]), _FAR) if len(length) else 0), side="left")
    for k, n in enumerate(reach.tolist()):  # the first n slices are longer than k
        crc[:n] = _STEP[(crc[:n] ^ raw[start[:n] + k]) & 0xFF] ^ (crc[:n] >> np.uint32(8))
    found = np.empty_like(crc)
    found[order] = ~crc
    for i in np.flatnonzero(lengths > _FAR):
        found[i] = zlib.crc32(raw[starts[i] : starts[i] + lengths[i]])
    return found


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, bucket of each feature)."""
    raw = _LOWER[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], _IN_WORD[raw]]).astype(np.int8)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    own = np.searchsorted(firsts, starts, side="right") - 1
    one = word_crcs(raw, starts, lengths)
    texts_of, crcs, run = [own], [one], one
    for words in range(2, MOST_WORDS + 1):
        if len(one) < words:
            break
        spaced = shifted(run[:-1], np.ones(len(run) - 1, np.int64)) ^ _SPACE
        run = shifted(spaced, lengths[words - 1 :]) ^ one[words - 1 :]
        same = own[: len(run)] == own[words - 1 :]
        texts_of.append(own[: len(run)][same])
        crcs.append(run[same])
    return (
        np.bincount(own, minlength=len(texts)),
        np.concatenate(texts_of),
        (np.concatenate(crcs) % np.uint32(BUCKETS)).astype(np.int64),
    )


def planes_of(n: int, text: np.ndarray, bucket: np.ndarray) -> list[bytes]:
    """Bit planes of the counts of n texts, those of a text one after another, the lowest first."""
    order = np.argsort(text, kind="stable")
    text, bucket = text[order], bucket[order]
    planes: list[list[bytes]] = [[] for _ in range(n)]
    for base in range(0, n, _DENSE):
        some = min(_DENSE, n - base)
        a, b = np.searchsorted(text, [base, base + some])
        keys = (text[a:b] - base) * (_PLANE * 64) + bucket[a:b]
        counts = np.bincount(keys, minlength=some * _PLANE * 64).astype(np.uint32).reshape(some, -1)
        most = counts.max(axis=1)
        having, bit = np.arange(base, base + some), np.uint32(1)
        while True:
            # Texts with a count of `bit` or more have a plane of it.
            more = most >= bit
            if not more.all():
                having, counts, most = having[more], counts[more], most[more]
            if not len(having):
                break
            packed = np.packbits(counts & bit != 0, axis=1, bitorder="little")
            for i, row in zip(having.tolist(), packed, strict=True):
                planes[i].append(row.tobytes())
            bit <<= np.uint32(1)
    return [b"".join(p) for p in planes]


def feature_planes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: doc_id, n_words, n_features, planes."""
    prepared(docs.sparkSession)
    narrow = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), text_of(F.col(f"`{text_col}`")).cast("binary").alias("body")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "body"):
            words, own, bucket = features(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(words, pa.int64()),
                    pa.array(np.bincount(own, minlength=len(texts)), pa.int64()),
                    pa.array(planes_of(len(texts), own, bucket), pa.binary()),
                ],
                names=["doc_id", "n_words", "n_features", "planes"],
            )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, planes binary")


def _unpacked(planes: bytes) -> np.ndarray:
    """Planes as words of 64 buckets, a row each."""
    return np.frombuffer(planes, "<u8").reshape(-1, _PLANE)


def bucket_counts(planes: DataFrame) -> np.ndarray:
    """Features by bucket, of all texts together.  Adds up within tasks; BUCKETS sums reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for held in batch.column("planes").to_pylist():
                for k, plane in enumerate(_unpacked(held)):
                    bits = np.unpackbits(plane.view(np.uint8), count=BUCKETS, bitorder="little")
                    np.add(total, bits if k == 0 else bits.astype(np.int64) << k, out=total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    summed = planes.select("planes").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(BUCKETS, np.int64)
    for bucket, n in summed.collect():  # BUCKETS rows at most
        found[bucket] = n
    return found


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the logarithm of how much likelier a bucket is in the target."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (s.sum() + BUCKETS)) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(UNIT * np.log(ratio)).astype(np.int64)


def gain_planes(gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(planes of the gains in two's complement, what a bit of each counts)."""
    n = int(np.abs(gains).max()).bit_length() + 1
    bits = (gains[None, :] >> np.arange(n)[:, None]) & 1
    padded = np.zeros((n, _PLANE * 64), bool)
    padded[:, :BUCKETS] = bits
    worth = np.int64(1) << np.arange(n, dtype=np.int64)
    worth[-1] = -worth[-1]
    return np.packbits(padded, axis=1, bitorder="little").view("<u8"), worth


def weights_of(held: list[bytes], gain: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """The exact weight of each text from its planes."""
    sizes = np.array([len(h) // (8 * _PLANE) for h in held], np.int64)
    rows = _unpacked(b"".join(held))
    each = np.zeros(len(rows), np.int64)
    for plane, value in zip(gain, worth, strict=True):
        each += value * np.bitwise_count(rows & plane).sum(axis=1, dtype=np.int64)
    firsts = np.cumsum(sizes) - sizes
    each <<= np.arange(len(rows)) - np.repeat(firsts, sizes)
    found = np.zeros(len(held), np.int64)
    np.add.at(found, np.repeat(np.arange(len(held)), sizes), each)
    return found


def weigh(planes: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight."""
    gain, worth = gain_planes(gains)
    kept = ["doc_id", "n_words", "n_features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.slice(at, 100)
                found = weights_of(part.column("planes").to_pylist(), gain, worth)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found)], names=[*kept, "weight"])

    kind = planes.schema["doc_id"].dataType.simpleString()
    return planes.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int) -> Column:
    """Whole thousandths of a Gumbel variable that the id and the seed decide."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-UNIT * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Add score and rank: 1, 2, 3 ... in order of score for the drawn share of long enough documents, else null."""
    enough = F.col("n_words") >= least_words
    scored = weighed.withColumn("score", F.col("weight") + noise("doc_id", seed)).withColumn("enough", enough)
    order = [F.desc("enough"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    ranges = through_table(
        scored.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()), "resample-ranges"
    )
    sizes = ranges.groupBy("slice").agg(F.count_if("enough").alias("rows"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = sizes.select(
        "slice",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"),
        F.sum("rows").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"),
    )
    inside = ranges.withColumn("place", F.row_number().over(Window.partitionBy("slice").orderBy(*order)))
    rank = F.col("place") + F.col("before")
    drawn = F.col("enough") & (rank <= F.floor(F.lit(percent) * F.col("all") / 100))
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return inside.join(starts, "slice").select(*columns, F.when(drawn, rank).cast("long").alias("rank"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row a row of docs: doc_id, n_words, n_features, weight, score, rank (null if not drawn)."""
    planes = through_table(feature_planes(docs, id_col, text_col), "resample-planes")
    wanted = feature_planes(target.select(F.lit(0).alias("id"), F.col(f"`{target_text_col}`").alias("text")), "id", "text")
    gains = gains_of(bucket_counts(planes), bucket_counts(wanted))
    return draw(weigh(planes, gains), percent, least_words, seed)
