"""Which bundles are stored already: an index of keys in hash buckets.

The index is a table in folders by the first bits of a key's hash.  A batch of uploads
looks into the buckets that its own keys fall into and into the batches that no index
holds yet, MERGE_EVERY at most.  A bucket holds about BUCKET_ROWS keys, however many
bundles are stored: when there are more, the number of buckets doubles.  So what a batch
reads follows from the batch.  In a bucket the hashes are read first, as a filter; keys
are compared for rows whose hash is met.

After every MERGE_EVERY-th batch the keys since the last merge are appended to their
buckets, with the batch that merged them.  Appending twice, as a batch that is run again
does, changes no answer, for the index is a set.  After REWRITE_EVERY merges, or when
buckets double, it is written anew as the next generation.  A state is a folder's name,
made when everything it names is written; a batch that is run again goes by the state
before it and passes over what was merged later.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.operators.validate import BUNDLE

MERGE_EVERY, REWRITE_EVERY = 32, 64
BUCKET_ROWS = 100_000
_KEYS = "sender_id string, bundle_id string"


def fingerprint() -> Column:
    return F.xxhash64(*BUNDLE)


def bucket(bits: int) -> Column:
    """The first bits of a key's hash."""
    return F.shiftrightunsigned(fingerprint(), 64 - bits).cast("int") if bits else F.lit(0)


@dataclass(frozen=True)
class State:
    """What is merged: batches up to `upto`, in generation `generation` of 2^bits buckets and so many rows."""

    upto: int = -1
    generation: int = 0
    bits: int = 0
    rows: int = 0
    merges: int = 0

    @property
    def name(self) -> str:
        return f"state={self.upto}-{self.generation}-{self.bits}-{self.rows}-{self.merges}"

    @staticmethod
    def parsed(name: str) -> State:
        return State(*map(int, name.removeprefix("state=").split("-")))


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    where, fs = _folder(spark, path)
    return [entry.getPath().getName() for entry in fs.listStatus(where)] if fs.exists(where) else []


def state_before(spark: SparkSession, index: str, batch_id: int) -> State:
    states = [State.parsed(n) for n in _names(spark, index) if n.startswith("state=")]
    return max((s for s in states if s.upto < batch_id), key=lambda s: s.upto, default=State())


def _recent(spark: SparkSession, root: str, after: int, before: int) -> DataFrame:
    """Keys of the batches between two, the borders left out."""
    numbers = sorted(int(n.removeprefix("batch_id=")) for n in _names(spark, root) if n.startswith("batch_id="))
    folders = [f"{root}/batch_id={i}" for i in numbers if after < i < before]
    return spark.read.schema(_KEYS).parquet(*folders) if folders else spark.createDataFrame([], _KEYS)


def stored_among(attempts: DataFrame, root: str, index: str, batch_id: int) -> DataFrame:
    """sender_id and bundle_id of stored bundles that the attempts may name; `root` holds receipts by batch.

    Every stored bundle that an attempt names is there, others may be.
    """
    spark = attempts.sparkSession
    state = state_before(spark, index, batch_id)
    recent = _recent(spark, root, state.upto, batch_id)
    there = set(_names(spark, f"{index}/generation={state.generation}"))
    asked = attempts.select(*BUNDLE).distinct()
    # One number a bucket that is touched: no more than attempts, no more than buckets.
    touched = sorted(r[0] for r in asked.select(bucket(state.bits).alias("b")).distinct().collect())
    folders = [f"{index}/generation={state.generation}/bucket={b}" for b in touched if f"bucket={b}" in there]
    if not folders:
        return recent
    held = spark.read.schema(_KEYS + ", fingerprint bigint, merged bigint").parquet(*folders)
    held = held.filter(F.col("merged") <= state.upto)
    wanted = asked.select(fingerprint().alias("fingerprint")).distinct()
    return recent.unionByName(held.join(wanted, "fingerprint", "left_semi").select(*BUNDLE))


def merge(spark: SparkSession, root: str, index: str, batch_id: int) -> None:
    """After every MERGE_EVERY-th batch bring the index up to it."""
    if (batch_id + 1) % MERGE_EVERY:
        return
    state = state_before(spark, index, batch_id)
    new = _recent(spark, root, state.upto, batch_id + 1).distinct()
    total = state.rows + new.count()
    bits = state.bits
    while total > BUCKET_ROWS << bits:
        bits += 1
    anew = bits != state.bits or state.merges + 1 >= REWRITE_EVERY
    rows = new.withColumn("merged", F.lit(batch_id).cast("long"))
    if anew and state.upto >= 0:
        held = spark.read.schema(_KEYS + ", merged bigint").parquet(f"{index}/generation={state.generation}")
        rows = held.select(*BUNDLE, "merged").unionByName(rows).groupBy(*BUNDLE).agg(F.min("merged").alias("merged"))
    generation = state.generation + anew
    placed = rows.select(*BUNDLE, "merged", fingerprint().alias("fingerprint"), bucket(bits).alias("bucket"))
    placed.repartition("bucket").sortWithinPartitions("bucket", "fingerprint").write.partitionBy("bucket").mode(
        "overwrite" if anew else "append"
    ).parquet(f"{index}/generation={generation}")
    done = State(batch_id, generation, bits, total, 0 if anew else state.merges + 1)
    where, fs = _folder(spark, f"{index}/{done.name}")
    fs.mkdirs(where)
    # The state before stays for a batch that is run again, and so does its generation.
    states = sorted((State.parsed(n) for n in _names(spark, index) if n.startswith("state=")), key=lambda s: s.upto)
    kept = {s.generation for s in states[-2:]}
    for old in states[:-2]:
        fs.delete(_folder(spark, f"{index}/{old.name}")[0], True)
        if old.generation not in kept:
            fs.delete(_folder(spark, f"{index}/generation={old.generation}")[0], True)
