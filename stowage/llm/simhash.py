"""SimHash near-dedup by multi-index hashing.

A fingerprint has 64 bits, cut into SEGMENTS.  Of two fingerprints that differ in
DISTANCE bits or fewer, one segment differs in RADIUS bits or fewer.  Every segment has
a table from its values to the fingerprints that hold them; each fingerprint looks up
the Hamming ball of that radius around its own value in every table, and what it meets
is verified on the complete distance.

A segment value that more than MOST_A_VALUE different fingerprints share is not looked
up: everything there would meet everything.  Fingerprints whose ball holds such a value
name the whole fingerprints within DISTANCE that have it, and those that exist are
found by equality, a key of which holds one fingerprint.  So no bucket grows with the
data, however many documents share text, and no link is lost.

Defined cases: a null text counts as empty; a text without words has fingerprint
zero, which links like any other.  A null id is never a component's id unless
its component has no other.  Rows are told apart by id and text: rows that share
an id, null included, but not their text are documents of their own.  `kept_rows`
keeps one row of every component: that of the smallest id, of several the one with
the least hash of its text, and of rows that repeat both the first in order of all
columns.  Columns of any name and type come along.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm import components
from stowage.llm.common import blocks, free_name, prepared, signed, text_of, through_table
from stowage.llm.exact_dedup import one_a_row

BITS = 64
SEGMENTS = 2
#: Fingerprints link at this many differing bits or fewer.
DISTANCE = 2
#: A segment value is looked up if so many different fingerprints share it at most.
MOST_A_VALUE = 200
SHINGLE_WORDS = 3
SEED = 42


def fingerprint(text: str, n_words: int = SHINGLE_WORDS) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n_words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-n_words] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.array(
            [digest(joined[s:e], SEED) for s, e in zip(starts, ends[n_words - 1 :].tolist(), strict=True)], np.uint64
        )
    set_bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * set_bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def _text_hash(text_col: str):
    return F.sha2(text_of(F.col(f"`{text_col}`")), 256)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long.  hashed: with the text's SHA-256, `sha`."""
    prepared(docs.sparkSession)
    narrow = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        *([_text_hash(text_col).alias("sha")] if hashed else []),
        text_of(F.col(f"`{text_col}`")).alias("body"),
    )
    kept = narrow.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "body"):
            found = np.array([fingerprint(t) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(signed(found))], names=[*kept, "fp"]
            )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, {'sha string, ' * hashed}fp long")


def _masks(bits: Sequence[int], most: int) -> list[int]:
    """All choices of at most so many of the bits, as signed longs."""
    chosen = (sum(1 << b for b in some) for weight in range(most + 1) for some in combinations(bits, weight))
    return [mask - (1 << BITS if mask >> (BITS - 1) else 0) for mask in chosen]


def _exploded(df: DataFrame, masks: list[int], key: str) -> DataFrame:
    """Every row once a mask, `key` changed by it and the number of changed bits beside."""
    least = -(1 << BITS - 1)  # has no literal of its own
    constant = ",".join("bigint('%d')" % m if m == least else f"{m}L" for m in masks)
    return df.select("*", F.explode(F.expr(f"array({constant})")).alias("mask")).select(
        *df.columns, F.col(key).bitwiseXOR(F.col("mask")).alias("changed"), F.bit_count("mask").alias("weight")
    )


def links(distinct: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(u, v): all pairs of different fingerprints `fp` within so many bits, u below v."""
    width, radius = BITS // segments, distance // segments
    found = None
    for segment in range(segments):
        own = range(segment * width, (segment + 1) * width)
        others = [b for b in range(BITS) if b not in own]
        inside = ((1 << width) - 1) << own.start
        inside -= 1 << BITS if inside >> (BITS - 1) else 0
        rows = distinct.select("fp", F.col("fp").bitwiseAND(F.lit(inside).cast("long")).alias("value"))
        full = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_A_VALUE)
        full = through_table(full.select("value"), "full-values")
        asked = _exploded(rows.select(F.col("fp").alias("u"), "value"), _masks(own, radius), "value")
        asked = asked.select("u", "weight", F.col("changed").alias("value"))
        table = rows.join(full, "value", "left_anti").select("value", F.col("fp").alias("v"))
        # Spark sizes an exploded frame by its input, many times too low, and would broadcast it: these joins are merges.
        met = asked.hint("merge").join(table, "value").select("u", "v")
        near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
        pairs = met.filter((F.col("u") < F.col("v")) & near)
        # Whole fingerprints at the full values of a ball: the value, and the rest of `u` with changes that are left.
        rest = asked.join(full, "value", "left_semi").select(
            "u", F.col("weight").alias("used"), F.col("u").bitwiseAND(F.lit(~inside)).bitwiseOR(F.col("value")).alias("at")
        )
        named = _exploded(rest, _masks(others, distance), "at").filter(F.col("used") + F.col("weight") <= distance)
        named = named.filter(F.col("u") < F.col("changed")).select("u", F.col("changed").alias("v"))
        exact = named.hint("merge").join(distinct.select(F.col("fp").alias("v")), "v", "left_semi").select("u", "v")
        found = pairs.unionByName(exact) if found is None else found.unionByName(pairs).unionByName(exact)
    return found.distinct()


def _rooted(docs_fp: DataFrame) -> DataFrame:
    """(fp, least_id, n, root) of each distinct fingerprint; root names its component."""
    distinct = through_table(
        docs_fp.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "distinct"
    )
    found = components.roots(links(distinct), "fingerprint-links")
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least_id", "n", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: doc_id, fingerprint, component_id, fingerprint_size.

    component_id is the smallest id of the documents reachable over links,
    fingerprint_size the number of rows with this very fingerprint.
    """
    docs_fp = through_table(fingerprints(docs, id_col, text_col), "fingerprints")
    rooted = _rooted(docs_fp)
    named = rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root")
    # A table of repeated fingerprints is a small file of many rows, which Spark would broadcast by the file's size.
    return docs_fp.hint("merge").join(named.select("fp", "n", "component_id"), "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("n").alias("fingerprint_size"),
    )


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns of docs: that of the smallest id, nulls last."""
    docs_fp = through_table(fingerprints(docs, id_col, text_col, hashed=True), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), "sha")
    # A fingerprint has one component, so its first row is found before the join.
    firsts = docs_fp.groupBy("fp").agg(F.min(order).alias("first"))
    firsts = firsts.join(_rooted(docs_fp).select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first"))
    key = free_name(docs, "key")
    found = firsts.select(F.struct("first.id", "first.sha").alias(key))
    keyed = docs.withColumn(key, F.struct(F.col(f"`{id_col}`").alias("id"), _text_hash(text_col).alias("sha")))
    return one_a_row(keyed.join(found, key), key, docs)
