"""Secret scans over an incremental ledger of blobs.

Every version of a text is a blob, addressed by the SHA-256 of its bytes.  The
ledger is a table of (blob, rule, rule_version, spans): one row for each pair of
blob and rule version that was ever scanned, found or not.  A scan

1. addresses all versions, and lists the blobs that are new to some rule version,
2. reads the text of each such blob once and applies the rules it has not seen,
3. appends what it found to the ledger, one folder a scan,
4. joins the ledger back to every path that holds the blob.

So a blob that many paths or commits share is scanned once, and a later scan with
a new rule version reads each blob for that rule alone.  A text travels once, to
meet its blob's row; all other joins are of narrow rows.

Defined cases: a null text counts as empty, an empty blob has no findings.  Rows
that repeat are versions of their own and get the same findings.  A scan that is
run again after a failure finds its pairs in no committed folder and scans them
anew; pairs that two scans added count once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.common import blocks, prepared, text_of

LEDGER = "blob string, rule string, rule_version int, spans string"


@dataclass(frozen=True)
class Rule:
    """Matches of a pattern whose group is long enough; shorter ones are dropped after matching."""

    name: str
    version: int
    pattern: str
    group: int
    least: int
    any_case: bool = False

    def spans(self, text: str) -> list[tuple[int, int]]:
        # ASCII: letters there in either case, and no others that fold to them.
        found = re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))
        least, group = self.least, self.group
        return [m.span() for m in found.finditer(text) if m.end(group) - m.start(group) >= least]


#: Fixed patterns of the base rules, in the order in which their kinds are listed.
RULES = (
    Rule(
        "assign", 1,
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=6, any_case=True,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", group=0, least=20),
    # A run of 24 or more is the same run whether shorter ones match or not.
    Rule("hex", 1, r"[0-9a-f]{24,}", group=0, least=24),
)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs that were ever scanned; one row a pair."""
    files = spark.read.schema(LEDGER).option("recursiveFileLookup", "true")
    try:
        return files.parquet(folder).dropDuplicates(["blob", "rule", "rule_version"])
    except Exception as problem:  # a ledger without a scan yet
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], LEDGER)


def scan_new(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for the (blob, rule version) pairs that the ledger does not have.

    versions: version (an id), blob, body.
    """
    spark = versions.sparkSession
    names = spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, rule_version int")
    # One version of each blob brings its text; repeated rows of that version are
    # reduced by the ledger.
    blobs = versions.groupBy("blob").agg(F.min("version").alias("version"))
    wanted = blobs.withColumn(
        "wanted", F.array(*(F.lit(f"{r.name}:{r.version}") for r in rules))
    )
    done = (
        ledger.join(F.broadcast(names), ["rule", "rule_version"], "left_semi")
        .groupBy("blob")
        .agg(F.collect_set(F.concat_ws(":", "rule", F.col("rule_version").cast("string"))).alias("done"))
    )
    unseen = (
        wanted.join(done, "blob", "left")
        .withColumn("todo", F.array_except("wanted", F.coalesce("done", F.array().cast("array<string>"))))
        .filter(F.size("todo") > 0)
        .select(F.struct("version", "blob").alias("key"), "todo")
    )
    texts = versions.select(F.struct("version", "blob").alias("key"), "body").join(unseen, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_name = {f"{r.name}:{r.version}": r for r in rules}
        for batch, bodies in blocks(batches, "body"):
            rows = []
            for blob, todo, body in zip(
                batch.column("blob").to_pylist(), batch.column("todo").to_pylist(), bodies, strict=True
            ):
                for name in todo:
                    rule = by_name[name]
                    spans = ",".join(f"{s}:{e}" for s, e in rule.spans(body))
                    rows.append((blob, rule.name, rule.version, spans))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([r[3] for r in rows], pa.string()),
                ],
                names=["blob", "rule", "rule_version", "spans"],
            )

    return texts.select(F.col("key.blob").alias("blob"), "todo", "body").mapInArrow(run, LEDGER)


def scan(
    docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Bring the ledger in `folder` up to date with docs; one row a row of docs.

    doc_id, blob, and for each rule n_<rule> and spans_<rule> ("start:end" in code
    points, end exclusive, comma-joined).
    """
    spark = prepared(docs.sparkSession)
    body = text_of(F.col(f"`{text_col}`"))
    versions = docs.select(F.col(f"`{id_col}`").alias("version"), F.sha2(body, 256).alias("blob"), body.alias("body"))
    scan_new(versions, read_ledger(spark, folder), rules).write.parquet(f"{folder}/scan-{uuid.uuid4().hex}")

    found = read_ledger(spark, folder)
    spans = [
        F.max(F.when((F.col("rule") == r.name) & (F.col("rule_version") == r.version) & (F.col("spans") != ""), F.col("spans")))
        for r in rules
    ]
    by_blob = (
        found.filter("spans <> ''")
        .groupBy("blob")
        .agg(*(s.alias(f"spans_{r.name}") for r, s in zip(rules, spans, strict=True)))
    )
    joined = versions.select("version", "blob").join(by_blob, "blob", "left")
    columns = []
    for r in rules:
        own = F.coalesce(F.col(f"spans_{r.name}"), F.lit(""))
        columns += [
            F.when(own == "", 0).otherwise(F.size(F.split(own, ","))).cast("long").alias(f"n_{r.name}"),
            own.alias(f"spans_{r.name}"),
        ]
    return joined.select(F.col("version").alias("doc_id"), "blob", *columns)


def listed(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> F.Column:
    """All spans of a row as kind:start:end, by start and then in order of the rules."""
    def entries(place: int, rule: Rule):
        own = F.col(f"spans_{rule.name}")
        return F.transform(
            F.when(own == "", F.array().cast("array<string>")).otherwise(F.split(own, ",")),
            lambda s: F.struct(
                F.split_part(s, F.lit(":"), F.lit(1)).cast("long").alias("start"),
                F.lit(place).alias("place"),
                F.concat(F.lit(rule.name + ":"), s).alias("entry"),
            ),
        )

    every = F.concat(*(entries(i, r) for i, r in enumerate(rules)))
    return F.concat_ws(",", F.transform(F.array_sort(every), lambda e: e["entry"]))
