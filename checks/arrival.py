"""Queries that write and read archives, logs and tables, and the stream."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

import pandas as pd
import zstandard
from pyspark.sql import functions as F

from checks import views as V
from checks.registry import register

from stowage.operators import audit, inventory, manifest, validate
from stowage.schemas import ARRIVAL, Limits
from stowage.session import shared_folder, through_table
from stowage.sinks import tables
from stowage.sources import archives, listing, logs
from stowage.streaming import intake_stream, metrics_stream

KEYS = list(validate.BUNDLE)
PACK_LIMITS = Limits(max_files=7, max_bundle_bytes=9000)


def fresh_folder(spark, label):
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _sent(spark, sf):
    """Members as regular files; archives are packed from these."""
    return V.members(spark, sf).withColumn("member_type", F.lit("file"))


_SENT = f"WITH members0 AS ({V.SQL['members']}), members AS (SELECT * REPLACE ('file' AS member_type) FROM members0)"


def with_sent(body, *names):
    texts = {**V.SQL, **V.STREAM_SQL}
    return _SENT + "".join(f",\n{n} AS ({texts[n]})" for n in names) + "\n" + body


def _packed(spark, sf, codec="gzip", limits=None):
    files = _sent(spark, sf).withColumn("relative_path", F.col("name"))
    return archives.pack_bundles(files, limits, codec=codec)


_BUNDLES = "(SELECT DISTINCT sender_id, bundle_id FROM members)"


_STATUS = "CASE WHEN count(*) > 7 THEN 'too_many_files' WHEN sum(size_bytes) > 9000 THEN 'bundle_too_large' ELSE 'ok' END"


@register(
    "pack_bundles",
    with_sent(
        f"""SELECT sender_id, bundle_id, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS n_bytes, {_STATUS} AS status, {_STATUS} = 'ok' AS packed
FROM members GROUP BY sender_id, bundle_id"""
    ),
)
def pack_bundles(spark, sf):
    """One row per bundle, with an archive where it is within the caps."""
    done = _packed(spark, sf, limits=PACK_LIMITS)
    return done.select(*KEYS, "n_files", "n_bytes", "status", F.col("archive").isNotNull().alias("packed"))


@register(
    "pack_refused",
    with_sent(
        """SELECT sender_id, bundle_id, CASE WHEN count(*) > 7 THEN 'too_many_files' ELSE 'bundle_too_large' END AS reason
FROM members GROUP BY sender_id, bundle_id HAVING count(*) > 7 OR sum(size_bytes) > 9000"""
    ),
)
def pack_refused(spark, sf):
    """Bundles over the file or byte cap."""
    return _packed(spark, sf, limits=PACK_LIMITS).filter("status <> 'ok'").select(*KEYS, F.col("status").alias("reason"))


@register(
    "explode_archives",
    with_sent(
        f"""SELECT sender_id, bundle_id, row_number() OVER (PARTITION BY sender_id, bundle_id ORDER BY member_idx) - 1 AS member_idx, name, 'file' AS member_type, size_bytes,
  CASE WHEN size_bytes <= 2000 THEN sha256(content) END AS sha256 FROM members JOIN {_BUNDLES} USING (sender_id, bundle_id)"""
    ),
)
def explode_archives(spark, sf):
    """Packed bundles read back, member by member; oversize content is not read."""
    packed = _packed(spark, sf)
    members = archives.read_members(packed, KEYS, "gzip", max_content_bytes=2000)
    return members.select(*KEYS, "member_idx", "name", "member_type", "size_bytes", F.sha2("content", 256).alias("sha256"))


@register(
    "archive_listing",
    with_sent(
        f"""SELECT sender_id, bundle_id, row_number() OVER (PARTITION BY sender_id, bundle_id ORDER BY member_idx) - 1 AS member_idx, name
FROM members JOIN {_BUNDLES} USING (sender_id, bundle_id)"""
    ),
)
def archive_listing(spark, sf):
    """Member names of zstd archives, in order."""
    packed = _packed(spark, sf, "zstd")
    return archives.list_members(packed, KEYS).select(*KEYS, "member_idx", "name")


def _squeezed(spark, sf):
    """Document texts compressed: sound zstd, no archive inside."""

    def squeeze(batches):
        packer = zstandard.ZstdCompressor()
        for batch in batches:
            yield pd.DataFrame(
                {"label": batch["label"], "archive": [packer.compress(t.encode()) for t in batch["text"]]}
            )

    texts = V.table(spark, sf, "documents").select(F.expr("concat('doc-', doc_id)").alias("label"), "text")
    return texts.mapInPandas(squeeze, "label string, archive binary")


def _assorted(spark, sf):
    """Sound archives, the same with damaged bytes, and texts that are none."""
    packed = _packed(spark, sf, "zstd")
    sound = packed.select(F.concat(F.lit("ok-"), "bundle_id").alias("label"), "archive")
    damaged = packed.select(
        F.concat(F.lit("bad-"), "bundle_id").alias("label"), F.concat(F.lit(b"\x00\x01"), "archive").alias("archive")
    )
    return sound.unionByName(damaged).unionByName(_squeezed(spark, sf))


_ASSORTED = f"""(SELECT 'ok-' || bundle_id AS label, true AS valid, NULL AS failed_stage FROM {_BUNDLES}
  UNION ALL SELECT 'bad-' || bundle_id, false, 'zstd' FROM {_BUNDLES} UNION ALL SELECT 'doc-' || doc_id, false, 'tar' FROM documents)"""


@register("archive_validity", with_sent(f"SELECT label, valid FROM {_ASSORTED}"))
def archive_validity(spark, sf):
    """Which archives can be read; damage never fails the job."""
    return archives.check_archives(_assorted(spark, sf), ["label"]).select("label", "valid")


@register("backup_file_validity", with_sent(f"SELECT label, valid, failed_stage FROM {_ASSORTED}"))
def backup_file_validity(spark, sf):
    """Which stage fails when a backup is tested before it is published."""
    return archives.check_backup_files(_assorted(spark, sf), ["label"])


# -- files and logs -----------------------------------------------------------
@register(
    "audit_log_files",
    V.with_chain("SELECT sender_id AS chain, count(*) AS n_lines, CAST(0 AS BIGINT) AS n_broken, true AS ok FROM chain GROUP BY sender_id"),
)
def audit_log_files(spark, sf):
    """Chains written as text logs, read back by file block and verified."""
    folder = fresh_folder(spark, "logs")
    lines = V.built_chain(spark, sf).withColumnRenamed("sender_id", "chain")
    lines.sortWithinPartitions("chain", "seq").select("chain", "line").write.partitionBy("chain").text(folder)
    found = logs.numbered_lines(logs.read_audit_lines(spark, folder))
    checked = audit.verify_chains(found, audit.audit_order(1000))
    name = F.regexp_extract("chain_id", "chain=([^/]+)$", 1)
    return checked.select(name.alias("chain"), "n_lines", "n_broken", "ok")


# -- tables -------------------------------------------------------------------
def _accepted(spark, sf):
    members = V.members(spark, sf)
    declared = V.manifest_files(members)
    checked = validate.checked_members(members, V.BUNDLE_LIMITS)
    findings = through_table(validate.member_findings(checked, declared, V.BUNDLE_LIMITS), "findings")
    verdicts = validate.verdicts_from(findings, declared, V.BUNDLE_LIMITS)
    return validate.accepted_members(findings, verdicts, V.BUNDLE_LIMITS)


@register(
    "quarantine_write",
    V.with_views(
        """SELECT f.sender_id, f.bundle_id, f.relative_path, f.sha256, f.sender_id || '/2024/02/01/' || f.bundle_id AS path
FROM findings f JOIN verdicts v USING (sender_id, bundle_id) WHERE v.accepted""",
        *V.BUNDLE_VIEWS,
    ),
)
def quarantine_write(spark, sf):
    """Accepted members stored under sender and received date, read back."""
    root = fresh_folder(spark, "quarantine")
    rows = _accepted(spark, sf).select(*KEYS, "member_idx", "relative_path", "sha256", "size_bytes")
    tables.write_quarantine(rows, F.lit(V.RECEIVED).cast("timestamp"), root)
    return spark.read.parquet(root).select(*KEYS, "relative_path", "sha256", "path")


@register(
    "quarantine_collisions",
    V.with_views(
        """SELECT DISTINCT sender_id, bundle_id FROM findings f JOIN verdicts v USING (sender_id, bundle_id) WHERE v.accepted AND right(bundle_id, 1) < '5'""",
        *V.BUNDLE_VIEWS,
    ),
)
def quarantine_collisions(spark, sf):
    """Bundles a second write would store again."""
    bundles = _accepted(spark, sf).select(*KEYS)
    kept = F.right("bundle_id", F.lit(1)) < "5"
    stored = V.members(spark, sf).withColumn(
        "bundle_id", F.when(kept, F.col("bundle_id")).otherwise(F.concat(F.lit("old-"), "bundle_id"))
    )
    return tables.collisions(bundles, stored)


@register(
    "snapshot_write",
    V.with_views(
        """SELECT path, size_bytes, sha256, 'tree-20240201-060708' AS snapshot FROM page_files WHERE NOT (
  regexp_matches(path, '(^|/)\\.git(/|$)') OR regexp_matches(path, '\\.(pyc|db|log)(/|$)') OR regexp_matches(path, '/postfix/spool/'))""",
        "page_files",
    ),
)
def snapshot_write(spark, sf):
    """A tree stored as one compressed snapshot without excluded paths."""
    from stowage.functions.globs import DEFAULT_EXCLUSIONS

    root = fresh_folder(spark, "snapshots")
    tables.write_snapshot(V.page_files(spark, sf), root, "tree-20240201-060708", DEFAULT_EXCLUSIONS)
    return spark.read.parquet(root).select("path", "size_bytes", "sha256", "snapshot")


@register(
    "fan_out_copy",
    "SELECT target, true AS ok, (SELECT count(*) FROM customer) AS n_rows FROM (VALUES ('a'), ('b')) t(target) UNION ALL SELECT 'gone', false, 0",
)
def fan_out_copy(spark, sf):
    """A stored table copied to every location that can be reached."""
    root = fresh_folder(spark, "copies")
    source = f"{root}/source"
    V.table(spark, sf, "customer").write.parquet(source)
    targets = {f"{root}/a": "a", "nosuchstore://x/gone": "gone", f"{root}/b": "b"}
    status = tables.copy_to_all(source, list(targets), spark).withColumn(
        "target", F.element_at(F.split("target", "/"), -1)
    )
    counted = (
        spark.read.parquet(f"{root}/a").select(F.lit("a").alias("target"))
        .unionByName(spark.read.parquet(f"{root}/b").select(F.lit("b").alias("target")))
        .groupBy("target")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    return status.join(counted, "target", "left").na.fill(0, ["n_rows"]).select("target", "ok", "n_rows")


# -- the stream ---------------------------------------------------------------
STREAM_LIMITS = V.STREAM_LIMITS


def _arrivals(spark, sf):
    """Uploads of all bundles; some tokens are wrong, some signatures do not hold."""
    members = _sent(spark, sf)
    declared = V.manifest_files(members).withColumnRenamed("idx", "member_idx").withColumn("mtime", F.lit(V.NOW))
    manifests = manifest.build_manifests(declared, F.lit("2024-01-31T00:00:00Z"), F.lit("/var/log"))
    signed = manifest.sign(manifests, V.senders(members))
    packed = _packed(spark, sf)
    conv = F.substring("bundle_id", 2, 20).cast("long")
    claimed = F.when(conv % 17 == 0, F.concat("signature", F.lit("0"))).otherwise(F.col("signature"))
    rows = packed.select(*KEYS, "archive").join(signed, KEYS).select(
        conv.alias("attempt_id"),
        *KEYS,
        F.when(conv % 11 == 0, "stolen").otherwise(F.concat(F.lit("token-"), "sender_id")).alias("token"),
        claimed.alias("signature"),
        F.lit("10.0.0.1").alias("remote_addr"),
        F.col("manifest").cast("binary").alias("manifest"),
        "archive",
    )
    return rows.select(*ARRIVAL.fieldNames())


def _repeated(spark, sf):
    """All bundles, then each again with a forged signature, then with a damaged archive."""
    sent = through_table(_arrivals(spark, sf), "arrivals")
    forged = sent.withColumns(
        {"attempt_id": F.col("attempt_id") + 300_000, "signature": F.concat("signature", F.lit("1"))}
    )
    damaged = sent.withColumns(
        {"attempt_id": F.col("attempt_id") + 600_000, "archive": F.concat(F.lit(b"\x00\x01"), "archive")}
    )
    return sent, sent.unionByName(forged).unionByName(damaged)


def run_stream(spark, sf):
    """Land all bundles several times, take them in, land them with good tokens, take those in."""
    root = fresh_folder(spark, "intake")
    senders = through_table(V.senders(V.members(spark, sf)), "senders")
    sent, first = _repeated(spark, sf)
    second = sent.withColumns(
        {"attempt_id": F.col("attempt_id") + 1_000_000, "token": F.concat(F.lit("token-"), "sender_id")}
    )
    for uploads in (first, second):
        uploads.write.mode("append").parquet(f"{root}/landing")
        intake_stream.run_available(
            spark,
            f"{root}/landing",
            f"{root}/store",
            f"{root}/checkpoint",
            senders,
            STREAM_LIMITS,
            clock=lambda batch: datetime(2024, 2, 1, 6, 7, 8, tzinfo=timezone.utc),
        )
    return f"{root}/store"


# The four landings: sound, forged signature, damaged archive; then sound again with good tokens.
_OUTCOMES = """(SELECT attempt_id, sender_id, bundle_id, status,
  CASE status WHEN 'refused' THEN 'auth' WHEN 'reject' THEN CASE WHEN damaged AND phase IS DISTINCT FROM 0 THEN 'path_unsafe' ELSE reason END END AS reason
FROM (SELECT *, CASE WHEN k < 1000000 AND conv_id % 11 = 0 THEN 'refused' WHEN accepted AND conv_id % 17 <> 0 AND conv_id % 11 <> 0 AND k > 0 THEN 'replay'
    WHEN conv_id % 17 = 0 OR k = 300000 THEN 'refused' WHEN accepted AND NOT damaged THEN 'accept' ELSE 'reject' END AS status
  FROM (SELECT conv_id + k AS attempt_id, k = 600000 AS damaged, *
    FROM (SELECT *, CAST(substr(bundle_id, 2) AS BIGINT) AS conv_id FROM verdicts WHERE bundle_id IN (SELECT bundle_id FROM manifest_files)), (VALUES (0), (300000), (600000), (1000000)) t(k))))"""


@register("stream_intake", with_sent(f"SELECT attempt_id, sender_id, bundle_id, status, reason FROM {_OUTCOMES}", *V.BUNDLE_VIEWS[1:]))
def stream_intake(spark, sf):
    """Outcome of every upload that went through the streaming intake."""
    store = run_stream(spark, sf)
    return spark.read.parquet(f"{store}/outcomes").select("attempt_id", *KEYS, "status", "reason")


@register(
    "stream_audit",
    with_sent(
        f"SELECT sender_id AS chain_id, count(*) AS n_lines, true AS ok FROM {_OUTCOMES} WHERE status IN ('accept', 'reject') GROUP BY sender_id",
        *V.BUNDLE_VIEWS[1:],
    ),
)
def stream_audit(spark, sf):
    """Audit chains grown over several batches, verified."""
    store = run_stream(spark, sf)
    lines = spark.read.parquet(f"{store}/audit/lines").select(
        F.col("sender_id").alias("chain_id"),
        F.col("batch_id").cast("string").alias("file_id"),
        F.lit(False).alias("active"),
        F.col("attempt_id").alias("seq"),
        "line",
    )
    return audit.verify_chains(lines).select("chain_id", "n_lines", "ok")


@register(
    "stream_metrics",
    V.with_views("SELECT sender_id, event AS outcome, count(*) AS bundles FROM attempts GROUP BY ALL", "attempts"),
)
def stream_metrics(spark, sf):
    """Running counters over a stream of audit records."""
    root = fresh_folder(spark, "metrics")
    V.attempts(spark, sf).write.parquet(f"{root}/landing")
    return metrics_stream.run_available(spark, f"{root}/landing", f"{root}/store", f"{root}/checkpoint")


@register(
    "audit_every_attempt",
    with_sent(
        f"""SELECT attempt_id, CASE WHEN status IN ('accept', 'replay') THEN 'accept' ELSE 'reject' END AS event, reason AS reject_reason
FROM {_OUTCOMES} WHERE attempt_id < 1000000""",
        *V.BUNDLE_VIEWS[1:],
    ),
)
def audit_every_attempt(spark, sf):
    """Audit input that also records attempts refused before validation."""
    from stowage.operators import intake

    arrivals = through_table(_repeated(spark, sf)[1], "repeated")
    senders = V.senders(V.members(spark, sf))
    none_stored = senders.filter(F.lit(False)).select("sender_id", F.lit("").alias("bundle_id"))
    gated = through_table(
        intake.gate(intake.described(arrivals), senders, none_stored, STREAM_LIMITS), "gate"
    )
    members = archives.read_members(
        intake.archives_to_open(arrivals, gated), ["attempt_id"], "gzip", STREAM_LIMITS.max_file_bytes
    )
    result = intake.accept_bundles(
        gated, members, F.lit(V.RECEIVED).cast("timestamp"), STREAM_LIMITS, audit_all=True, stage=through_table
    )
    return result.audit.select("attempt_id", "event", "reject_reason")
