"""Queries over bundles: validation, manifests, receipts, arrival."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.registry import register
from stowage.functions import canonical, digests, ids
from stowage.operators import intake, manifest, validate
from stowage.schemas import Limits
from stowage.session import through_table
from stowage.sinks import tables

KEYS = list(validate.BUNDLE)
MEMBERS = ("members", "regular")


def _findings(spark, sf):
    members = V.members(spark, sf)
    declared = V.manifest_files(members)
    checked = validate.checked_members(members, V.BUNDLE_LIMITS)
    return validate.member_findings(checked, declared, V.BUNDLE_LIMITS), declared


def _verdicts(spark, sf):
    findings, declared = _findings(spark, sf)
    return validate.verdicts_from(findings, declared, V.BUNDLE_LIMITS)


@register(
    "bundle_verdict",
    V.with_views(
        "SELECT sender_id, bundle_id, accepted, reason, phase, at_member, n_members, n_bytes FROM verdicts",
        *V.BUNDLE_VIEWS,
    ),
)
def bundle_verdict(spark, sf):
    """Which bundles would be rejected, and why first?"""
    return _verdicts(spark, sf)


@register(
    "bundle_verdict_strict",
    V.with_views(
        """SELECT sender_id, bundle_id, accepted AND lacks IS NULL AS accepted,
  CASE WHEN accepted AND lacks THEN 'hash_mismatch' ELSE reason END AS reason
FROM verdicts LEFT JOIN (SELECT DISTINCT sender_id, bundle_id, true AS lacks FROM manifest_files m
  WHERE NOT EXISTS (SELECT 1 FROM regular r WHERE r.sender_id = m.sender_id AND r.bundle_id = m.bundle_id AND r.relative_path = m.relative_path))
USING (sender_id, bundle_id)""",
        *V.BUNDLE_VIEWS,
    ),
)
def bundle_verdict_strict(spark, sf):
    """The same, where a declared file that was not packed also rejects."""
    findings, declared = _findings(spark, sf)
    return validate.verdicts_from(findings, declared, V.BUNDLE_LIMITS, strict_missing=True).select(
        *KEYS, "accepted", "reason"
    )


_B = V.BUNDLE_LIMITS


@register(
    "reject_detail",
    V.with_views(
        f"""SELECT sender_id, bundle_id, v.reason, f.relative_path AS member,
  CASE v.reason WHEN 'too_many_files' THEN CASE WHEN v.phase = 0 THEN n_declared ELSE running_files END WHEN 'file_too_large' THEN f.size_bytes WHEN 'bundle_too_large' THEN running_bytes END AS value,
  CAST(CASE v.reason WHEN 'too_many_files' THEN {_B.max_files} WHEN 'file_too_large' THEN {_B.max_file_bytes} WHEN 'bundle_too_large' THEN {_B.max_bundle_bytes} END AS BIGINT) AS cap
FROM verdicts v LEFT JOIN (SELECT sender_id, bundle_id, count(*) AS n_declared FROM manifest_files GROUP BY ALL) d USING (sender_id, bundle_id)
LEFT JOIN findings f USING (sender_id, bundle_id) WHERE NOT accepted AND (f.member_idx = at_member OR (at_member IS NULL AND f.member_idx IS NULL))
UNION ALL SELECT sender_id, bundle_id, reason, NULL, n_declared, {_B.max_files} FROM verdicts
JOIN (SELECT sender_id, bundle_id, count(*) AS n_declared FROM manifest_files GROUP BY ALL) USING (sender_id, bundle_id) WHERE phase = 0""",
        *V.BUNDLE_VIEWS,
    ),
)
def reject_detail(spark, sf):
    """Which member broke the rule of each rejected bundle, by how much."""
    findings, declared = _findings(spark, sf)
    findings = through_table(findings, "findings")
    verdicts = validate.verdicts_from(findings, declared, _B)
    return validate.reject_details(verdicts, findings, declared, _B)


_L = V.LARGE_LIMITS


@register(
    "bundle_verdict_large",
    f"""WITH m AS (
  SELECT o_custkey AS bundle_id, o_orderkey AS member_idx, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes,
    row_number() OVER w AS running_files, sum(floor(o_totalprice)) OVER w AS running_bytes
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
v AS (
  SELECT *, CASE WHEN running_files > {_L.max_files} THEN 'too_many_files' WHEN size_bytes > {_L.max_file_bytes} THEN 'file_too_large'
    WHEN running_bytes > {_L.max_bundle_bytes} THEN 'bundle_too_large' END AS reason FROM m)
SELECT CAST(bundle_id AS VARCHAR) AS bundle_id, min(reason) IS NULL AS accepted, arg_min(reason, member_idx) FILTER (reason IS NOT NULL) AS reason,
  min(member_idx) FILTER (reason IS NOT NULL) AS at_member, count(*) AS n_members, CAST(sum(size_bytes) AS BIGINT) AS n_bytes
FROM v GROUP BY v.bundle_id""",
)
def bundle_verdict_large(spark, sf):
    """Size and count rules over orders as bundle members, in slices."""
    members = V.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("bundle_id"),
        F.col("o_orderkey").alias("member_idx"),
        F.expr("concat('f', o_orderkey, '.log')").alias("name"),
        F.lit("file").alias("member_type"),
        F.floor("o_totalprice").cast("long").alias("size_bytes"),
        F.lit(False).alias("has_nul"),
    )
    return validate.bundle_verdicts(members, None, _L, keys=("bundle_id",), width=4096).drop("phase")


@register(
    "running_totals",
    V.with_views("SELECT sender_id, bundle_id, member_idx, running_files, running_bytes FROM running", *MEMBERS, "running"),
)
def running_totals(spark, sf):
    """Running member count and bytes in archive order."""
    checked = validate.checked_members(V.members(spark, sf), V.BUNDLE_LIMITS)
    return validate.with_running_totals(checked, width=4).select(
        *KEYS, "member_idx", "running_files", "running_bytes"
    )


@register(
    "member_findings",
    V.with_views(
        "SELECT sender_id, bundle_id, member_idx, relative_path, CAST(phase AS INTEGER) AS phase, reason FROM findings",
        *V.BUNDLE_VIEWS,
    ),
)
def member_findings(spark, sf):
    """The earliest rule each single member breaks."""
    found = validate.decoded(F.col("violation"))
    return _findings(spark, sf)[0].select(
        *KEYS, "member_idx", "relative_path", found["phase"].alias("phase"), found["reason"].alias("reason")
    )


def _accepted(spark, sf):
    findings, declared = _findings(spark, sf)
    findings = through_table(findings, "findings")
    verdicts = validate.verdicts_from(findings, declared, V.BUNDLE_LIMITS)
    return validate.accepted_members(findings, verdicts, V.BUNDLE_LIMITS)


ACCEPTED = "(SELECT f.* FROM findings f JOIN verdicts v USING (sender_id, bundle_id) WHERE v.accepted)"


@register(
    "accepted_members",
    V.with_views(
        f"SELECT sender_id, bundle_id, member_idx, relative_path, sha256, size_bytes FROM {ACCEPTED}", *V.BUNDLE_VIEWS
    ),
)
def accepted_members(spark, sf):
    """Members of bundles accepted whole."""
    return _accepted(spark, sf).select(*KEYS, "member_idx", "relative_path", "sha256", "size_bytes")


@register(
    "receipts",
    V.with_views(
        f"""SELECT sender_id, bundle_id, '2024-02-01T06:07:08Z' AS received_at, 'accept' AS status, CAST(0 AS BIGINT) AS audit_log_offset,
  string_agg(relative_path || '=' || sha256 || '=' || size_bytes, ';' ORDER BY member_idx) AS verified
FROM {ACCEPTED} GROUP BY ALL""",
        *V.BUNDLE_VIEWS,
    ),
)
def receipts(spark, sf):
    """One receipt per accepted bundle, files in archive order."""
    rows = intake.build_receipts(_accepted(spark, sf), F.lit(V.RECEIVED).cast("timestamp"))
    flat = F.transform("per_file_sha256_verified", lambda f: F.concat_ws("=", f["relative_path"], f["sha256"], f["size_bytes"].cast("string")))
    return rows.select(*KEYS, "received_at", "status", "audit_log_offset", F.array_join(flat, ";").alias("verified"))


@register(
    "bundle_totals",
    V.with_views(
        """SELECT sender_id, bundle_id, CASE WHEN accepted THEN 'accept' ELSE 'reject' END AS event, n_bytes,
  CASE WHEN accepted THEN n_members ELSE 0 END AS file_count, reason FROM verdicts""",
        *V.BUNDLE_VIEWS,
    ),
)
def bundle_totals(spark, sf):
    """What the audit row of each bundle says; a rejected one counts no files."""
    return validate.audit_totals(_verdicts(spark, sf)).select(*KEYS, "event", "n_bytes", "file_count", "reason")


@register(
    "undeclared_and_missing",
    V.with_views(
        """SELECT sender_id, bundle_id, relative_path, 'undeclared' AS side FROM (SELECT sender_id, bundle_id, relative_path FROM regular EXCEPT SELECT sender_id, bundle_id, relative_path FROM manifest_files)
UNION ALL SELECT sender_id, bundle_id, relative_path, 'missing' FROM (SELECT sender_id, bundle_id, relative_path FROM manifest_files EXCEPT SELECT sender_id, bundle_id, relative_path FROM regular)""",
        *MEMBERS,
        "manifest_files",
    ),
)
def undeclared_and_missing(spark, sf):
    """Packed but not declared, and declared but not packed."""
    members = V.members(spark, sf)
    return validate.undeclared_and_missing(validate.checked_members(members), V.manifest_files(members))


# -- digests and manifests ----------------------------------------------------
@register("file_hashes", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def file_hashes(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return manifest.file_digests(docs)


MANIFEST_LIMITS = Limits(max_files=7)
_MANIFESTS = """(SELECT sender_id, bundle_id, count(*) AS n_files,
  '{"bundle_id":"' || bundle_id || '","files":[' || string_agg('{"mtime":"' || strftime(to_timestamp(1706659200 - conv_id * 61 - member_idx) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') || '","relative_path":"'
  || relative_path || '","sha256":"' || sha256 || '","size_bytes":' || size_bytes || '}', ',' ORDER BY member_idx) || '],"schema_version":1,"sender_id":"' || sender_id
  || '","sent_at":"2026-04-19T08:12:00Z","source_root":"/var/log"}' || chr(10) AS manifest
FROM regular GROUP BY sender_id, bundle_id)"""


def _manifests(spark, sf, limits=None):
    checked = validate.checked_members(V.members(spark, sf))
    chosen = checked.withColumn("mtime", F.expr("1706659200 - conv_id * 61 - member_idx"))
    return manifest.build_manifests(
        chosen, F.lit("2026-04-19T08:12:00Z"), F.lit("/var/log"), limits, width=1000
    )


@register("manifest_json", V.with_views(f"SELECT sender_id, bundle_id, n_files, manifest FROM {_MANIFESTS}", *MEMBERS))
def manifest_json(spark, sf):
    """Canonical manifest text of every bundle."""
    return _manifests(spark, sf).select(*KEYS, "n_files", "manifest")


@register(
    "manifest_refused",
    V.with_views("SELECT sender_id, bundle_id, count(*) AS n_rows FROM regular GROUP BY ALL HAVING count(*) > 7", *MEMBERS),
)
def manifest_refused(spark, sf):
    """Bundles with more files than a receiver with a low cap takes."""
    built = _manifests(spark, sf, MANIFEST_LIMITS).filter("status = 'too_many_files' AND manifest IS NULL")
    return built.select(*KEYS, F.col("n_files").alias("n_rows"))


_SIGNED = "'sha256=' || sha256(opad || unhex(sha256(ipad || encode(manifest))))"


@register(
    "manifest_signature",
    V.with_views(f"SELECT sender_id, bundle_id, {_SIGNED} AS signature FROM {_MANIFESTS} JOIN pads USING (sender_id)", *MEMBERS, "pads"),
)
def manifest_signature(spark, sf):
    """Keyed signature over the exact manifest bytes."""
    manifests = _manifests(spark, sf)
    return manifest.sign(manifests, V.senders(V.members(spark, sf))).select(*KEYS, "signature")


@register(
    "signature_check",
    V.with_views(
        f"""SELECT sender_id, bundle_id, CASE right(bundle_id, 1) WHEN '3' THEN false WHEN '4' THEN false WHEN '5' THEN false ELSE true END AS signature_ok
FROM {_MANIFESTS}""",
        *MEMBERS,
    ),
)
def signature_check(spark, sf):
    """Signatures that hold, and ones with edited text, another scheme or another key."""
    pads = V.senders(V.members(spark, sf))
    last = F.right("bundle_id", F.lit(1))
    signed = manifest.sign(_manifests(spark, sf), pads).join(pads, "sender_id")
    claimed = (
        F.when(last == "4", F.replace("signature", F.lit("sha256="), F.lit("md5=")))
        .when(last == "5", digests.signature(F.col("manifest"), F.col("opad"), F.col("ipad")))
        .otherwise(F.col("signature"))
    )
    body = F.when(last == "3", F.concat("manifest", F.lit(" "))).otherwise(F.col("manifest"))
    return signed.select(
        *KEYS, digests.signature_matches(body, claimed, F.col("ipad"), F.col("opad")).alias("signature_ok")
    )


@register(
    "manifest_parse",
    V.with_views(
        f"""SELECT sender_id, bundle_id, CASE right(bundle_id, 1) WHEN '1' THEN 'path_unsafe' WHEN '2' THEN 'path_unsafe' WHEN '3' THEN 'schema_unsupported' END AS manifest_reason,
  CASE WHEN right(bundle_id, 1) IN ('1', '2', '3') THEN 0 ELSE n_files END AS n_entries FROM {_MANIFESTS}""",
        *MEMBERS,
    ),
)
def manifest_parse(spark, sf):
    """Manifests read back; broken, incomplete and unknown-version ones named."""
    last = F.right("bundle_id", F.lit(1))
    body = (
        F.when(last == "1", F.substring("manifest", 3, 1 << 30))
        .when(last == "2", F.replace("manifest", F.lit('"sent_at"'), F.lit('"sent"')))
        .when(last == "3", F.replace("manifest", F.lit('"schema_version":1'), F.lit('"schema_version":99')))
        .otherwise(F.col("manifest"))
    )
    read = manifest.read_manifests(_manifests(spark, sf).withColumn("manifest", body))
    counts = manifest.manifest_entries(read, tuple(KEYS)).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_entries"))
    return read.select(*KEYS, "manifest_reason").join(counts, KEYS, "left").na.fill(0, ["n_entries"])


@register(
    "receipt_digest",
    V.with_views(
        "SELECT sender_id, bundle_id, member_idx, sha256(encode(name) || '\\x00'::BLOB || encode(content)) AS receipt_sha256 FROM members",
        "members",
    ),
)
def receipt_digest(spark, sf):
    """Digest over manifest bytes, a zero byte and archive bytes."""
    return V.members(spark, sf).select(
        *KEYS, "member_idx", digests.receipt_digest(F.col("name"), F.col("content")).alias("receipt_sha256")
    )


@register(
    "bundle_ids",
    """SELECT event_id, stamp[1:8] || '-' || stamp[9:12] || '-7' || h[1:3] || '-' || substr('89ab', ascii(h[4:4]) % 4 + 1, 1) || h[5:7] || '-' || h[9:20] AS bundle_id
FROM (SELECT event_id, lpad(lower(hex(epoch_us(ts) // 1000)), 12, '0') AS stamp, sha256(props || event_id) AS h FROM events)""",
)
def bundle_ids(spark, sf):
    """Time-ordered ids with the noise taken from the row, so they repeat."""
    noise = F.sha2(F.concat("props", F.col("event_id").cast("string")), 256)
    return V.table(spark, sf, "events").select(
        "event_id", ids.uuid7(F.col("ts").cast("timestamp"), noise).alias("bundle_id")
    )


@register(
    "canonical_escapes",
    """SELECT doc_id, '{"x":"' || replace(replace(replace(text, chr(92), '\\\\'), '"', '\\"'), chr(10), '\\n') || '\\u001f\\u000b\\\\u001F"}' AS json FROM documents
WHERE NOT regexp_matches(text, '[\\x00-\\x09\\x0b-\\x1f\\x7f]')
UNION ALL SELECT doc_id, NULL FROM documents WHERE regexp_matches(text, '[\\x00-\\x09\\x0b-\\x1f\\x7f]')""",
)
def canonical_escapes(spark, sf):
    """Lower-case escapes of control characters, literal backslashes left alone."""
    odd = F.col("text").rlike(r"[\x00-\x09\x0b-\x1f\x7f]")
    body = F.to_json(F.struct(F.concat("text", F.lit("\x1f\x0b\\u001F")).alias("x")))
    return V.table(spark, sf, "documents").select(
        "doc_id", F.when(~odd, canonical.lower_escapes(body)).alias("json")
    )


# -- arrival ------------------------------------------------------------------
_TOKENED = """SELECT event_id AS attempt_id, 's' || (user_id % 8) AS sender_id, 'b' || (event_id % 4000) AS bundle_id,
  CASE WHEN event_id % 6 = 0 THEN 'token-wrong' WHEN event_id % 14 = 0 THEN NULL ELSE 'token-s' || (user_id % 8) END AS token FROM events"""


def _tokened(spark, sf):
    return V.table(spark, sf, "events").select(
        F.col("event_id").alias("attempt_id"),
        F.expr("concat('s', user_id % 8)").alias("sender_id"),
        F.expr("concat('b', event_id % 4000)").alias("bundle_id"),
        F.expr(
            "CASE WHEN event_id % 6 = 0 THEN 'token-wrong' WHEN event_id % 14 = 0 THEN NULL "
            "ELSE concat('token-s', user_id % 8) END"
        ).alias("token"),
    )


@register(
    "sender_auth",
    f"""SELECT attempt_id, a.sender_id, coalesce(token = 'token-' || s.sender_id, false) AS auth_ok
FROM ({_TOKENED}) a LEFT JOIN (SELECT DISTINCT 's' || (conv_id % 5) AS sender_id FROM conversations) s USING (sender_id)""",
)
def sender_auth(spark, sf):
    """Allowed sender with its own token; five of eight senders are allowed."""
    allowed = V.senders(V.members(spark, sf))
    return intake.authenticate(_tokened(spark, sf), allowed).select("attempt_id", "sender_id", "auth_ok")


@register(
    "header_match",
    f"""SELECT attempt_id, CASE WHEN attempt_id % 5 = 0 THEN 'sx' ELSE sender_id END IS NOT DISTINCT FROM sender_id
  AND CASE WHEN attempt_id % 9 = 0 THEN NULL ELSE bundle_id END IS NOT DISTINCT FROM bundle_id AS header_ok FROM ({_TOKENED})""",
)
def header_match(spark, sf):
    """Headers against the manifest's own sender and bundle."""
    rows = _tokened(spark, sf)
    named_sender = F.when(V.hit("attempt_id", 5), "sx").otherwise(F.col("sender_id"))
    named_bundle = F.when(~V.hit("attempt_id", 9), F.col("bundle_id"))
    return intake.header_match(rows, named_sender, named_bundle).select("attempt_id", "header_ok")


# Orders of the other statuses are bundles of senders nobody asks for.
_STORED = "(SELECT DISTINCT CASE o_orderstatus WHEN 'P' THEN 's' ELSE 'old' END || (o_custkey % 8) AS sender_id, 'b' || (o_orderkey % 4000) AS bundle_id FROM orders)"


def _stored(spark, sf):
    return V.table(spark, sf, "orders").select(
        F.expr("concat(CASE o_orderstatus WHEN 'P' THEN 's' ELSE 'old' END, o_custkey % 8)").alias("sender_id"),
        F.expr("concat('b', o_orderkey % 4000)").alias("bundle_id"),
    )


@register(
    "replay_split",
    f"""SELECT a.attempt_id, a.sender_id, a.bundle_id,
  k.bundle_id IS NOT NULL OR row_number() OVER (PARTITION BY a.sender_id, a.bundle_id ORDER BY attempt_id) > 1 AS replay
FROM ({_TOKENED}) a LEFT JOIN {_STORED} k USING (sender_id, bundle_id)""",
)
def replay_split(spark, sf):
    """New bundles against ones stored before or earlier in the batch."""
    return intake.replay_split(_tokened(spark, sf), _stored(spark, sf)).select("attempt_id", *KEYS, "replay")


@register(
    "replay_receipts",
    f"SELECT a.attempt_id, a.sender_id, a.bundle_id, 'at ' || k.bundle_id AS received_at FROM ({_TOKENED}) a JOIN {_STORED} k USING (sender_id, bundle_id)",
)
def replay_receipts(spark, sf):
    """The stored receipt a replay is answered with."""
    known = _stored(spark, sf).distinct().withColumn("received_at", F.concat(F.lit("at "), "bundle_id"))
    return intake.stored_receipts(_tokened(spark, sf), known).select("attempt_id", *KEYS, "received_at")


@register(
    "body_cap",
    "SELECT page_id, CAST(strlen(html) AS BIGINT) AS body_bytes, strlen(html) <= 4000 AS within FROM pages",
)
def body_cap(spark, sf):
    """Uploads no larger than the cap, by length alone."""
    size = F.octet_length("html").cast("long")
    return V.table(spark, sf, "pages").select(
        "page_id", size.alias("body_bytes"), intake.within_body_cap(size, Limits(max_bundle_bytes=4000)).alias("within")
    )


@register(
    "receipt_verify",
    V.with_views(
        """SELECT sender_id, bundle_id, relative_path, problem FROM (
  SELECT *, CASE WHEN (conv_id + member_idx) % 17 = 0 THEN 'missing' WHEN (conv_id * 3 + member_idx) % 23 = 0 THEN 'mismatch' END AS problem FROM regular)
WHERE problem IS NOT NULL""",
        *MEMBERS,
    ),
)
def receipt_verify(spark, sf):
    """Stored files whose digest differs from the receipt, or that are gone."""
    expected = validate.checked_members(V.members(spark, sf))
    stored = V.members(spark, sf).withColumn(
        "content",
        F.when(V.hit("conv_id * 3 + member_idx", 23), F.concat(F.lit(b"!"), "content")).otherwise(F.col("content")),
    )
    lost = V.hit("conv_id + member_idx", 17)
    on_disk = validate.checked_members(stored).withColumn(
        "relative_path", F.when(lost, F.concat(F.lit("lost+found/"), "relative_path")).otherwise(F.col("relative_path"))
    )
    return intake.reverify(expected, on_disk).select(*KEYS, "relative_path", "problem")


@register(
    "bundle_lookup",
    V.with_views(
        f"""SELECT sender_id, substr(bundle_id, 1, 2) AS bundle_id, count(*) AS n, min(manifest) AS manifest, 'receipt of ' || sender_id AS receipt
FROM {_MANIFESTS} WHERE substr(bundle_id, 1, 2) = 'b7' GROUP BY ALL""",
        *MEMBERS,
    ),
)
def bundle_lookup(spark, sf):
    """Manifest and receipt of one id, for every sender that used it."""
    short = F.substring("bundle_id", 1, 2)
    manifests = (
        _manifests(spark, sf)
        .groupBy("sender_id", short.alias("bundle_id"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("manifest").alias("manifest"))
    )
    receipts = manifests.select(*KEYS, F.concat(F.lit("receipt of "), "sender_id").alias("receipt"))
    return intake.bundle_lookup(manifests, receipts, F.lit("b7"))


@register(
    "sender_bundles",
    V.with_views(
        """SELECT DISTINCT sender_id, 's2/2024/02/01/' || bundle_id AS path, bundle_id FROM members WHERE sender_id = 's2'""",
        "members",
    ),
)
def sender_bundles(spark, sf):
    """Stored bundles of one sender."""
    bundles = V.members(spark, sf).select(*KEYS).distinct()
    stored = tables.quarantined(bundles, F.lit(V.RECEIVED).cast("timestamp"))
    return intake.list_bundles(stored, "s2").select("sender_id", "path", "bundle_id")
