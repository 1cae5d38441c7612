"""Arrival of bundles: who may send, what is new, what was stored.

`accept_bundles` is the whole path; the steps are usable alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions import digests, text
from stowage.operators import manifest as manifests
from stowage.operators import validate
from stowage.operators.validate import BUNDLE
from stowage.plans import spread
from stowage.schemas import RECEIPT, Limits

ATTEMPT = ("attempt_id",)


# -- who ----------------------------------------------------------------------
def token_ok() -> Column:
    return F.coalesce(F.sha2("token", 256) == F.col("token_sha"), F.lit(False))


def authenticate(attempts: DataFrame, senders: DataFrame) -> DataFrame:
    """Add auth_ok: the sender is allowed and the token is its token.

    `senders` has sender_id and token_sha, so tokens are compared as digests and
    never stored.  The sender table's measured size decides how it is joined.
    """
    known = senders.select("sender_id", "token_sha")
    return (
        attempts.join(known, "sender_id", "left").withColumn("auth_ok", token_ok()).drop("token_sha")
    )


def header_match(attempts: DataFrame, sender: Column, bundle: Column) -> DataFrame:
    """Add header_ok: the headers name the manifest's own sender and bundle."""
    same = F.col("sender_id").eqNullSafe(sender) & F.col("bundle_id").eqNullSafe(bundle)
    return attempts.withColumn("header_ok", same)


def within_body_cap(body_bytes: Column, limits: Limits = Limits()) -> Column:
    return body_bytes <= limits.max_bundle_bytes


# -- what is new --------------------------------------------------------------
def replay_split(attempts: DataFrame, stored: DataFrame, order: str = "attempt_id") -> DataFrame:
    """Add replay: the bundle is stored already, or came earlier in this batch.

    The same bundle id from another sender is another bundle.  First arrivals
    are found by an aggregate with map-side combine and joined on the attempt's
    own id, so a bundle sent very often stays spread.
    """
    firsts = attempts.groupBy(*BUNDLE).agg(F.min(order).alias(order))
    fresh = firsts.join(stored.select(*BUNDLE).distinct(), list(BUNDLE), "left_anti")
    return (
        attempts.join(fresh.withColumn("_fresh", F.lit(True)), [*BUNDLE, order], "left")
        .withColumn("replay", F.col("_fresh").isNull())
        .drop("_fresh")
    )


def stored_receipts(attempts: DataFrame, receipts: DataFrame) -> DataFrame:
    """The receipt a replayed attempt is answered with.

    Receipts are cut down to the bundles that were attempted before any of them
    is repeated for a bundle that is sent over and over.
    """
    asked = attempts.select(*BUNDLE).distinct()
    needed = receipts.join(asked, list(BUNDLE), "left_semi")
    return spread.spread_lookup(attempts, needed, list(BUNDLE), how="inner")


# -- receipts -----------------------------------------------------------------
def build_receipts(
    accepted: DataFrame, received_at: Column, keys: tuple[str, ...] = BUNDLE
) -> DataFrame:
    """One receipt per accepted bundle, files in archive order.

    `accepted` comes out of validation, so a bundle has at most `max_files`
    rows and one array holds it.
    """
    entry = F.struct(
        "member_idx", F.struct("relative_path", "sha256", "size_bytes").alias("file")
    )
    return (
        accepted.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(entry)).alias("_e"))
        .select(
            *keys,
            text.utc_text(received_at).alias("received_at"),
            F.transform("_e", lambda e: e["file"]).alias("per_file_sha256_verified"),
            F.lit(0).cast("long").alias("audit_log_offset"),
            F.lit("accept").alias("status"),
        )
    )


def answered(receipts: DataFrame, offsets: DataFrame) -> DataFrame:
    """Receipts as the sender gets them: with the place of their audit record.

    The stored receipt is written before its audit record and keeps 0 there.
    `offsets` has the bundle keys, event and audit_log_offset.
    """
    places = offsets.filter("event = 'accept'").select(*BUNDLE, "audit_log_offset")
    return receipts.drop("audit_log_offset").join(places, list(BUNDLE), "left")


def receipt_files(receipts: DataFrame, keys: tuple[str, ...] = BUNDLE) -> DataFrame:
    return receipts.select(*keys, F.explode("per_file_sha256_verified").alias("f")).select(
        *keys, "f.relative_path", "f.sha256", "f.size_bytes"
    )


def read_receipts(texts: DataFrame, column: str = "receipt") -> DataFrame:
    """Parse stored receipt texts; add `r` and `readable`."""
    parsed = F.from_json(F.col(column).cast("string"), RECEIPT)
    whole = F.lit(True)
    for field in RECEIPT.fieldNames():
        whole = whole & F.col("r")[field].isNotNull()
    return texts.withColumn("r", parsed).withColumn("readable", F.coalesce(whole, F.lit(False)))


def reverify(
    expected: DataFrame, stored: DataFrame, keys: tuple[str, ...] = BUNDLE
) -> DataFrame:
    """Receipt files whose stored bytes differ or are gone.

    `expected` has the keys, relative_path and sha256; `stored` has the digest
    of what is on disk now.
    """
    actual = stored.select(*keys, "relative_path", F.col("sha256").alias("actual_sha256"))
    return (
        expected.join(actual, [*keys, "relative_path"], "left")
        .filter(~F.col("sha256").eqNullSafe(F.col("actual_sha256")))
        .withColumn("problem", F.when(F.col("actual_sha256").isNull(), "missing").otherwise("mismatch"))
    )


# -- lookups ------------------------------------------------------------------
def list_bundles(receipts: DataFrame, sender: str | None = None) -> DataFrame:
    """Stored bundles by sender and path; the sender filter prunes partitions."""
    chosen = receipts if sender is None else receipts.filter(F.col("sender_id") == sender)
    return chosen.orderBy("sender_id", "path")


def bundle_lookup(manifest_table: DataFrame, receipts: DataFrame, bundle_id: Column) -> DataFrame:
    """Manifest and receipt of one bundle id, for every sender that used it."""
    return manifest_table.filter(F.col("bundle_id") == bundle_id).join(
        receipts.filter(F.col("bundle_id") == bundle_id), list(BUNDLE), "inner"
    )


# -- the whole path -----------------------------------------------------------
@dataclass(frozen=True)
class Intake:
    """Result frames of a batch of arrivals.

    outcomes  -- one row per attempt: status accept, reject, replay or refused,
                 with the reason
    accepted  -- members of accepted bundles, with digests, no content
    receipts  -- one row per accepted bundle
    manifests -- the signed manifest bytes of each accepted bundle
    audit     -- one unchained audit record per processed attempt
    """

    outcomes: DataFrame
    accepted: DataFrame
    receipts: DataFrame
    manifests: DataFrame
    audit: DataFrame


def gate(
    arrivals: DataFrame, senders: DataFrame, stored: DataFrame, limits: Limits = Limits()
) -> DataFrame:
    """Checks before the content is looked at, in the order they apply.

    `senders` has sender_id, token_sha, ipad and opad.  `arrivals` went through
    `described`, so the archive bytes are not carried along.  Adds the parsed
    manifest `m` and `early`, the status and reason that ended the attempt, or
    null.
    """
    known = arrivals.join(
        senders.select("sender_id", "token_sha", "ipad", "opad"), "sender_id", "left"
    ).withColumn("auth_ok", token_ok())
    seen = stored.select(*BUNDLE).distinct().withColumn("_stored", F.lit(True))
    looked_up = known.join(seen, list(BUNDLE), "left")
    read = manifests.read_manifests(looked_up)
    signed = digests.signature_matches(
        F.col("manifest"), F.col("signature"), F.col("ipad"), F.col("opad")
    )
    matched = header_match(read, F.col("m.sender_id"), F.col("m.bundle_id"))

    def ended(status: str, reason: Column | str) -> Column:
        why = reason if isinstance(reason, Column) else F.lit(reason)
        return F.struct(F.lit(status).alias("status"), why.alias("reason"))

    early = (
        F.when(~F.col("auth_ok"), ended("refused", "auth"))
        .when(F.col("_stored"), ended("replay", F.lit(None).cast("string")))
        .when(~within_body_cap(F.col("body_bytes"), limits), ended("refused", "bundle_too_large"))
        .when(~signed, ended("refused", "auth"))
        .when(F.col("manifest_reason").isNotNull(), ended("refused", F.col("manifest_reason")))
        .when(~F.col("header_ok"), ended("refused", "auth"))
    )
    return matched.withColumn("early", early).drop(
        "ipad", "opad", "token_sha", "_stored", "token"
    )


def accept_bundles(
    gated: DataFrame,
    members: DataFrame,
    received_at: Column,
    limits: Limits = Limits(),
    audit_all: bool = False,
    width: int = validate.SLICE_MEMBERS,
    stage: Callable[[DataFrame, str], DataFrame] = lambda df, label: df,
) -> Intake:
    """Judge every attempt that passed the gate and shape what is to be stored.

    `gated` is the output of `gate`; `members` are the archive members of the
    attempts that passed, keyed by attempt_id.  Attempts are judged one by one;
    of several accepted attempts of one bundle the earliest is stored.  Every
    later attempt with a good token is a replay, whatever its signature, size or
    content, as it would be in a later batch: outcomes do not depend on how
    uploads fall into batches.  `audit_all` also records attempts the gate ended.
    `stage` may store a frame that several results are made from; with a written
    table every archive is opened once.
    """
    passed = gated.filter("early IS NULL")
    entries = manifests.manifest_entries(passed, ATTEMPT)
    checked = validate.checked_members(members, limits)
    findings = stage(
        validate.member_findings(checked, entries, limits, ATTEMPT, width).select(
            "attempt_id", "member_idx", "relative_path", "sha256", "size_bytes", "running_files", "violation"
        ),
        "findings",
    )
    verdicts = validate.verdicts_from(findings, entries, limits, ATTEMPT)
    heads = gated.select("attempt_id", *BUNDLE, "remote_addr", "auth_ok", "early", "receipt_sha256", "byte_count")
    judged = heads.join(verdicts, "attempt_id", "left").withColumn(
        "_accepted", F.col("early").isNull() & F.coalesce("accepted", F.lit(True))
    )
    first = (
        judged.filter("_accepted")
        .groupBy(*BUNDLE)
        .agg(F.min("attempt_id").alias("_first"))
    )
    # Attempts without a good token do not need the lookup; the join key keeps
    # them apart so only the others of a bundle meet.
    own = F.when(F.col("auth_ok"), F.lit(-1)).otherwise(F.col("attempt_id"))
    later = judged.withColumn("_own", own).join(
        first.withColumn("_own", F.lit(-1).cast("long")), [*BUNDLE, "_own"], "left"
    )
    replayed = F.coalesce(F.col("attempt_id") > F.col("_first"), F.lit(False))
    status = (
        F.when(replayed, "replay")
        .when(F.col("early").isNotNull(), F.col("early.status"))
        .when(F.col("_accepted"), "accept")
        .otherwise("reject")
    )
    outcomes = later.select(
        "attempt_id",
        *BUNDLE,
        "remote_addr",
        status.alias("status"),
        F.when(~replayed, F.coalesce(F.col("early.reason"), F.col("reason"))).alias("reason"),
        F.when(replayed, 0).otherwise(F.coalesce("n_members", F.lit(0))).cast("long").alias("n_members"),
        "byte_count",
        "receipt_sha256",
    )
    outcomes = stage(outcomes, "outcomes")
    kept = outcomes.filter("status = 'accept'").select("attempt_id", *BUNDLE)
    open_rows = findings.filter(
        F.col("violation").isNull() & (F.col("running_files") <= limits.max_files)
    )
    accepted = open_rows.join(kept, "attempt_id", "inner").select(
        "attempt_id", *BUNDLE, "member_idx", "relative_path", "sha256", "size_bytes"
    )
    # A bundle without any member is stored too, with an empty file list.
    filled = build_receipts(accepted, received_at)
    receipts = kept.select(*BUNDLE).join(filled, list(BUNDLE), "left").select(
        *BUNDLE,
        F.coalesce("received_at", text.utc_text(received_at)).alias("received_at"),
        F.coalesce(
            "per_file_sha256_verified",
            F.array().cast("array<struct<relative_path:string,sha256:string,size_bytes:bigint>>"),
        ).alias("per_file_sha256_verified"),
        F.lit(0).cast("long").alias("audit_log_offset"),
        F.lit("accept").alias("status"),
    )
    processed = F.col("status").isin("accept", "reject")
    recorded = outcomes if audit_all else outcomes.filter(processed)
    audit = recorded.select(
        "attempt_id",
        text.utc_text(received_at).alias("ts"),
        F.when(F.col("status").isin("accept", "replay"), "accept").otherwise("reject").alias("event"),
        *BUNDLE,
        "remote_addr",
        "byte_count",
        F.when(F.col("status") == "accept", F.col("n_members")).otherwise(F.lit(0)).alias("file_count"),
        F.when(~F.col("status").isin("accept", "replay"), F.col("reason")).alias("reject_reason"),
        "receipt_sha256",
    )
    # One accepted attempt per bundle is recorded, so a receipt finds one record.
    manifests_kept = gated.select("attempt_id", "manifest").join(kept, "attempt_id").select(*BUNDLE, "manifest")
    return Intake(outcomes, accepted, receipts, manifests_kept, audit)


def described(arrivals: DataFrame) -> DataFrame:
    """Arrivals without their archive: its digest and sizes take its place.

    Done on the scan, so archive bytes never enter a shuffle.
    """
    return arrivals.withColumns(
        {
            "receipt_sha256": digests.receipt_digest(F.col("manifest"), F.col("archive")),
            "byte_count": F.octet_length("archive").cast("long"),
            "body_bytes": (F.octet_length("archive") + F.octet_length("manifest")).cast("long"),
        }
    ).drop("archive")


def archives_to_open(arrivals: DataFrame, gated: DataFrame) -> DataFrame:
    """Archives of the attempts that passed the gate, nothing else is opened."""
    passed = gated.filter("early IS NULL").select("attempt_id")
    return arrivals.select("attempt_id", "archive").join(passed, "attempt_id", "left_semi")
