"""Ordered content rules over bundle members; the first violation decides.

Members have sender_id, bundle_id, member_idx (archive order), name,
member_type, size_bytes and content or its digest.  Bundles are keyed by the
columns in BUNDLE unless the caller says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions import paths, text
from stowage.plans.sliced import SlicedOrder, by_number
from stowage.schemas import Limits

BUNDLE = ("sender_id", "bundle_id")
SLICE_MEMBERS = 50_000

# ---- fixed values: phases and the order of rules inside the member phase ----
PHASE_DECLARED, PHASE_MEMBER, PHASE_TEXT, PHASE_HASH = 0, 1, 2, 3
MEMBER_RULES = (
    "path_unsafe",
    "too_many_files",
    "ext_not_allowed",
    "file_too_large",
    "bundle_too_large",
)
# ---- end of fixed values ----------------------------------------------------

# A violation is one number, so the smallest per bundle is a codegen hash
# aggregate: phase, then member position, then rule.
_PHASE_UNIT, _MEMBER_UNIT = 1 << 58, 1 << 3


def _code(phase: int, rule: Column | int, member_idx: Column | None = None) -> Column:
    at = F.col("member_idx").cast("long") if member_idx is None else member_idx
    return (F.lit(phase * _PHASE_UNIT).cast("long") + at * F.lit(_MEMBER_UNIT) + rule).cast("long")


def _reason(phase: Column, rule: Column) -> Column:
    by_rule = F.element_at(F.array(*[F.lit(r) for r in MEMBER_RULES]), (rule + 1).cast("int"))
    return (
        F.when(phase == PHASE_DECLARED, "too_many_files")
        .when(phase == PHASE_MEMBER, by_rule)
        .when(phase == PHASE_TEXT, "not_text")
        .when(phase == PHASE_HASH, "hash_mismatch")
    )


def decoded(code: Column) -> dict[str, Column]:
    """Phase, place and reason of a packed violation; all null when there is none."""
    phase = F.shiftright(code, 58).cast("int")
    inside = code.bitwiseAND(F.lit(_PHASE_UNIT - 1).cast("long"))
    whole_bundle = (phase == PHASE_DECLARED) | (
        (phase == PHASE_HASH) & (inside >= F.lit(_PHASE_UNIT - _MEMBER_UNIT).cast("long"))
    )
    return {
        "phase": phase,
        "at_member": F.when(~whole_bundle, F.shiftright(inside, 3)),
        "reason": _reason(phase, inside.bitwiseAND(F.lit(7).cast("long"))),
    }


def checked_members(members: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Regular view of the members: normalised path and per-row findings.

    Directories are left out.  Content is read once, for the digest and the
    probe, and dropped; rows that carry sha256 and has_nul already keep them.
    """
    derived = {
        "relative_path": paths.normalise(F.col("name")),
        "path_unsafe": (F.col("member_type") != "file") | paths.escapes_root(F.col("name")),
        "bad_extension": ~paths.extension(paths.normalise(F.col("name"))).isin(list(limits.extensions)),
    }
    if "content" in members.columns:
        derived["has_nul"] = F.coalesce(
            text.has_nul(F.col("content"), limits.probe_bytes), F.lit(False)
        )
        derived["sha256"] = F.sha2("content", 256)
    return members.filter("member_type <> 'dir'").withColumns(derived).drop("content")


def member_order(keys: tuple[str, ...] = BUNDLE, width: int = SLICE_MEMBERS) -> SlicedOrder:
    return SlicedOrder(keys, by_number("member_idx", width), ("member_idx",))


def with_running_totals(
    checked: DataFrame, keys: tuple[str, ...] = BUNDLE, width: int = SLICE_MEMBERS
) -> DataFrame:
    """Running member count and running bytes in archive order, row included.

    Members read from archives have both already and are not shuffled for it.
    """
    if {"running_files", "running_bytes"} <= set(checked.columns):
        return checked
    return member_order(keys, width).running(
        checked, {"running_files": F.lit(1).cast("long"), "running_bytes": F.col("size_bytes")}
    )


def latest_manifest_entries(
    manifest_files: DataFrame, keys: tuple[str, ...] = BUNDLE
) -> DataFrame:
    """One declared digest per path; of repeated paths the last entry holds."""
    return manifest_files.groupBy(*keys, "relative_path").agg(
        F.max_by(F.struct("sha256", "size_bytes"), "idx").alias("declared")
    )


def _content_violation(limits: Limits) -> Column:
    """Packed violation of a member by the rules that need no manifest."""
    broken = {
        "path_unsafe": F.col("path_unsafe"),
        "too_many_files": F.col("running_files") > limits.max_files,
        "ext_not_allowed": F.col("bad_extension"),
        "file_too_large": F.col("size_bytes") > limits.max_file_bytes,
        "bundle_too_large": F.col("running_bytes") > limits.max_bundle_bytes,
    }
    found = F
    for number, name in enumerate(MEMBER_RULES):
        found = found.when(broken[name], _code(PHASE_MEMBER, number))
    return found.when(F.col("has_nul"), _code(PHASE_TEXT, 0))


def member_findings(
    checked: DataFrame,
    manifest_files: DataFrame | None,
    limits: Limits = Limits(),
    keys: tuple[str, ...] = BUNDLE,
    width: int = SLICE_MEMBERS,
) -> DataFrame:
    """Each member with the earliest rule it breaks, null when it breaks none.

    A member's own earliest rule is enough: the smallest over the bundle is the
    bundle's first violation.  Members already found at fault need no digest
    check, so they join on their position and not on their path; what is left
    is at most `max_files` rows per bundle, whatever the bundle's size.
    """
    rows = with_running_totals(checked, keys, width).withColumn(
        "violation", _content_violation(limits)
    )
    if manifest_files is None:
        return rows
    entries = latest_manifest_entries(manifest_files, keys).withColumnRenamed(
        "relative_path", "_lookup"
    )
    at_fault = F.col("violation").isNotNull()
    position = F.concat(F.lit("//"), F.col("member_idx").cast("string"))
    wrong = ~F.col("declared.sha256").eqNullSafe(F.col("sha256"))
    return (
        rows.withColumn("_lookup", F.when(at_fault, position).otherwise(F.col("relative_path")))
        .join(entries, [*keys, "_lookup"], "left")
        .withColumn("violation", F.when(at_fault, F.col("violation")).when(wrong, _code(PHASE_HASH, 0)))
        .drop("_lookup")
    )


def bundle_verdicts(
    members: DataFrame,
    manifest_files: DataFrame | None,
    limits: Limits = Limits(),
    keys: tuple[str, ...] = BUNDLE,
    width: int = SLICE_MEMBERS,
    strict_missing: bool = False,
) -> DataFrame:
    """One row per bundle: accepted, or the reason and place of the first violation."""
    checked = checked_members(members, limits)
    findings = member_findings(checked, manifest_files, limits, keys, width)
    return verdicts_from(findings, manifest_files, limits, keys, strict_missing)


def verdicts_from(
    findings: DataFrame,
    manifest_files: DataFrame | None,
    limits: Limits = Limits(),
    keys: tuple[str, ...] = BUNDLE,
    strict_missing: bool = False,
) -> DataFrame:
    """Reduce member findings to verdicts.

    A bundle known only from its manifest counts as empty.  `strict_missing`
    also rejects a bundle that lacks a declared file.
    """
    per_bundle = findings.groupBy(*keys).agg(
        F.min("violation").alias("code"),
        F.count(F.lit(1)).alias("n_members"),
        F.sum("size_bytes").alias("n_bytes"),
    )
    code = F.col("code")
    if manifest_files is not None:
        declared = manifest_files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_declared"))
        per_bundle = per_bundle.join(declared, list(keys), "full_outer")
        declared_over = F.col("n_declared") > limits.max_files
        code = F.when(declared_over, _code(PHASE_DECLARED, 0, F.lit(0))).otherwise(code)
        if strict_missing:
            lacking = (
                undeclared_and_missing(findings, manifest_files, keys)
                .filter("side = 'missing'")
                .select(*keys)
                .distinct()
                .withColumn("_lacks", F.lit(True))
            )
            per_bundle = per_bundle.join(lacking, list(keys), "left")
            end = _code(PHASE_HASH, 0, F.lit(_PHASE_UNIT // _MEMBER_UNIT - 1).cast("long"))
            code = F.coalesce(code, F.when(F.col("_lacks"), end))
    parts = decoded(F.col("code"))
    return per_bundle.withColumn("code", code).select(
        *keys,
        F.col("code").isNull().alias("accepted"),
        *[value.alias(name) for name, value in parts.items()],
        F.coalesce("n_members", F.lit(0)).cast("long").alias("n_members"),
        F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"),
    )


def reject_details(
    verdicts: DataFrame,
    findings: DataFrame,
    manifest_files: DataFrame | None,
    limits: Limits = Limits(),
    keys: tuple[str, ...] = BUNDLE,
) -> DataFrame:
    """What broke the rule, one row per rejected bundle: reason, member, value and cap.

    `value` is the measure that went over `cap`: entries declared, members or
    bytes up to and with the member, or its own bytes; both are null for rules
    without a number.  The member is found by its place, so a bundle with many
    members is no larger a group than another.
    """
    rejected = verdicts.filter("NOT accepted").select(*keys, "phase", "reason", "at_member")
    at = findings.filter("violation IS NOT NULL").select(
        *keys,
        F.col("member_idx").alias("at_member"),
        F.col("relative_path").alias("member"),
        *["size_bytes", "running_files", "running_bytes"],
    )
    found = rejected.join(at, [*keys, "at_member"], "left")
    declared = F.lit(None).cast("long")
    if manifest_files is not None:
        found = found.join(manifest_files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_declared")), list(keys), "left")
        declared = F.col("n_declared")
    reason = F.col("reason")
    count = F.when(F.col("phase") == PHASE_DECLARED, declared).otherwise(F.col("running_files"))
    return found.select(
        *keys,
        "reason",
        "member",
        F.when(reason == "too_many_files", count)
        .when(reason == "file_too_large", F.col("size_bytes"))
        .when(reason == "bundle_too_large", F.col("running_bytes"))
        .alias("value"),
        F.when(reason == "too_many_files", F.lit(limits.max_files))
        .when(reason == "file_too_large", F.lit(limits.max_file_bytes))
        .when(reason == "bundle_too_large", F.lit(limits.max_bundle_bytes))
        .cast("long")
        .alias("cap"),
    )


def accepted_members(
    findings: DataFrame,
    verdicts: DataFrame,
    limits: Limits = Limits(),
    keys: tuple[str, ...] = BUNDLE,
) -> DataFrame:
    """Members of accepted bundles; a rejected bundle loses every member.

    A member with a finding of its own, or past the file cap, is in a rejected
    bundle already, so the join sees at most `max_files` rows per bundle.
    """
    accepted = verdicts.filter("accepted").select(*keys)
    open_rows = findings.filter(
        F.col("violation").isNull() & (F.col("running_files") <= limits.max_files)
    )
    return open_rows.join(accepted, list(keys), "left_semi")


def undeclared_and_missing(
    checked: DataFrame, manifest_files: DataFrame, keys: tuple[str, ...] = BUNDLE
) -> DataFrame:
    """Paths in the archive but not the manifest, and the other way round."""
    on = [*keys, "relative_path"]
    packed = checked.select(*on).distinct()
    declared = manifest_files.select(*on).distinct()
    return (
        packed.join(declared, on, "left_anti")
        .withColumn("side", F.lit("undeclared"))
        .unionByName(declared.join(packed, on, "left_anti").withColumn("side", F.lit("missing")))
    )


def audit_totals(verdicts: DataFrame) -> DataFrame:
    """What an audit row says about a bundle: a rejected one counts no files."""
    return verdicts.withColumns(
        {
            "event": F.when(F.col("accepted"), "accept").otherwise("reject"),
            "file_count": F.when(F.col("accepted"), F.col("n_members")).otherwise(F.lit(0)),
        }
    )
