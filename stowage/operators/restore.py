"""Selective restore, reconciliation and differences between trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions import globs, paths
from stowage.plans import spread


def prune_paths(requested: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct requested paths that lie below no other requested path."""
    distinct = requested.select(*keys, "path").distinct()
    return spread.covered(distinct, "path", distinct, keys, "_below").filter("NOT _below").drop("_below")


def select_members(members: DataFrame, requested: DataFrame, keys: list[str]) -> DataFrame:
    """Archive members equal to or below a requested path.

    The request is not pruned first: a path below another adds no member.
    """
    below = spread.covered(members, "path", requested, keys, "_below")
    named = spread.spread_flag(below, requested, [*keys, "path"], "_named")
    return named.filter("_below OR _named").drop("_below", "_named")


def reconcile(backup: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """What a restore does to each path; nothing is ever deleted."""
    on = [*keys, "path"]
    b = backup.select(*on, F.lit(True).alias("_b"))
    l = live.select(*on, F.lit(True).alias("_l"))
    return b.join(l, on, "full_outer").select(
        *on,
        F.when(F.col("_b") & F.col("_l"), "overwrite")
        .when(F.col("_b"), "restore")
        .otherwise("preserve")
        .alias("action"),
    )


def without_excluded(
    files: DataFrame,
    patterns: tuple[str, ...] = globs.DEFAULT_EXCLUSIONS,
    ignore_exclusions: bool = False,
    path: str = "path",
) -> DataFrame:
    """Files no exclusion pattern matches; the flag keeps everything."""
    if ignore_exclusions:
        return files
    return files.filter(~globs.excluded(F.col(path), patterns))


def path_excluded(
    path: Column, root: str, patterns: tuple[str, ...], ignore_exclusions: bool = False
) -> Column:
    """Exclusion of a path that may be absolute; one outside the root never is."""
    if ignore_exclusions:
        return F.lit(False)
    top = root.rstrip("/")
    absolute = path.startswith("/")
    inside = path.startswith(top + "/")
    relative = paths.normalise(F.when(inside, F.substring(path, len(top) + 2, 1 << 30)).otherwise(path))
    return F.when(absolute & ~inside, F.lit(False)).otherwise(globs.excluded(relative, patterns))


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Per path: unchanged, changed, added or deleted, with the bytes after."""
    on = [*keys, "path"]
    a = before.select(*on, F.struct(*compare).alias("_a"), F.lit(True).alias("_in_a"))
    b = after.select(*on, F.struct(*compare).alias("_b"), F.col("size_bytes"), F.lit(True).alias("_in_b"))
    return a.join(b, on, "full_outer").select(
        *on,
        F.when(F.col("_in_a").isNull(), "added")
        .when(F.col("_in_b").isNull(), "deleted")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged")
        .otherwise("changed")
        .alias("state"),
        F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size_bytes"),
    )


def dedup_savings(diff: DataFrame, by: list[str]) -> DataFrame:
    """Bytes of a snapshot, and how many of them are new."""
    new = F.col("state").isin("added", "changed")
    return diff.filter("state <> 'deleted'").groupBy(*by).agg(
        F.sum("size_bytes").alias("total_bytes"),
        F.sum(F.when(new, F.col("size_bytes")).otherwise(F.lit(0))).alias("new_bytes"),
        F.sum(F.when(new, F.lit(0)).otherwise(F.col("size_bytes"))).alias("saved_bytes"),
    )


def _age(mtime: Column, now_epoch: Column | None) -> Column:
    return now_epoch - mtime


def sync_filter(
    files: DataFrame,
    include: tuple[str, ...] = (),
    exclude: tuple[str, ...] = (),
    min_size: int | None = None,
    max_size: int | None = None,
    min_age: int | None = None,
    max_age: int | None = None,
    now_epoch: Column | None = None,
) -> DataFrame:
    """Files a sync profile covers: globs, then size, then age in seconds."""
    keep = globs.excluded(F.col("path"), include) if include else F.lit(True)
    if exclude:
        keep = keep & ~globs.excluded(F.col("path"), exclude)
    if min_size is not None:
        keep = keep & (F.col("size_bytes") >= min_size)
    if max_size is not None:
        keep = keep & (F.col("size_bytes") <= max_size)
    if min_age is not None:
        keep = keep & (_age(F.col("mtime"), now_epoch) >= min_age)
    if max_age is not None:
        keep = keep & (_age(F.col("mtime"), now_epoch) <= max_age)
    return files.filter(keep)


def sync_plan(source: DataFrame, target: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """Action per path: sync makes the target equal, copy never deletes, bisync
    sends the newer file either way."""
    if mode not in ("sync", "copy", "bisync"):
        raise ValueError(f"unknown sync mode {mode!r}")
    on = [*keys, "path"]
    fields = ("size_bytes", "mtime", "sha256")
    s = source.select(*on, F.struct(*fields).alias("s"))
    t = target.select(*on, F.struct(*fields).alias("t"))
    both = s.join(t, on, "full_outer")
    same = F.col("s.sha256").eqNullSafe(F.col("t.sha256"))
    only_source, only_target = F.col("t").isNull(), F.col("s").isNull()
    if mode == "bisync":
        newer_here = F.col("s.mtime") >= F.col("t.mtime")
        action = (
            F.when(only_source, "add_to_target")
            .when(only_target, "add_to_source")
            .when(same, "none")
            .when(newer_here, "update_target")
            .otherwise("update_source")
        )
    else:
        action = (
            F.when(only_source, "add_to_target")
            .when(only_target, F.lit("delete_from_target") if mode == "sync" else F.lit("none"))
            .when(same, "none")
            .otherwise("update_target")
        )
    moved = F.when(action.isin("add_to_target", "update_target"), F.col("s.size_bytes")).when(
        action.isin("add_to_source", "update_source"), F.col("t.size_bytes")
    )
    return both.select(
        *on, action.alias("action"), F.coalesce(moved, F.lit(0)).cast("long").alias("transfer_bytes")
    )


def sync_status(plan: DataFrame, by: list[str]) -> DataFrame:
    """Totals of a plan per profile."""
    return plan.groupBy(*by).agg(
        F.sum("transfer_bytes").alias("bytes"),
        F.count_if(F.col("action").startswith("add_")).alias("added"),
        F.count_if(F.col("action").startswith("update_")).alias("modified"),
        F.count_if(F.col("action").startswith("delete_")).alias("deleted"),
        F.count_if(F.col("action") == "none").alias("untouched"),
    )
