"""Questions to a backup catalog: latest, nth, retention, rotation, status.

A catalog has location (or file_id), name, modified_time and size_bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.globs import any_glob
from stowage.plans.sliced import SlicedOrder, by_range
from stowage.sources.listing import ARCHIVE_SUFFIX

# ---- fixed values -----------------------------------------------------------
KEEP_BACKUPS = 5
KEEP_SNAPSHOTS = 10
SNAPSHOT_NAME = r"^\d{4}-\d{2}-\d{2}-\d{6}$"
SNAPSHOT_TIME = "yyyy-MM-dd-HHmmss"
# ---- end of fixed values ----------------------------------------------------


def ranked(
    backups: DataFrame, keys: tuple[str, ...], name: str, order: tuple[str, ...] = ("modified_time", "name")
) -> DataFrame:
    """Add the place of each row counted from the newest, 1 first; rows without a time are the oldest."""
    sliced, table = by_range(backups, keys, order, newest_first=True)
    return sliced.position(table, name)


def _newest(backups: DataFrame, keys: tuple[str, ...], most: int, tie: str, name: str) -> DataFrame:
    """The newest rows of each key with their place.

    Up to Spark's own limit the rank is cut on every map task before rows are
    shuffled; beyond it a key would be ranked whole by one task, so it is sliced.
    """
    conf = backups.sparkSession.conf
    if most <= int(conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        order = Window.partitionBy(*keys).orderBy(F.col("modified_time").desc(), F.col(tie).desc())
        placed = backups.withColumn(name, F.row_number().over(order).cast("long"))
    else:
        placed = ranked(backups, keys, name, ("modified_time", tie))
    return placed.filter(F.col(name) <= most)


# -- predicates ---------------------------------------------------------------
def is_archive(name: Column) -> Column:
    return name.endswith(ARCHIVE_SUFFIX)


def is_plain_archive(name: Column, dotted: bool = False) -> Column:
    """Names whose only suffixes are those of an archive; `dotted` lifts that."""
    return is_archive(name) if dotted else name.rlike(r"(?s)^\.*[^.]+\.tar\.zst$")


# -- lookups ------------------------------------------------------------------
def latest(backups: DataFrame, keys: list[str]) -> DataFrame:
    """Newest archive of each location."""
    found = backups.filter(is_archive(F.col("name")))
    return found.groupBy(*keys).agg(
        F.max_by("name", F.struct("modified_time", "name")).alias("name"),
        F.max("modified_time").alias("modified_time"),
    )


def latest_matching(backups: DataFrame, pattern: Column | str, keys: list[str]) -> DataFrame:
    """Newest archive whose name holds the pattern before its suffix.

    A text may hold wildcards; a column, whose value may differ by row, is taken
    literally.
    """
    if isinstance(pattern, str):
        return latest(backups.filter(any_glob(F.col("name"), [f"*{pattern}*{ARCHIVE_SUFFIX}"])), keys)
    stem = F.left(F.col("name"), F.length("name") - len(ARCHIVE_SUFFIX))
    return latest(backups.filter(is_archive(F.col("name")) & F.contains(stem, pattern)), keys)


def latest_by_priority(backups: DataFrame, locations: DataFrame, keys: list[str]) -> DataFrame:
    """Newest archive in the first location that has any.

    `locations` has location and priority, the smallest first.
    """
    newest = latest(backups, [*keys, "location"]).join(locations, "location")
    pick = F.struct("priority", "location")
    return newest.groupBy(*keys).agg(
        F.min_by("name", pick).alias("name"),
        F.min_by("location", pick).alias("location"),
    )


def nth_newest(
    backups: DataFrame, keys: tuple[str, ...], revision: int, tie: str = "name"
) -> DataFrame:
    """Backup that many steps back, 0 the newest; no row where there are fewer."""
    if revision < 0:
        raise ValueError("revision counts back from the newest and is never negative")
    placed = _newest(backups, keys, revision + 1, tie, "_rank")
    return placed.filter(F.col("_rank") == revision + 1).drop("_rank")


def newest_listing(backups: DataFrame) -> DataFrame:
    return backups.orderBy(F.col("modified_time").desc(), F.col("name").desc())


def revision_labels(
    revisions: DataFrame,
    keys: tuple[str, ...] = ("file_id",),
    listed: str | None = None,
) -> DataFrame:
    """Number revisions from the newest: 'Latest', then 'Rev ~1', ...

    `listed` names the column with the place in the store's own listing, which
    runs from the oldest; it then decides, and times do not.  Without it the time
    does, and revisions without a time are the oldest.
    """
    order = ("modified_time", "id") if listed is None else (listed,)
    back = F.col("_at") - 1
    return (
        ranked(revisions, keys, "_at", order)
        .withColumns(
            {
                "revision": back,
                "label": F.when(back == 0, "Latest").otherwise(F.concat(F.lit("Rev ~"), back.cast("string"))),
                "marker": F.when(F.col("keep_forever"), "[kept]").otherwise(""),
            }
        )
        .drop("_at")
    )


# -- retention ----------------------------------------------------------------
def retention(
    backups: DataFrame,
    keys: tuple[str, ...] = ("location",),
    keep: int = KEEP_BACKUPS,
    dotted: bool = False,
) -> DataFrame:
    """Archives with their rank from the newest and whether they may go."""
    eligible = backups.filter(is_plain_archive(F.col("name"), dotted))
    return ranked(eligible, keys, "newest_rank").withColumn("delete", F.col("newest_rank") > keep)


def snapshots(files: DataFrame, keys: tuple[str, ...] = ("target",)) -> DataFrame:
    """One row per snapshot: time from its name, size, newest mark.

    Only names of the snapshot form count.  Snapshots are one row each by now,
    so ranking them per target is small.
    """
    sized = (
        files.filter(F.col("snapshot").rlike(SNAPSHOT_NAME))
        .groupBy(*keys, "snapshot")
        .agg(F.sum("size_bytes").alias("size_bytes"), F.count(F.lit(1)).alias("n_files"))
    )
    newest = sized.groupBy(*keys).agg(F.max("snapshot").alias("_newest"))
    return (
        sized.join(newest, list(keys))
        .withColumns(
            {
                "taken_at": F.try_to_timestamp("snapshot", F.lit(SNAPSHOT_TIME)),
                "is_latest": F.col("snapshot") == F.col("_newest"),
            }
        )
        .drop("_newest")
    )


def snapshots_to_drop(
    listed: DataFrame, keys: tuple[str, ...] = ("target",), keep: int = KEEP_SNAPSHOTS
) -> DataFrame:
    """Snapshots past the newest ones.

    Names sort by time, so the day in the name cuts the order into slices.
    """
    order = SlicedOrder(keys, {"_day": F.substring("snapshot", 1, 10)}, ("snapshot",), newest_first=True)
    return order.position(listed, "newest_rank").filter(F.col("newest_rank") > keep)


def calendar_retention(
    backups: DataFrame,
    now: Column,
    keys: tuple[str, ...] = ("destination",),
    last: int = 0,
    daily: int = 0,
    weekly: int = 0,
    monthly: int = 0,
    max_age_days: int | None = None,
) -> DataFrame:
    """Add `keep`: newest N, or newest of the last N days, weeks or months.

    A backup older than the age limit goes whatever else would keep it.  The
    newest of each day, week and month comes from one aggregate; only one row
    per period is ranked.
    """
    periods = [(unit, count) for unit, count in (("day", daily), ("week", weekly), ("month", monthly)) if count > 0]
    kept = None
    if periods:
        each = F.array(
            *[
                F.struct(
                    F.lit(unit).alias("unit"),
                    F.date_trunc(unit, F.col("modified_time")).alias("starts"),
                    F.lit(count).alias("most"),
                )
                for unit, count in periods
            ]
        )
        newest_period = Window.partitionBy(*keys, "p.unit").orderBy(F.col("p.starts").desc())
        kept = (
            backups.select(*keys, "modified_time", "name", F.explode(each).alias("p"))
            .groupBy(*keys, "p")
            .agg(F.max(F.struct("modified_time", "name")).alias("_s"))
            .withColumn("_rank", F.row_number().over(newest_period))
            .filter(F.col("_rank") <= F.col("p.most"))
            .select(*keys, "_s.modified_time", "_s.name")
        )
    if last > 0:
        newest = _newest(backups, keys, last, "name", "_rank").select(*keys, "modified_time", "name")
        kept = newest if kept is None else kept.unionByName(newest)
    if kept is None:
        flagged = backups.withColumn("keep", F.lit(True))
    else:
        chosen = kept.distinct().withColumn("_keep", F.lit(True))
        flagged = (
            backups.join(chosen, [*keys, "modified_time", "name"], "left")
            .withColumn("keep", F.col("_keep").isNotNull())
            .drop("_keep")
        )
    if max_age_days is not None:
        young = F.col("modified_time") >= now - F.make_interval(days=F.lit(max_age_days))
        flagged = flagged.withColumn("keep", F.col("keep") & young)
    return flagged


# -- status and manifests -----------------------------------------------------
def backup_status(runs: DataFrame, now: Column, keys: list[str]) -> DataFrame:
    """Last run of each instance: time, size, success and age in seconds."""
    latest_run = F.struct("finished_at", "size_bytes", "success")
    return (
        runs.groupBy(*keys)
        .agg(F.max(latest_run).alias("_r"), F.max(F.when(F.col("success"), F.col("finished_at"))).alias("last_success"))
        .select(
            *keys,
            F.col("_r.finished_at").alias("last_run"),
            F.col("_r.size_bytes").alias("size_bytes"),
            F.col("_r.success").alias("success"),
            "last_success",
            (F.unix_seconds(now) - F.unix_seconds(F.col("_r.finished_at").cast("timestamp"))).alias("age_seconds"),
        )
    )


def backup_manifest(
    contents: DataFrame, keys: list[str], retention_class: Column, created_at: Column
) -> DataFrame:
    """One row per backup: size, file count and a checksum of its contents.

    The checksum adds up per-file digests, so it does not depend on order and a
    backup of any size needs no gathering.  The contents list stays a table.
    """
    digest = F.sha2(F.concat_ws("\u0001", "path", "sha256", F.col("size_bytes").cast("string")), 256)
    high = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
    low = F.conv(F.substring(digest, 16, 15), 16, 10).cast("decimal(38,0)")
    return (
        contents.withColumns({"_hi": high, "_lo": low})
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.sum("size_bytes").alias("size_bytes"),
            F.sum("_hi").alias("_hi"),
            F.sum("_lo").alias("_lo"),
        )
        .select(
            *keys,
            "n_files",
            "size_bytes",
            F.sha2(F.concat_ws(":", F.col("_hi").cast("string"), F.col("_lo").cast("string")), 256).alias("checksum"),
            retention_class.alias("retention_class"),
            created_at.alias("created_at"),
        )
    )


def upsert_by_name(catalog: DataFrame, incoming: DataFrame, new_id: Column) -> DataFrame:
    """Catalog after an upload: a known name keeps its id, a new one gets `new_id`.

    Of several live entries with the name the first id is the one updated.
    Entries marked `trashed` are not live, and where both sides have a `folder`
    only entries of the same folder are.
    """
    keys = ["name"] + ["folder"] * ("folder" in catalog.columns and "folder" in incoming.columns)
    live = catalog.filter(~F.coalesce("trashed", F.lit(False))) if "trashed" in catalog.columns else catalog
    live = live.groupBy(*keys).agg(F.min("id").alias("_id"))
    targeted = incoming.join(live, keys, "left").withColumns(
        {
            "action": F.when(F.col("_id").isNull(), "create").otherwise("update"),
            "id": F.coalesce("_id", new_id),
        }
    )
    untouched = catalog.join(targeted.select("id"), "id", "left_anti").withColumn("action", F.lit("keep"))
    columns = ["id", "name", "modified_time", "size_bytes", "action"]
    return untouched.select(*columns).unionByName(targeted.select(*columns))
