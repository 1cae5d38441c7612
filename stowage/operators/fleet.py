"""Checks and reports over declared instances, tunnels and their state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.plans import spread
from stowage.plans.sliced import SlicedOrder, by_number, by_time
from stowage.sources.logs import connections

# ---- fixed values -----------------------------------------------------------
DOWN_SECONDS = 300
CPU_LIMIT, MEMORY_LIMIT, DISK_LIMIT = 90.0, 85.0, 80.0
# ---- end of fixed values ----------------------------------------------------


# -- inventory checks ---------------------------------------------------------
def duplicates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Values that should be unique and are not, with how often they occur."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def dangling(rows: DataFrame, referenced: DataFrame, column: str, key: str) -> DataFrame:
    """Rows that name something which does not exist."""
    known = referenced.select(F.col(key).alias(column)).distinct()
    return rows.join(known, column, "left_anti")


def with_default(rows: DataFrame, default: DataFrame, key: str = "name") -> DataFrame:
    """Rows with the default in front, unless they name it themselves."""
    absent = default.join(rows.select(key).distinct(), key, "left_anti")
    return absent.withColumn("is_default", F.lit(True)).unionByName(
        rows.withColumn("is_default", F.lit(False))
    )


def instances_per_tunnel(
    instances: DataFrame, tunnels: DataFrame, order: str = "ord", width: int = 50_000
) -> DataFrame:
    """Instances of each known tunnel with their place in inventory order.

    One row per rule rather than one list per tunnel, so a tunnel may have any
    number of instances.
    """
    known = spread.spread_semi(instances, tunnels.select(F.col("name").alias("tunnel")), ["tunnel"])
    return SlicedOrder(("tunnel",), by_number(order, width), (order,)).position(known, "rule_no")


def validate_instances(instances: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Problems of declared instances, one row each: type, name, problem.

    `instances` has type, name, port and image; `dependencies` has type and
    needs, a type of which at least one instance must exist.
    """
    out = ["type", "name", "problem"]

    def problem(df: DataFrame, text: str) -> DataFrame:
        return df.withColumn("problem", F.lit(text)).select(*out)

    twice = duplicates(instances.filter("name IS NOT NULL"), ["type", "name"])
    ports = (
        instances.filter("port IS NOT NULL")
        .groupBy("port")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .withColumns(
            {"type": F.lit(None).cast("string"), "name": F.concat(F.lit("port "), F.col("port").cast("string"))}
        )
    )
    present = instances.select(F.col("type").alias("needs")).distinct()
    types = instances.select("type").distinct()
    lacking = dependencies.join(types, "type", "left_semi").join(present, "needs", "left_anti").select(
        "type", F.col("needs").alias("name")
    )
    tag = F.regexp_extract("image", r":([^:/]+)$", 1)
    floating = (F.col("image").isNotNull()) & (tag.isin("", "latest"))
    bad_name = F.col("name").isNotNull() & ~F.col("name").rlike("^[a-z0-9-]+$")
    return (
        problem(twice, "duplicate name")
        .unionByName(problem(ports, "port used twice"))
        .unionByName(problem(instances.filter("name IS NULL OR port IS NULL"), "field missing"))
        .unionByName(problem(instances.filter(bad_name), "bad name"))
        .unionByName(problem(instances.filter(floating), "floating image tag"))
        .unionByName(problem(lacking, "dependency missing"))
    )


def version_drift(declared: DataFrame, deployed: DataFrame, keys: list[str]) -> DataFrame:
    """Instances whose deployed image is not the declared one."""
    d = declared.select(*keys, F.col("image").alias("declared_image"))
    r = deployed.select(*keys, F.col("image").alias("deployed_image"))
    return (
        d.join(r, keys, "full_outer")
        .filter(~F.col("declared_image").eqNullSafe(F.col("deployed_image")))
        .withColumn(
            "drift",
            F.when(F.col("deployed_image").isNull(), "not deployed")
            .when(F.col("declared_image").isNull(), "not declared")
            .otherwise("version"),
        )
    )


def orphan_volumes(volumes: DataFrame, attached: DataFrame) -> DataFrame:
    """Volumes no running instance uses."""
    return volumes.join(attached.select("volume").distinct(), "volume", "left_anti")


# -- tunnel health ------------------------------------------------------------
def tunnel_status(tunnels: DataFrame, units: DataFrame, scrapes: DataFrame) -> DataFrame:
    """State of each tunnel: unit state and a metrics summary.

    `units` has name, active_state and sub_state; `scrapes` has name, body and
    error.  A tunnel without a metrics port is not ok, whatever was scraped.
    """
    read = scrapes.select("name", connections(F.col("body")).alias("_n"), "body", "error")
    has_port = F.coalesce(F.col("metrics_port") != 0, F.lit(False))
    unknown = F.lit("unknown")
    return (
        tunnels.join(units, "name", "left")
        .join(read, "name", "left")
        .select(
            "name",
            F.coalesce("active_state", unknown).alias("active_state"),
            F.coalesce("sub_state", unknown).alias("sub_state"),
            (has_port & F.col("body").isNotNull()).alias("metrics_ok"),
            F.when(has_port, F.format_string("http://localhost:%d/metrics", F.col("metrics_port"))).alias(
                "metrics_url"
            ),
            F.when(~has_port, F.lit("no metrics_port configured"))
            .when(F.col("body").isNotNull(), F.format_string("%d HA conns", F.col("_n")))
            .otherwise(F.concat(F.lit("unreachable: "), F.coalesce("error", F.lit("no answer"))))
            .alias("extra"),
        )
    )


# -- alerts -------------------------------------------------------------------
def outages(
    samples: DataFrame,
    keys: tuple[str, ...],
    until: Column | None = None,
    longer_than: int = DOWN_SECONDS,
    slice_seconds: int = 3600,
    tie: str = "sample_id",
    stage: Callable[[DataFrame, str], DataFrame] = lambda df, label: df,
) -> DataFrame:
    """Stretches in which a target was down for longer than the limit.

    `samples` has the keys, ts, `tie` (unique) and up.  A stretch starts at the
    first down sample and ends at the next up sample, or lasts until the target's
    last sample.  Only changes of state go into the second pass; `stage` may
    store them, since that pass reads them twice.
    """
    ts = F.col("ts").cast("timestamp")
    timed = samples.select(*keys, ts.alias("ts"), tie, "up")
    slices = by_time("ts", slice_seconds)
    forward = SlicedOrder(keys, slices, ("ts", tie))
    compared = forward.previous(timed, {"_was": F.col("up")})
    changed = F.col("_was").isNull() | (F.col("_was") != F.col("up"))
    changes = stage(compared.filter(changed).drop("_was"), "changes")
    backward = SlicedOrder(keys, slices, ("ts", tie), newest_first=True)
    starts = backward.previous(changes, {"ended_at": F.col("ts")}).filter("NOT up")
    last = timed.groupBy(*keys).agg(F.max("ts").alias("_last"))
    closed = starts.join(last, list(keys), "left").withColumn(
        "ended_at", F.coalesce("ended_at", until if until is not None else F.col("_last"))
    )
    return (
        closed.withColumn(
            "down_micros", F.unix_micros("ended_at") - F.unix_micros("ts")
        )
        .filter(F.col("down_micros") > longer_than * 1_000_000)
        .select(*keys, F.col("ts").alias("started_at"), "ended_at", "down_micros")
    )


def resource_alerts(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Readings above their limit, one row per instance and resource."""
    limits = F.array(
        *[
            F.struct(F.lit(name).alias("resource"), F.col(name).cast("double").alias("reading"), F.lit(cap).alias("cap"))
            for name, cap in (("cpu", CPU_LIMIT), ("memory", MEMORY_LIMIT), ("disk", DISK_LIMIT))
        ]
    )
    return (
        samples.select(*keys, F.explode(limits).alias("r"))
        .filter(F.col("r.reading") > F.col("r.cap"))
        .groupBy(*keys, F.col("r.resource").alias("resource"))
        .agg(F.count(F.lit(1)).alias("readings"), F.max("r.reading").alias("highest"))
    )


def stale_backups(status: DataFrame, instances: DataFrame, keys: list[str], max_age_seconds: int) -> DataFrame:
    """Instances whose last good backup is too old, failed or missing."""
    return (
        instances.select(*keys)
        .distinct()
        .join(status, keys, "left")
        .withColumn(
            "problem",
            F.when(F.col("last_run").isNull(), "no backup")
            .when(~F.col("success"), "last backup failed")
            .when(F.col("age_seconds") > max_age_seconds, "backup too old"),
        )
        .filter("problem IS NOT NULL")
        .select(*keys, "problem")
    )
