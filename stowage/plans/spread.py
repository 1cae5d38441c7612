"""Lookups and containment that stay balanced when one key is everywhere.

Lookups are plain joins: Spark picks a broadcast when the lookup's measured size allows
it, and otherwise splits the partitions that turn out skewed (`session.RUNTIME_SETTINGS`),
so the side with a hot key is dealt over tasks and only the lookup's rows of that key
are read again.

Containment is a sweep.  Whatever lies below a folder stands in one stretch of the order
of paths, from "folder/" to "folder0", the next text after all that begin so.  Folders
open stretches, and a path is covered if the farthest end of those opened so far lies
behind it: a running maximum, which slices of the order compute on their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions import paths
from stowage.plans.sliced import by_range

#: Behind every path.
_LAST = chr(0x10FFFF) * 2


def spread_semi(large: DataFrame, lookup: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """Semi or anti join, large side left."""
    return large.join(lookup.select(*on).distinct(), on, how)


def spread_flag(large: DataFrame, lookup: DataFrame, on: list[str], flag: str) -> DataFrame:
    """Add a boolean that says whether the lookup holds the row's key."""
    keys = lookup.select(*on).distinct().withColumn(flag, F.lit(True))
    return large.join(keys, on, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def spread_lookup(large: DataFrame, lookup: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join one lookup row to every row of the large side."""
    return large.join(lookup, on, how)


def covered(
    df: DataFrame,
    path: str,
    folders: DataFrame,
    keys: list[str],
    flag: str,
    include_top: bool = False,
    directories_of: DataFrame | None = None,
) -> DataFrame:
    """Flag rows whose path lies strictly below one of the given folders.

    `folders` has the key columns and the path column; `directories_of` is a cheaper
    table with at least the same directories.  Distinct directories, far fewer than
    paths, go through the sweep together with the folders: one range shuffle over both.
    With `include_top` the folder '' covers every path.  Null paths and keys are neither
    covered nor cover anything.
    """
    marked = df.withColumn("_dir", paths.parent(F.col(path)))
    source = df if directories_of is None else directories_of
    points = source.select(*keys, paths.parent(F.col(path)).alias("_dir")).distinct().filter("_dir IS NOT NULL")
    points = points.select(
        *keys, F.concat("_dir", F.lit("/")).alias("_at"), F.lit(1).alias("_is_point"), F.lit(None).cast("string").alias("_end"), "_dir"
    )
    named = folders.select(*keys, F.col(path).alias("_folder")).dropna().distinct()
    everything = (F.col("_folder") == "") & F.lit(include_top)
    opened = named.select(
        *keys,
        F.when(everything, "").otherwise(F.concat("_folder", F.lit("/"))).alias("_at"),
        F.lit(0).alias("_is_point"),
        F.when(everything, _LAST).otherwise(F.concat("_folder", F.lit("0"))).alias("_end"),
        F.lit(None).cast("string").alias("_dir"),
    )
    order, events = by_range(points.unionByName(opened), tuple(keys), ("_at", "_is_point"))
    swept = order.running_max(events, "_farthest", F.col("_end"))
    hit = swept.filter((F.col("_is_point") == 1) & (F.col("_farthest") > F.col("_at"))).select(*keys, "_dir")
    return spread_flag(marked, hit, [*keys, "_dir"], flag).drop("_dir")


def ancestors_with_counts(
    df: DataFrame, keys: list[str], path: str, sums: dict[str, Column]
) -> DataFrame:
    """Sum per folder over everything below it, the root ('') included.

    Rows are first added up per direct folder, so only one row per folder is
    repeated for its ancestors.
    """
    direct = (
        df.withColumn("_dir", paths.parent(F.col(path)))
        .groupBy(*keys, "_dir")
        .agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    )
    return (
        direct.withColumn(
            "folder",
            F.explode(paths.ancestors(F.col("_dir"), include_self=True, include_top=True)),
        )
        .groupBy(*keys, "folder")
        .agg(*[F.sum(n).alias(n) for n in sums])
    )
