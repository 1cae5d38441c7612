"""Connected components of links between longs, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import through_table

#: A round halves the depth of trees at least; this many would do for 2^60 links.
MOST_ROUNDS = 64


def _larger_to_least(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours on to the least of its neighbourhood."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("root").alias("v")).distinct()


def _smaller_to_least(links: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours on to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("root"))
    moved = links.join(least, "u").filter("v != root").select(F.col("v").alias("u"), F.col("root").alias("v"))
    return moved.union(least.select("u", F.col("root").alias("v"))).distinct()


def roots(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, root) for every node of links (u, v): root is the least node of its component.

    Every round is written to the shared folder, so nothing is recomputed when an
    executor is lost.  A node that is its own root has no row.
    """
    links = through_table(
        links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label
    )
    state = None
    for _ in range(MOST_ROUNDS):
        links = through_table(_smaller_to_least(_larger_to_least(links)), label)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError("components did not settle")
