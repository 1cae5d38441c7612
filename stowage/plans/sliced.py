"""Ordered computations over groups of any size.

A window over one group runs in one task.  Here a group is first cut into
slices that follow its order (a run of positions, an hour, a file block); the
window runs inside a slice, and a table with one row per slice carries totals
or edge values across slice borders.  The large side is shuffled once, on
(group, slice), so a group that holds most of the table still spreads over the
cluster.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.session import through_table


@dataclass(frozen=True)
class SlicedOrder:
    """How a table is grouped, sliced and ordered.

    keys    -- group columns, never null
    slices  -- name -> expression, never null; taken together, in this order,
               they grow with the row order, and no row order crosses a border
    order   -- columns that order the rows inside a slice, without ties
    newest_first -- walk slices and rows from the end
    """

    keys: tuple[str, ...]
    slices: Mapping[str, Column]
    order: tuple[str, ...]
    newest_first: bool = False
    _names: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "_names", tuple(self.slices))

    # -- pieces ---------------------------------------------------------------
    @property
    def group(self) -> list[str]:
        return [*self.keys, *self._names]

    def sliced(self, df: DataFrame) -> DataFrame:
        return df.withColumns(dict(self.slices))

    def _sorted(self, names) -> list[Column]:
        return [F.col(n).desc() if self.newest_first else F.col(n).asc() for n in names]

    def _inside(self):
        return Window.partitionBy(*self.group).orderBy(*self._sorted(self.order))

    def _across(self):
        window = Window.partitionBy(*self.keys) if self.keys else Window.partitionBy(F.lit(0))
        return window.orderBy(*self._sorted(self._names))

    def _attach(self, df: DataFrame, per_slice: DataFrame) -> DataFrame:
        return df.join(per_slice, self.group, "left")

    # -- computations ---------------------------------------------------------
    def running(self, df: DataFrame, sums: Mapping[str, Column], inclusive: bool = True) -> DataFrame:
        """Add running sums of numeric expressions, with or without the row itself."""
        base = self.sliced(df)
        totals = base.groupBy(*self.group).agg(
            *[F.sum(value).alias(f"_t_{name}") for name, value in sums.items()]
        )
        before = self._across().rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(
            *self.group,
            *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        )
        upto = self._inside().rowsBetween(
            Window.unboundedPreceding, Window.currentRow if inclusive else -1
        )
        local = base.withColumns(
            {f"_r_{n}": F.coalesce(F.sum(v).over(upto), F.lit(0)) for n, v in sums.items()}
        )
        return (
            self._attach(local, offsets)
            .withColumns({n: F.col(f"_r_{n}") + F.col(f"_o_{n}") for n in sums})
            .drop(*self._names, *[f"_r_{n}" for n in sums], *[f"_o_{n}" for n in sums])
        )

    def running_max(self, df: DataFrame, name: str, value: Column) -> DataFrame:
        """Add the largest value of an expression over the rows so far, the row included; nulls count for nothing."""
        base = self.sliced(df)
        tops = base.groupBy(*self.group).agg(F.max(value).alias("_top"))
        before = self._across().rowsBetween(Window.unboundedPreceding, -1)
        earlier = tops.select(*self.group, F.max("_top").over(before).alias("_earlier"))
        upto = self._inside().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = base.withColumn("_here", F.max(value).over(upto))
        largest = F.greatest("_here", "_earlier")
        return self._attach(local, earlier).withColumn(name, largest).drop(*self._names, "_here", "_earlier")

    def position(self, df: DataFrame, name: str = "position") -> DataFrame:
        """Add the 1-based position of each row in its group."""
        return self.running(df, {name: F.lit(1).cast("long")})

    def previous(self, df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
        """Add values of the row before in the same group; null on the first."""
        names = list(values)
        base = self.sliced(df).withColumns({f"_v_{n}": v for n, v in values.items()})
        packed = F.struct(*[F.col(f"_v_{n}").alias(n) for n in names])
        pick = F.min_by if self.newest_first else F.max_by
        last = base.groupBy(*self.group).agg(
            pick(packed, F.struct(*[F.col(o) for o in self.order])).alias("_last")
        )
        edges = last.select(*self.group, F.lag("_last").over(self._across()).alias("_edge"))
        inside = self._inside()
        local = base.withColumn("_before", F.lag(packed).over(inside))
        found = F.coalesce(F.col("_before"), F.col("_edge"))
        return (
            self._attach(local, edges)
            .withColumn("_found", found)
            .withColumns({n: F.col(f"_found.{n}") for n in names})
            .drop(*self._names, *[f"_v_{n}" for n in names], "_before", "_edge", "_found")
        )

    def within(self, df: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
        """Split a table into groups of at most `most` rows, and the larger ones.

        The second frame has one row per group that is too large.  What is left
        in the first can be collected per group: its size has a bound.
        """
        base = self.sliced(df)
        counts = base.groupBy(*self.group).agg(F.count(F.lit(1)).alias("_n"))
        per_group = counts.groupBy(*self.keys).agg(F.sum("_n").alias("n_rows"))
        large = per_group.filter(F.col("n_rows") > most)
        marked = counts.join(large.select(*self.keys), list(self.keys), "left_semi").select(*self.group)
        return base.join(marked, self.group, "left_anti").drop(*self._names), large


def _with_nulls_first(slices: str) -> Column:
    """A slice of their own for rows without a position, before all others, as nulls sort."""
    return F.coalesce(F.expr(slices), F.lit(-(1 << 63)).cast("long"))


def by_number(column: str, width: int, name: str = "_slice") -> dict[str, Column]:
    """Slices of `width` consecutive values of an integer column."""
    return {name: _with_nulls_first(f"`{column}` div {int(width)}")}


def by_time(column: str, seconds: int, name: str = "_slice") -> dict[str, Column]:
    """Slices of equal length of a timestamp column."""
    return {name: _with_nulls_first(f"unix_micros(cast(`{column}` as timestamp)) div {int(seconds) * 1_000_000}")}


def by_range(
    df: DataFrame,
    keys: tuple[str, ...],
    order: tuple[str, ...],
    newest_first: bool = False,
    parts: int | None = None,
    name: str = "_range",
) -> tuple[SlicedOrder, DataFrame]:
    """Order and table whose slices are equal shares of the rows, wherever they lie.

    Rows are dealt by sampled borders over keys and the whole order, ties
    included, so neither one key nor one instant fills a task, and a key has at
    most `parts` slices (default: the session's shuffle partitions).  Borders are
    sampled anew by every job, hence the numbered rows are written once; hand the
    returned table, not `df`, to the order's computations.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys, *order).withColumn(name, F.spark_partition_id())
    return SlicedOrder(keys, {name: F.col(name)}, order, newest_first), through_table(dealt, "ranges")
