"""Mixing sources to target weights by entropy balancing.

Document i of source s is taken r_i times on average, and the rates of a source
have to meet one token constraint: sum of r_i * size_i = target of s.  Of all
rates between 0 and CAP that do, entropy balancing takes those closest to one in
relative entropy.  They are an exponential tilt of the size,

    r_i = min(CAP, exp(lambda_s * size_i / mean size of s)),

where lambda_s solves the convex dual.  The dual's gradient and its slope are
sums over documents, so every Newton step is one distributed aggregation for all
sources at once.  A bracket around the root keeps a step that would leave it
inside, by halving.

All documents of one source and size share a rate, so the sums run over cells
(source, size, number of documents).  Copies are whole numbers whose running
total follows the running total of the rates, through the cells of a source in
order of size: copies = floor(sum so far) - floor(sum before).  As sizes rise
along that order, the words a source gives differ from its target by less than
the size of its largest document.

Only DataFrame operations.  Nothing is ordered over a whole source but its
cells; the documents of a cell are dealt over as many buckets as it needs.

Defined cases: a null text counts as empty; a text without words has size zero
and is taken zero times.  A null source is a source, last in order.  Rows that
repeat an id are documents of their own; which of them is taken more often is
decided by their order, and their figures in total are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import free_name, in_order, own_columns, prepared, text_of, through_table, words_of

#: A document is taken at most so many times, a source at most so many times its size.
CAP = 3
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: Newton steps end when every source meets its target to this part of it.
TOLERANCE = 1e-9
MOST_STEPS = 200
#: A bucket of a cell ranks about so many documents in one task.
ROWS_A_BUCKET = 200_000
LEAST_BUCKETS = 16
#: A file of the solver's state holds about so many sources: every file costs processes and a commit.
SOURCES_A_FILE = 50_000


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Add `target` to (source, source_size): shares of all words by weight.

    A target stops at cap times its source's size; what is over goes to the
    others by weight, until none is above.  So every target is the smaller of its
    limit and level * weight with one level for all; sources reach their limits
    in order of limit over weight.  One row a source: a window without a key is
    no bottleneck.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*(F.lit(float(w)) for w in weights))
    weighed = sources.withColumn(
        "weight", F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ).withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = weighed.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("limit_before"),
    )
    # The level if all sources before this one stop at their limits and none after.
    # It holds where this one stays below its own; past the first such it only falls.
    level = (F.col("total") - F.col("limit_before")) / F.col("weight_left")
    open_ = F.when(level * F.col("weight") <= F.col("limit"), level)
    return leveled.withColumn("level", F.max(open_).over(everything)).select(
        "source",
        "source_size",
        F.when(F.col("level").isNull(), F.col("limit"))
        .otherwise(F.least("limit", F.col("level") * F.col("weight")))
        .alias("target"),
    )


def _rate(tilt: Column, scaled: Column, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(tilt * scaled, F.lit(50.0))))


def solve(cells: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, tilt): Newton's method on the dual, all sources at once.

    cells: source, size, n with size > 0; targets: source, target.
    """
    known = cells.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("words"),
        F.sum("n").alias("docs"),
        F.min("size").alias("least"),
    )
    ratio = F.col("target") / F.col("words")
    mean = F.col("words") / F.col("docs")
    # At the upper end of the bracket every rate is at the cap; at the lower end
    # even the smallest document's rate is so small that the target is not met.
    state = known.join(targets, known["source"].eqNullSafe(targets["source"])).select(
        known["source"],
        "target",
        mean.alias("mean"),
        F.lit(0.0).alias("tilt"),
        (F.least(F.lit(0.0), F.log(ratio)) * mean / F.col("least") - 1).alias("low"),
        (F.log(F.lit(float(cap))) * mean / F.col("least") + 1).alias("high"),
        (ratio >= cap * (1 - 1e-12)).alias("done"),
    )
    # A target at the limit has no finite solution: all rates are at the cap.
    state = state.withColumn("tilt", F.when(F.col("done"), F.col("high")).otherwise(F.col("tilt")))
    files = -(-targets.count() // SOURCES_A_FILE) or 1
    state = through_table(state.coalesce(files), "mix-state")
    for _ in range(MOST_STEPS):
        if state.filter("NOT done").isEmpty():
            return state.select("source", "tilt", "mean")
        a, s = cells.alias("a"), state.filter("NOT done").alias("s")
        scaled = F.col("size") / F.col("mean")
        rate = _rate(F.col("tilt"), scaled, cap)
        words = F.col("n") * F.col("size") * rate
        sums = (
            a.join(s, F.expr("a.source <=> s.source"))
            .groupBy("s.source")
            .agg(
                F.sum(words).alias("given"),
                F.sum(F.when(rate < cap, words * scaled).otherwise(0.0)).alias("slope"),
            )
        )
        t, g = state.alias("t"), sums.alias("g")
        miss = F.col("g.given") - F.col("target")
        close = F.abs(miss) <= TOLERANCE * F.col("target")
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.when(F.col("g.slope") > 0, F.col("tilt") - miss / F.col("g.slope"))
        inside = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        still = (high - low) <= 1e-13 * F.greatest(F.abs(low), F.abs(high), F.lit(1.0))
        open_ = F.col("g.given").isNotNull()
        state = through_table(
            t.join(g, F.expr("t.source <=> g.source"), "left").select(
                F.col("t.source").alias("source"),
                "target",
                "mean",
                F.when(open_ & ~close, inside).otherwise(F.col("tilt")).alias("tilt"),
                F.when(open_, low).otherwise(F.col("low")).alias("low"),
                F.when(open_, high).otherwise(F.col("high")).alias("high"),
                F.when(open_, close | still).otherwise(F.lit(True)).alias("done"),
            ).coalesce(files),
            "mix-state",
        )
    raise RuntimeError("the dual did not settle")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    cap: int = CAP,
) -> DataFrame:
    """One row a row of docs: doc_id, source, size, source_size, target, rate, copies, taken."""
    prepared(docs.sparkSession)
    sizes = through_table(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            F.col(f"`{source_col}`").cast("string").alias("source"),
            words_of(text_of(F.col(f"`{text_col}`"))).alias("size"),
        ),
        "mix-sizes",
    )
    # No more files than the rows they count are read in.
    counted = sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    cells = through_table(counted.coalesce(max(1, sizes.rdd.getNumPartitions())), "mix-cells")
    targets = through_table(
        source_targets(
            cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, cap
        ),
        "mix-targets",
    )
    tilts = solve(cells.filter("size > 0"), targets, cap)

    c, t, g = cells.alias("c"), tilts.alias("t"), targets.alias("g")
    rate = _rate(F.col("tilt"), F.col("size") / F.col("mean"), cap)
    so_far = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = (
        c.join(g, F.expr("c.source <=> g.source"))
        .join(t, F.expr("c.source <=> t.source"), "left")
        .select("c.source", "size", "n", "source_size", "target", F.when(F.col("size") > 0, rate).otherwise(0.0).alias("rate"))
        .select(
            "source", "size", "source_size", "target", "rate",
            F.coalesce(F.sum(F.col("n") * F.col("rate")).over(so_far), F.lit(0.0)).alias("sum_before"),
            F.greatest(F.lit(LEAST_BUCKETS), F.ceil(F.col("n") / ROWS_A_BUCKET)).cast("long").alias("buckets"),
        )
    )
    d, r = sizes.alias("d"), rated.alias("r")
    # The documents' sizes are a small file of many rows, which Spark would broadcast by the file's size.
    placed = d.hint("merge").join(r, F.expr("d.source <=> r.source AND d.size = r.size")).select(
        "d.doc_id", "d.source", "d.size", "source_size", "target", "rate", "sum_before",
        F.pmod(F.xxhash64("d.doc_id"), "buckets").alias("bucket"),
    )
    in_bucket = Window.partitionBy("source", "size", "bucket").orderBy("doc_id")
    earlier = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    starts = starts.select(
        "source", "size", "bucket", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before")
    )
    p = placed.withColumn("place", F.row_number().over(in_bucket)).alias("p")
    b = starts.alias("b")
    place = F.col("place") + F.col("rows_before")
    # A half keeps the running total centred on that of the rates.
    upto = F.floor(F.col("sum_before") + place * F.col("rate") + 0.5)
    before = F.floor(F.col("sum_before") + (place - 1) * F.col("rate") + 0.5)
    copies = F.least(F.lit(cap), F.greatest(F.lit(0), upto - before)).cast("int")
    columns = ["doc_id", "source", "size", "source_size", "target"]
    return p.join(b, F.expr("p.source <=> b.source AND p.size = b.size AND p.bucket = b.bucket")).select(
        *(F.col(f"p.{x}").alias(x) for x in ("doc_id", "source", "size", "source_size", "target", "rate")),
        copies.alias("copies"),
        (F.col("p.size") * copies).alias("taken"),
    )


def mixed_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how: object
) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all columns of docs.

    Rows that share id, source and size are dealt their copies evenly: each gets
    the whole part of their average, and the first in order of all columns the rest.
    """
    taken = mix(docs, id_col, text_col, source_col, **how)
    name, n_copies, n_rows, rank, copy = (free_name(docs, stem) for stem in ("key", "copies", "rows", "rank", "copy"))
    found = taken.groupBy(
        F.struct(F.col("doc_id").alias("id"), F.col("source").alias("source"), F.col("size").alias("size")).alias(name)
    ).agg(F.sum("copies").alias(n_copies), F.count(F.lit(1)).alias(n_rows))
    key = F.struct(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        words_of(text_of(F.col(f"`{text_col}`"))).alias("size"),
    )
    joined = docs.withColumn(name, key).join(found.filter(F.col(n_copies) > 0), name)
    place = F.row_number().over(Window.partitionBy(name).orderBy(*in_order(docs)))
    each = F.floor(F.col(n_copies) / F.col(n_rows)) + F.when(
        F.col(rank) <= F.col(n_copies) % F.col(n_rows), 1
    ).otherwise(0)
    return (
        joined.withColumn(rank, place)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.greatest(each.cast("int"), F.lit(1)))))
        .filter(each > 0)
        .select(*own_columns(docs))
    )
