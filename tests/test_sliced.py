"""Sliced computations against a plain loop, with one group that holds a third."""

import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from frames import rows
from stowage.plans import spread
from stowage.plans.sliced import SlicedOrder, by_number, by_range


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    data, places = [], rng.sample(range(-500, 5000), 900)
    for i, at in enumerate(places):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        data.append((key, at, rng.randrange(100)))
    return data, spark.createDataFrame(data, "k string, at long, v long")


def grouped(data):
    groups = defaultdict(list)
    for key, at, value in sorted(data, key=lambda r: (r[0], r[1])):
        groups[key].append((at, value))
    return groups


@pytest.mark.parametrize("width", [1, 7, 100, 100_000])
def test_running_sum(skewed, width):
    data, df = skewed
    order = SlicedOrder(("k",), by_number("at", width), ("at",))
    want_in, want_ex = [], []
    for key, items in grouped(data).items():
        total = 0
        for at, value in items:
            want_ex.append((key, at, total))
            total += value
            want_in.append((key, at, total))
    assert rows(order.running(df, {"s": F.col("v")}), "k", "at", "s") == sorted(want_in, key=lambda t: tuple(map(str, t)))
    got = rows(order.running(df, {"s": F.col("v")}, inclusive=False), "k", "at", "s")
    assert got == sorted(want_ex, key=lambda t: tuple(map(str, t)))


@pytest.mark.parametrize("newest_first", [False, True])
def test_position_and_previous(skewed, newest_first):
    data, df = skewed
    order = SlicedOrder(("k",), by_number("at", 16), ("at",), newest_first=newest_first)
    want_pos, want_prev = [], []
    for key, items in grouped(data).items():
        walked = items[::-1] if newest_first else items
        before = None
        for number, (at, value) in enumerate(walked, 1):
            want_pos.append((key, at, number))
            want_prev.append((key, at, before))
            before = value
    key = lambda t: tuple(map(str, t))
    assert rows(order.position(df), "k", "at", "position") == sorted(want_pos, key=key)
    assert rows(order.previous(df, {"p": F.col("v")}), "k", "at", "p") == sorted(want_prev, key=key)


def test_groups_within_a_size(skewed):
    data, df = skewed
    order = SlicedOrder(("k",), by_number("at", 50), ("at",))
    small, large = order.within(df, 100)
    sizes = {k: len(v) for k, v in grouped(data).items()}
    assert rows(large) == [("hot", sizes["hot"])]
    assert small.count() == len(data) - sizes["hot"]
    assert small.filter("k = 'hot'").count() == 0


def test_no_exchange_is_on_the_group_alone_for_the_rows(skewed):
    _, df = skewed
    order = SlicedOrder(("k",), by_number("at", 16), ("at",))
    plan = order.running(df, {"s": F.col("v")})._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(k" in line]
    # Only the per-slice totals are ever gathered by the group alone.
    alone = [line for line in wide if "_slice" not in line]
    assert len(alone) == 1 and len(wide) > 1


def largest_share(df, columns, parts=24):
    dealt = df.repartition(parts, *columns).groupBy(F.spark_partition_id().alias("p")).count()
    counts = [r["count"] for r in dealt.collect()]
    return max(counts) / sum(counts)


def test_a_group_with_a_third_of_the_rows_is_spread(spark):
    hot = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5000))
    df = spark.range(60_000).select(hot.alias("k"), F.col("id").alias("at"))
    order = SlicedOrder(("k",), by_number("at", 500), ("at",))
    assert largest_share(df, ["k"]) > 1 / 3
    assert largest_share(order.sliced(df), order.group) < 0.12


def test_spread_joins_equal_plain_joins(skewed, spark):
    data, df = skewed
    lookup = spark.createDataFrame([("hot", 1), ("k3", 2), ("none", 3)], "k string, w int")
    want = sorted(r for r in data if r[0] in ("hot", "k3"))
    got = spread.spread_semi(df, lookup, ["k"])
    assert sorted(map(tuple, got.collect())) == want
    left = spread.spread_semi(df, lookup, ["k"], how="left_anti")
    assert left.count() == len(data) - len(want)
    flagged = spread.spread_flag(df, lookup, ["k"], "seen")
    assert flagged.count() == len(data) and flagged.filter("seen").count() == len(want)
    joined = spread.spread_lookup(df, lookup, ["k"], how="inner")
    assert joined.count() == len(want)


def test_containment_agrees_with_prefixes(spark):
    rng = random.Random(3)
    names = sorted({"/".join(rng.choice("abcd") * rng.randint(1, 2) for _ in range(rng.randint(1, 4))) for _ in range(300)})
    folders = rng.sample(names, 15)
    df = spark.createDataFrame([(n,) for n in names], "path string")
    chosen = spark.createDataFrame([(f,) for f in folders], "path string")
    flagged = spread.covered(df, "path", chosen, [], "below")
    got = {r.path for r in flagged.filter("below").collect()}
    assert got == {n for n in names if any(n.startswith(f + "/") for f in folders)}
    everything = spread.covered(df, "path", spark.createDataFrame([("",)], "path string"), [], "below", include_top=True)
    assert everything.filter("NOT below").count() == 0


def test_hot_keys_of_a_lookup_are_split(spark):
    """A third of all rows have one key: the join's plan reads its partition in several tasks."""
    hot = F.when(F.col("id") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("id") % 5000)
    df = spark.range(200_000).select(hot.alias("k"), F.col("id").alias("at"), F.expr("repeat(uuid(), 4)").alias("pad"))
    lookup = spark.range(-1, 5000).select(F.col("id").alias("k"))
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1m",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        joined = spread.spread_flag(df, lookup, ["k"], "seen").groupBy(F.spark_partition_id().alias("p")).count()
        counts = [r["count"] for r in joined.collect()]
    finally:
        for key in small:
            spark.conf.unset(key)
    assert sum(counts) == 200_000 and max(counts) < 40_000


def test_containment_of_odd_paths(spark):
    """Nested and repeated folders, names that begin alike, absolute paths, nulls, several keys."""
    paths_ = [("k", p) for p in ("a/b", "a/bc/d", "a/b/c", "a.b/c", "a0/x", "a", "/x/y", "/x", "x/y", "é/漢/z", None)] + [("m", "a/b/c")]
    df = spark.createDataFrame(paths_, "k string, path string").repartition(3)
    chosen = [("k", "a/b"), ("k", "a"), ("k", "a"), ("k", "/x"), ("k", "é"), ("k", None), ("n", "a"), (None, "a")]
    flagged = spread.covered(df, "path", spark.createDataFrame(chosen, "k string, path string"), ["k"], "below")
    got = sorted((r.k, r.path) for r in flagged.filter("below").collect())
    assert got == sorted([("k", "a/b"), ("k", "a/bc/d"), ("k", "a/b/c"), ("k", "/x/y"), ("k", "é/漢/z")])
    assert flagged.count() == len(paths_) and flagged.filter("below IS NULL").isEmpty()


def test_running_maximum(spark):
    rng = random.Random(8)
    data = [(g, i, rng.choice([None, rng.randint(0, 100 + i)])) for g in "ab" for i in range(200)]
    df = spark.createDataFrame(data, "g string, i int, v int").repartition(4)
    got = SlicedOrder(("g",), by_number("i", 30), ("i",)).running_max(df, "top", F.col("v"))
    want, top = [], {}
    for g, i, v in data:
        if v is not None:
            top[g] = max(v, top.get(g, v))
        want.append((g, i, top.get(g)))
    assert rows(got, "g", "i", "top") == sorted(want, key=lambda t: tuple(map(str, t)))


def test_counts_of_ancestors(spark):
    names = ["a/b/x", "a/b/y", "a/z", "w", "c/d/e/f"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = rows(spread.ancestors_with_counts(df, [], "path", {"n": F.lit(1)}))
    assert got == [("", 5), ("a", 3), ("a/b", 2), ("c", 1), ("c/d", 1), ("c/d/e", 1)]


def test_ranges_split_one_key_at_one_instant(spark):
    """200,000 rows of one key and time fall in many slices, none much above its share."""
    df = spark.range(200_000).select(
        F.lit("hot").alias("k"), F.lit(0).alias("at"), F.format_string("%06d", F.col("id")).alias("name")
    )
    df = df.unionByName(spark.createDataFrame([("cold", 1, "a"), ("cold", None, "b")], "k string, at int, name string"))
    order, table = by_range(df, ("k",), ("at", "name"), newest_first=True, parts=16)
    sizes = [r["count"] for r in table.filter("k = 'hot'").groupBy("_range").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 3 * 200_000 / 16
    placed = order.position(table).cache()
    assert placed.filter("k = 'hot' AND position <> 200000 - cast(name AS long)").isEmpty()
    assert rows(placed.filter("k = 'cold'"), "name", "position") == [("a", 1), ("b", 2)]
    placed.unpersist()


def test_ranges_of_an_empty_table(spark):
    order, table = by_range(spark.createDataFrame([], "k string, at long"), ("k",), ("at",))
    assert order.position(table).count() == 0


def test_tables_between_steps_can_be_dropped(spark, tmp_path, monkeypatch):
    from stowage import session

    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    assert session.through_table(spark.range(3), "three").count() == 3
    assert [p.name.startswith("tables-") for p in tmp_path.iterdir()] == [True]
    session.drop_tables(spark)
    assert not list(tmp_path.iterdir())
