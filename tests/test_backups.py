from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from frames import rows
from stowage.operators import catalog, restore
from stowage.sinks import tables
from stowage.sources import listing

T0 = datetime(2026, 1, 1)


def backups(spark, items, location="/b"):
    """items: (name, age in hours)"""
    return spark.createDataFrame(
        [(location, n, T0 - timedelta(hours=h), 10) for n, h in items],
        "location string, name string, modified_time timestamp_ntz, size_bytes long",
    )


def test_latest(spark):
    df = backups(spark, [("a.tar.zst", 3), ("b.tar.zst", 1), ("c.txt", 0), ("v1.2.tar.zst", 2)]).unionByName(
        backups(spark, [("x.txt", 0)], "/none")
    )
    assert rows(catalog.latest(df, ["location"]), "location", "name") == [("/b", "b.tar.zst")]
    assert rows(catalog.latest_matching(df, F.lit("v1"), ["location"]), "name") == [("v1.2.tar.zst",)]
    assert catalog.latest_matching(df, F.lit("zst"), ["location"]).count() == 0
    newest = [r.name for r in catalog.newest_listing(df.filter(catalog.is_archive(F.col("name")))).collect()]
    assert newest == ["b.tar.zst", "v1.2.tar.zst", "a.tar.zst"]


def test_nth(spark):
    df = backups(spark, [(f"{i}.tar.zst", i) for i in range(4)])
    for n in range(5):
        assert rows(catalog.nth_newest(df, ("location",), n), "name") == ([(f"{n}.tar.zst",)] if n < 4 else [])
    with pytest.raises(ValueError):
        catalog.nth_newest(df, ("location",), -1)


def test_rank_limit_runs_before_the_shuffle(spark):
    df = backups(spark, [("a.tar.zst", 1)])
    plan = catalog.nth_newest(df, ("location",), 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_priority(spark):
    df = backups(spark, [("old.tar.zst", 9)], "/first").unionByName(backups(spark, [("new.tar.zst", 1)], "/second"))
    df = df.unionByName(backups(spark, [("n.txt", 0)], "/zero")).withColumn("host", F.lit("h"))
    order = spark.createDataFrame([("/zero", 0), ("/first", 1), ("/second", 2)], "location string, priority int")
    assert rows(catalog.latest_by_priority(df, order, ["host"]), "location", "name") == [("/first", "old.tar.zst")]


@pytest.mark.parametrize(
    ("name", "plain"),
    [("a.tar.zst", True), ("v1.2.tar.zst", False), ("a.zst", False), ("a.tar", False), ("a.tar.zst.bak", False), (".a.tar.zst", True)],
)
def test_plain_archive_names(spark, name, plain):
    from pathlib import PurePosixPath

    assert (PurePosixPath(name).suffixes == [".tar", ".zst"]) is plain
    got = spark.createDataFrame([(name,)], "n string").select(catalog.is_plain_archive(F.col("n"))).first()[0]
    assert got is plain


def test_retention(spark):
    items = [(f"{i:02d}.tar.zst", i) for i in range(8)] + [("v1.2.tar.zst", 50), ("n.txt", 60)]
    df = backups(spark, items)
    gone = catalog.retention(df).filter("`delete`")
    assert rows(gone, "name") == [(f"{i:02d}.tar.zst",) for i in (5, 6, 7)]
    assert catalog.retention(df, keep=100).filter("`delete`").count() == 0
    assert ("v1.2.tar.zst",) in rows(catalog.retention(df, dotted=True).filter("`delete`"), "name")


def test_ranks_beyond_the_map_side_limit(spark):
    """A place past Spark's own rank limit is found through slices, also among equal times."""
    df = spark.range(3000).select(
        F.lit("/a").alias("location"),
        F.format_string("%04d.tar.zst", "id").alias("name"),
        F.lit(T0).alias("modified_time"),
    )
    limit = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    for back in (limit - 1, limit, 2500):
        assert rows(catalog.nth_newest(df, ("location",), back), "name") == [(f"{2999 - back:04d}.tar.zst",)]
    kept = catalog.calendar_retention(df, F.lit(T0), ("location",), last=limit + 500).filter("keep")
    assert kept.count() == limit + 500 and kept.agg(F.min("name")).first()[0] == f"{2500 - limit:04d}.tar.zst"


def test_revision_labels(spark):
    df = spark.createDataFrame(
        [("f", f"r{i}", T0 + timedelta(days=i), i == 1) for i in range(3)],
        "file_id string, id string, modified_time timestamp_ntz, keep_forever boolean",
    )
    got = rows(catalog.revision_labels(df), "revision", "id", "label", "marker")
    assert got == [(0, "r2", "Latest", ""), (1, "r1", "Rev ~1", "[kept]"), (2, "r0", "Rev ~2", "")]


def test_remote_catalog(spark):
    raw = spark.createDataFrame(
        [
            ("1", "site-backup.tar.zst", "2026-01-01T00:00:00.000Z", "10", False, "p"),
            ("2", "old site-backup.tar.zst", "2026-01-02T00:00:00Z", "", False, "p"),
            ("3", "site-backup.tar.zst", "", "x", False, "q"),
            ("4", "site-backup.tar.zst", "2026-01-03T00:00:00Z", "1", True, "p"),
            ("5", "other.tar.zst", "2026-01-03T00:00:00Z", "1", False, "p"),
        ],
        "id string, name string, modifiedTime string, size string, trashed boolean, parent string",
    )
    typed = listing.read_catalog(raw)
    pattern = "site-backup.tar.zst"
    found = listing.remote_backups(typed, pattern).collect()
    assert [(r.id, r.size_bytes) for r in found] == [("2", None), ("1", 10), ("3", None)]
    assert [r.id for r in listing.remote_backups(typed, pattern, "p").collect()] == ["2", "1"]
    assert listing.by_id(typed, "3").first().modified_time is None


def test_local_listing(spark, tmp_path):
    for name in ("a.tar.zst", "b.txt"):
        (tmp_path / name).write_bytes(b"xyz")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.tar.zst").write_bytes(b"x")
    assert rows(listing.read_backups(spark, str(tmp_path)), "name", "size_bytes") == [("a.tar.zst", 3)]


def test_exact_backup_listing(spark, tmp_path):
    """Empty and hidden archives are listed; folders, links and deeper archives are not."""
    for name in ("a.tar.zst", ".hidden.tar.zst", "b.txt"):
        (tmp_path / name).write_bytes(b"xyz")
    (tmp_path / "empty.tar.zst").touch()
    (tmp_path / "sub.tar.zst").mkdir()
    (tmp_path / "sub.tar.zst" / "c.tar.zst").write_bytes(b"x")
    (tmp_path / "link.tar.zst").symlink_to(tmp_path / "a.tar.zst")
    found = listing.backups_in(listing.walk(spark, [str(tmp_path)]))
    assert rows(found, "name", "size_bytes") == [(".hidden.tar.zst", 3), ("a.tar.zst", 3), ("empty.tar.zst", 0)]
    assert {r[0] for r in rows(found, "location")} == {str(tmp_path)}


def test_upsert(spark):
    schema = "id string, name string, modified_time timestamp_ntz, size_bytes long"
    old = spark.createDataFrame([("1", "a", T0, 1), ("2", "a", T0, 2), ("3", "b", T0, 3)], schema)
    new = spark.createDataFrame([("a", T0, 9, "x"), ("c", T0, 8, "y")], "name string, modified_time timestamp_ntz, size_bytes long, new_id string")
    got = rows(catalog.upsert_by_name(old, new, F.col("new_id")), "id", "name", "size_bytes", "action")
    assert got == [("1", "a", 9, "update"), ("2", "a", 2, "keep"), ("3", "b", 3, "keep"), ("y", "c", 8, "create")]


def test_upsert_leaves_trashed_and_other_folders(spark):
    schema = "id string, name string, folder string, trashed boolean, modified_time timestamp_ntz, size_bytes long"
    old = spark.createDataFrame(
        [("a1", "n", "other", False, T0, 1), ("a2", "n", "here", True, T0, 2), ("b2", "n", "here", None, T0, 3)], schema
    )
    new = spark.createDataFrame([("n", "here", T0, 9, "x")], "name string, folder string, modified_time timestamp_ntz, size_bytes long, new_id string")
    got = rows(catalog.upsert_by_name(old, new, F.col("new_id")), "id", "size_bytes", "action")
    assert got == [("a1", 1, "keep"), ("a2", 2, "keep"), ("b2", 9, "update")]


def test_calendar_retention(spark):
    df = spark.createDataFrame(
        [("d", f"b{i:03d}", T0 - timedelta(hours=12 * i), 1) for i in range(200)],
        "destination string, name string, modified_time timestamp_ntz, size_bytes long",
    )
    now = F.lit(T0).cast("timestamp_ntz")

    def kept(**rules):
        return [r[0] for r in rows(catalog.calendar_retention(df, now, **rules).filter("keep"), "name")]

    assert kept(last=3) == ["b000", "b001", "b002"]
    # Noon and midnight of one day: the newest of a day is noon, but for the first.
    assert kept(daily=3) == ["b000", "b001", "b003"]
    assert kept(monthly=2) == ["b000", "b001"]
    assert kept(last=100, max_age_days=2) == [f"b{i:03d}" for i in range(5)]
    assert len(kept()) == 200 and set(kept(last=3, daily=3)) == {"b000", "b001", "b002", "b003"}


def test_snapshots(spark):
    names = [f"2026-01-{d:02d}-120000" for d in range(1, 13)] + ["latest", "2026-01-01-1200"]
    files = spark.createDataFrame([("t", n, i) for i, n in enumerate(names)], "target string, snapshot string, size_bytes long")
    listed = catalog.snapshots(files)
    assert listed.count() == 12 and rows(listed.filter("is_latest"), "snapshot") == [("2026-01-12-120000",)]
    assert str(listed.agg(F.min("taken_at")).first()[0]) == "2026-01-01 12:00:00"
    assert rows(catalog.snapshots_to_drop(listed), "snapshot") == [("2026-01-01-120000",), ("2026-01-02-120000",)]


# -- restore ------------------------------------------------------------------
def tree(spark, items):
    return spark.createDataFrame([(p, s, m, h) for p, s, m, h in items], "path string, size_bytes long, mtime long, sha256 string")


def test_prune(spark):
    def pruned(*paths):
        return [r[0] for r in rows(restore.prune_paths(spark.createDataFrame([(p,) for p in paths], "path string"), []))]

    assert pruned("a", "a/b", "a/b/c", "ab", "x/y") == ["a", "ab", "x/y"]
    assert pruned("x/y", "x/z") == ["x/y", "x/z"]
    assert pruned("a", "a") == ["a"]


def test_select_members(spark):
    members = spark.createDataFrame([(p,) for p in ("d/a", "d/e/b", "de", "f", "g/h")], "path string")
    asked = spark.createDataFrame([("d",), ("f",), ("d/e",), ("gone",)], "path string")
    assert rows(restore.select_members(members, asked, [])) == [("d/a",), ("d/e/b",), ("f",)]


def test_reconcile_partitions_the_paths(spark):
    a = tree(spark, [("both", 1, 1, "x"), ("backup", 1, 1, "x")])
    b = tree(spark, [("both", 2, 2, "y"), ("live", 1, 1, "x")])
    assert rows(restore.reconcile(a, b, []), "path", "action") == [("backup", "restore"), ("both", "overwrite"), ("live", "preserve")]


OLD = [("same", 1, 1, "x"), ("edit", 5, 1, "x"), ("gone", 7, 1, "x")]
NEW = [("same", 1, 1, "x"), ("edit", 6, 2, "y"), ("new", 3, 1, "z")]


def test_diff_and_savings(spark):
    diff = restore.snapshot_diff(tree(spark, OLD), tree(spark, NEW), [], ["size_bytes", "mtime"])
    assert rows(diff) == [("edit", "changed", 6), ("gone", "deleted", 0), ("new", "added", 3), ("same", "unchanged", 1)]
    assert rows(restore.dedup_savings(diff, [])) == [(10, 9, 1)]


@pytest.mark.parametrize(
    ("mode", "want"),
    [
        ("sync", [("edit", "update_target", 5), ("gone", "add_to_target", 7), ("new", "delete_from_target", 0), ("same", "none", 0)]),
        ("copy", [("edit", "update_target", 5), ("gone", "add_to_target", 7), ("new", "none", 0), ("same", "none", 0)]),
        ("bisync", [("edit", "update_source", 6), ("gone", "add_to_target", 7), ("new", "add_to_source", 3), ("same", "none", 0)]),
    ],
)
def test_sync(spark, mode, want):
    plan = restore.sync_plan(tree(spark, OLD), tree(spark, NEW), [], mode)
    assert rows(plan) == want
    status = restore.sync_status(plan, []).first()
    assert status.added + status.modified + status.deleted + status.untouched == len(want)


def test_unknown_sync_mode(spark):
    with pytest.raises(ValueError):
        restore.sync_plan(tree(spark, OLD), tree(spark, NEW), [], "mirror")


def test_sync_filter(spark):
    df = tree(spark, [("a.yml", 10, 0, ""), ("b.tmp", 10, 0, ""), ("big.yml", 99, 0, ""), ("new.yml", 10, 95, "")])
    got = restore.sync_filter(df, ("*.yml", "*.tmp"), ("*.tmp",), 5, 50, min_age=10, max_age=100, now_epoch=F.lit(100))
    assert rows(got, "path") == [("a.yml",)]


def test_status_and_manifest(spark):
    runs = spark.createDataFrame(
        [("i", T0, 5, True), ("i", T0 + timedelta(hours=1), 0, False)],
        "instance string, finished_at timestamp_ntz, size_bytes long, success boolean",
    )
    now = F.lit("2026-01-01 02:00:00").cast("timestamp")
    got = catalog.backup_status(runs, now, ["instance"]).first()
    assert (got.success, got.age_seconds, got.last_success) == (False, 3600, T0)
    content = tree(spark, OLD).withColumn("b", F.lit(1))
    build = lambda df: catalog.backup_manifest(df, ["b"], F.lit("daily"), F.lit("t")).first()
    one, other = build(content), build(content.orderBy(F.col("path").desc()).repartition(3))
    assert one.checksum == other.checksum and (one.n_files, one.size_bytes) == (3, 13)
    assert build(content.withColumn("sha256", F.lit("q"))).checksum != one.checksum


# -- stored tables ------------------------------------------------------------
def test_snapshot_table_and_copies(spark, tmp_path):
    files = tree(spark, [("a.py", 1, 1, "x"), ("__pycache__/a.pyc", 1, 1, "x"), (".git/config", 1, 1, "x")])
    from stowage.functions.globs import DEFAULT_EXCLUSIONS

    path = tables.write_snapshot(files, str(tmp_path / "snaps"), "s1", DEFAULT_EXCLUSIONS)
    assert rows(spark.read.parquet(path), "path") == [("a.py",)]
    assert any(p.name.endswith(".zstd.parquet") for p in (tmp_path / "snaps" / "snapshot=s1").iterdir())
    with pytest.raises(Exception, match="exists"):
        tables.write_snapshot(files, str(tmp_path / "snaps"), "s1")
    whole = tables.write_snapshot(files, str(tmp_path / "snaps"), "s2")
    assert spark.read.parquet(whole).count() == 3
    (tmp_path / "blocked").write_text("a file")
    targets = [str(tmp_path / "one"), str(tmp_path / "blocked" / "x"), str(tmp_path / "two")]
    status = tables.copy_to_all(path, targets, spark)
    assert [r.ok for r in status.collect()] == [True, False, True]
    assert rows(tables.copied_anywhere(status)) == [(True, 2)]
    assert rows(tables.copied_anywhere(status.filter(F.lit(False)))) == [(False, 0)]
    name = spark.range(1).select(tables.snapshot_name("proj", F.lit("2026-04-19 08:12:05").cast("timestamp"))).first()[0]
    assert name == "proj-20260419-081205"


def test_batches_replace_themselves(spark, tmp_path):
    root = str(tmp_path / "t")
    schema = "x long"
    assert tables.read_batches(spark, root, schema).count() == 0
    for batch, n in ((0, 3), (1, 4), (1, 2)):
        tables.write_batch(spark.range(n).withColumnRenamed("id", "x"), root, batch)
    assert tables.read_batches(spark, root, schema).count() == 5
    assert tables.read_batches(spark, root, schema, before=1).count() == 3
