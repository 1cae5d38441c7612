import hashlib
import os

import pytest
from pyspark.sql import functions as F

from frames import rows
from stowage.operators import inventory
from stowage.schemas import PREFLIGHT_STATUSES, Limits
from stowage.sources import listing

NOW = 1_000_000.0


def files(spark, items, root="/r", root_ord=0):
    """items: path -> content or (content, age in seconds)."""
    data = []
    for path, value in items.items():
        content, age = value if isinstance(value, tuple) else (value, 0)
        data.append((root, root_ord, path, len(content), NOW - age, bytearray(content)))
    return spark.createDataFrame(
        data, "root string, root_ord int, relative_path string, size_bytes long, mtime double, content binary"
    )


def test_preflight_order_and_details(spark):
    df = files(
        spark,
        {
            "ok.log": b"ok",
            "bad.exe": b"\x00" * 100,
            "big.log": b"\x00" * 100,
            "nul.log": b"a\x00b",
            "late.log": b"aaaaaaaa\x00",
            "empty.log": b"",
        },
    )
    checked = inventory.preflight(df, Limits(max_file_bytes=50, probe_bytes=8))
    got = {r.relative_path: (r.preflight, r.toggleable, r.reject_detail is None) for r in checked.collect()}
    assert got == {
        "ok.log": ("ok", True, True),
        "bad.exe": ("ext_not_allowed", False, False),
        "big.log": ("file_too_large", False, False),
        "nul.log": ("not_text", False, False),
        "late.log": ("ok", True, True),
        "empty.log": ("ok", True, True),
    }
    assert {v[0] for v in got.values()} == set(PREFLIGHT_STATUSES)
    assert rows(inventory.preview(checked)) == [(3, 6)]
    assert "content" not in checked.columns


def test_rejected_files_are_not_read(spark, tmp_path):
    for name, size in (("a.log", 10), ("b.bin", 10), ("c.log", 5000)):
        (tmp_path / name).write_bytes(b"x" * size)
    found = listing.scan_root(spark, str(tmp_path), 0)
    plan = inventory.preflight(found, Limits(max_file_bytes=100))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan binaryFile" in line]
    assert len(scans) == 2
    assert sum("content" in line.split("[", 1)[1].split("]")[0] for line in scans) == 1
    assert any("length" in line and "LessThan" in line for line in scans if "content#" in line)


TREE = {"a.log": b"1", "nested/b.log": b"2", "nested/c.log": b"3", "nested/deep/d.exe": b"4"}


def test_folder_counts(spark):
    checked = inventory.preflight(files(spark, TREE))
    for roots in (None, ["/r"]):
        got = rows(
            inventory.folder_rollup(checked, roots=roots),
            "relative_path", "descendant_files", "selectable_files", "toggleable", "depth",
        )
        assert got == [("nested", 3, 2, True, 1), ("nested/deep", 1, 0, False, 2), ("r", 4, 3, True, 0)]


def test_empty_folders_come_from_a_listing(spark):
    checked = inventory.preflight(files(spark, {"a.log": b"1"}))
    folders = spark.createDataFrame([("/r", 0, "void"), ("/r", 0, "void/er")], "root string, root_ord int, folder string")
    got = rows(inventory.folder_rollup(checked, folders), "relative_path", "descendant_files")
    assert got == [("r", 1), ("void", 0), ("void/er", 0)]


def test_overlapping_roots(spark):
    outer = inventory.preflight(files(spark, TREE))
    inner = inventory.preflight(files(spark, {"b.log": b"2", "c.log": b"3", "deep/d.exe": b"4"}, "/r/nested", 1))
    both = outer.unionByName(inner)
    assert inventory.overlapping_roots(["/r", "/r/nested", "/rx"]) == ["/r", "/r/nested"]
    assert inventory.overlapping_roots(["/a", "/b", "/a"]) == ["/a"]
    for roots in (None, ["/r", "/r/nested"]):
        assert inventory.first_root_wins(both, roots).count() == 4
        got = rows(inventory.folder_rollup(both, roots=roots), "root", "relative_path", "descendant_files")
        # A later root counts what is left to it, its sub-folders count all they hold.
        assert got == [("/r", "nested", 3), ("/r", "nested/deep", 1), ("/r", "r", 4), ("/r/nested", "deep", 1), ("/r/nested", "nested", 0)]
    same = rows(inventory.folder_rollup(both, consistent_counts=True), "root", "relative_path", "descendant_files")
    assert same == [("/r", "nested", 3), ("/r", "nested/deep", 1), ("/r", "r", 4)]


def preorder(paths):
    out = []

    def walk(prefix):
        here = [p[len(prefix):] for p in paths if p.startswith(prefix)]
        out.append(prefix.rstrip("/") or "r")
        out.extend(sorted(prefix + p for p in here if "/" not in p))
        for folder in sorted({p.split("/")[0] for p in here if "/" in p}):
            walk(prefix + folder + "/")

    walk("")
    return out


def test_tree_order(spark):
    names = ["b.log", "a/z.log", "a/b/x.log", "a.log", "a-b/q.log", "a/b.log", "B/é.log", "a b/c.log", "a/b/c/d.log"]
    checked = inventory.preflight(files(spark, {n: b"x" for n in names}))
    entries = inventory.in_tree_order(inventory.tree(checked, inventory.folder_rollup(checked)))
    assert [r.relative_path for r in entries.collect()] == preorder(names)
    assert {r.depth for r in entries.filter("kind = 'file'").collect()} == {1, 2, 3, 4}


def test_scope_counts(spark):
    df = files(
        spark,
        {"a.log": b"", "nested/b.LOG": b"", "nested/c.txt": b"", ".git/h.log": b"", "x/.venv/s.log": b"", "projects/p.log": b"", ".log": b""},
    )
    got = rows(inventory.scope_counts(df), "folder", "files", "is_root")
    assert got == [("", 3, True), ("nested", 1, False)]
    assert inventory.scope_counts(files(spark, {"a.txt": b""})).count() == 0
    assert inventory.scope_counts(files(spark, {"a.log": b""}, root="/x/tmp")).count() == 1


def test_windows(spark):
    checked = inventory.preflight(files(spark, {"now.log": b"1", "two.log": (b"2", 120), "old.log": (b"3", 3700), "x.exe": b""}))
    got = {r.window_key: r.files for r in inventory.window_counts(checked, F.lit(NOW)).collect()}
    assert got == {"all": 3, "1m": 1, "5m": 2, "15m": 2, "1h": 2, "8h": 3, "1d": 3}
    assert inventory.in_window(checked, "1m", F.lit(NOW)).count() == 2
    assert inventory.in_window(checked, None, F.lit(NOW)).count() == 4
    edge = inventory.preflight(files(spark, {"e.log": (b"", 60), "f.log": (b"", 60.5)}))
    assert rows(inventory.in_window(edge, "1m", F.lit(NOW)), "relative_path") == [("e.log",)]


def test_stale_folders_are_pruned(spark):
    checked = inventory.preflight(files(spark, {"new.log": b"1", "stale/old.log": (b"2", 3600)}))
    recent = inventory.in_window(checked, "1m", F.lit(NOW))
    assert rows(inventory.folder_rollup(recent), "relative_path", "descendant_files") == [("r", 1)]


def pick(spark, *paths, root="/r"):
    return spark.createDataFrame([(root, p) for p in paths], "root string, relative_path string")


def test_selection(spark):
    checked = inventory.preflight(files(spark, {**TREE, "nested-not/x.log": b"5"}))

    def chosen(folders, named):
        return [r[0] for r in rows(inventory.expand_selection(checked, pick(spark, *folders), pick(spark, *named)), "relative_path")]

    assert chosen(["nested"], []) == ["nested/b.log", "nested/c.log"]
    assert chosen(["nested"], ["nested/b.log", "a.log"]) == ["a.log", "nested/b.log", "nested/c.log"]
    assert chosen([""], []) == ["a.log", "nested-not/x.log", "nested/b.log", "nested/c.log"]
    assert chosen(["none"], ["nested/deep/d.exe"]) == []


def test_selection_over_overlapping_roots(spark):
    outer = inventory.preflight(files(spark, TREE))
    inner = inventory.preflight(files(spark, {"b.log": b"2", "c.log": b"3"}, "/r/nested", 1))
    both = outer.unionByName(inner)
    nothing = pick(spark, "none")
    by_folder = inventory.expand_selection(both, pick(spark, "", root="/r/nested"), nothing, ["/r", "/r/nested"])
    assert rows(by_folder, "root", "relative_path") == [("/r", "nested/b.log"), ("/r", "nested/c.log")]
    by_name = inventory.expand_selection(both, nothing, pick(spark, "c.log", root="/r/nested"))
    assert rows(by_name, "absolute_path") == [("/r/nested/c.log",)]


def test_selection_by_list(spark):
    checked = inventory.preflight(files(spark, TREE))
    entries = inventory.tree(checked, inventory.folder_rollup(checked))
    wanted = spark.createDataFrame([("b.log",), ("nested/c.log",), ("nested",), ("d.exe",), ("deep",)], "entry string")
    got = rows(inventory.select_by_list(entries, wanted), "kind", "relative_path")
    assert got == [("file", "nested/b.log"), ("file", "nested/c.log"), ("folder", "nested")]


@pytest.mark.parametrize(
    ("names", "expected"),
    [
        (["x/y/a.log"], "/r/x/y"),
        (["x/y/a.log", "x/y/b.log"], "/r/x/y"),
        (["x/y/a.log", "x/y/z/b.log"], "/r/x/y"),
        (["x/y/a.log", "x/yy/b.log", "x/y/c.log"], "/r/x"),
        (["a.log", "x/b.log"], "/r"),
    ],
)
def test_common_root(spark, names, expected):
    df = files(spark, {n: b"" for n in names}).withColumn("s", F.lit(1))
    assert rows(inventory.common_root(df, ["s"]), "source_root") == [(expected,)]


def test_summary_of_many_files(spark):
    df = files(spark, {f"{i:02d}.log": b"x" * 1024 for i in range(25)}).withColumn("s", F.lit(1))
    total = inventory.archive_totals(df, ["s"]).first()
    assert (total.n_files, total.more_files, total.size_text) == (25, 5, "25.0 KiB")
    shown = inventory.archive_preview(df, ["s"], "relative_path")
    assert shown.count() == 20 and shown.agg(F.max("relative_path")).first()[0] == "19.log"


def test_blocked_send(spark):
    df = files(spark, {"a.log": b"x", "b.log": b"\x00"}).withColumn("s", F.col("relative_path").substr(1, 1))
    assert rows(inventory.send_blocked(df, ["s"], 8192), "s", "blocked") == [("a", False), ("b", True)]


def test_exact_walk(spark, tmp_path):
    (tmp_path / "d" / "empty").mkdir(parents=True)
    for name in ("a.log", ".hidden.log", "d/_under.log", "d/b.log"):
        (tmp_path / name).write_bytes(b"" if name == "a.log" else b"text")
    os.symlink(tmp_path / "a.log", tmp_path / "link.log")
    os.symlink(tmp_path / "d", tmp_path / "loop")
    listed = listing.walk(spark, [str(tmp_path), str(tmp_path / "gone"), str(tmp_path / "d" / "b.log")])
    table = listing.from_listing(listed)
    got = rows(table, "root_ord", "relative_path", "size_bytes", "root_is_file")
    assert got == [
        (0, ".hidden.log", 4, False),
        (0, "a.log", 0, False),
        (0, "d/_under.log", 4, False),
        (0, "d/b.log", 4, False),
        (2, "b.log", 4, True),
    ]
    checked = inventory.preflight(listing.with_content(table))
    assert checked.filter("preflight = 'ok'").count() == 5
    folders = inventory.folder_rollup(checked, listing.directories(listed))
    assert rows(folders, "relative_path", "descendant_files") == [("d", 2), ("d/empty", 0), (tmp_path.name, 4)]
    assert inventory.first_root_wins(checked).count() == 4


def test_file_source_listing(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.log").write_bytes(b"hello")
    found = listing.scan_roots(spark, [str(tmp_path), str(tmp_path / "gone")])
    assert rows(found, "relative_path", "size_bytes", "root_ord") == [("d/b.log", 5, 0)]
    assert listing.scan_roots(spark, [str(tmp_path / "gone")]).count() == 0


def test_files_of_any_kind_are_listed_and_digested_in_blocks(spark, tmp_path, monkeypatch):
    """Hidden, empty, large and unreadable files; links are left out; a file may be a root."""
    bodies = {"a.log": b"x" * 5_000_000, ".hidden.log": b"h", "_d/e.log": b"", "_d/nul.log": b"a\0b", "late.log": b"y" * 9000 + b"\0"}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    (tmp_path / "link.log").symlink_to(tmp_path / "a.log")
    found = listing.scan_roots(spark, [str(tmp_path), f"file:{tmp_path}/a.log", str(tmp_path / "gone")], with_content=False)
    read = listing.with_digests(found)
    want = [(n, len(b), hashlib.sha256(b).hexdigest(), n == "_d/nul.log") for n, b in bodies.items()]
    want.append(("a.log", 5_000_000, hashlib.sha256(bodies["a.log"]).hexdigest(), False))
    assert rows(read, "relative_path", "size_bytes", "sha256", "has_nul") == sorted(want, key=lambda t: tuple(map(str, t)))
    capped = listing.with_digests(found, max_bytes=100)
    assert capped.filter("sha256 IS NULL").count() == 3 and capped.filter("error IS NOT NULL").isEmpty()
    gone = found.withColumn("relative_path", F.concat(F.lit("no/"), "relative_path")).filter("NOT root_is_file")
    assert rows(listing.with_digests(gone).select("sha256", F.substring_index("error", ":", 1))) == [(None, "FileNotFoundError")] * 5
    status = inventory.preflight(read.filter("NOT root_is_file"), Limits(max_file_bytes=9500))
    assert rows(status, "relative_path", "preflight") == [
        (".hidden.log", "ok"), ("_d/e.log", "ok"), ("_d/nul.log", "not_text"), ("a.log", "file_too_large"), ("late.log", "ok")
    ]
    assert rows(inventory.preflight(listing.scan_roots(spark, [str(tmp_path)])), "relative_path").count((".hidden.log",)) == 1
