import gzip
import hashlib
import io
import tarfile

import pytest
from frames import rows
from pyarrow import fs
from pyspark.sql import functions as F

from stowage.functions import digests
from stowage.operators import manifest, validate
from stowage.sinks import bundle_parts
from stowage.sources.archive_files import ArchiveReader, with_archives
from stowage.sources.store import files_below

SCHEMA = "sender_id string, bundle_id string, member_idx long, relative_path string, content binary"
KEYS = list(validate.BUNDLE)
def named():
    return F.concat_ws("--", *KEYS)


def sent(spark):
    """One bundle of a thousand members, a few small ones, odd names and contents."""
    data = [("s", "big", i, f"d/{i}.log", bytearray(b"%d" % i * (i % 50))) for i in range(1000)]
    data += [("s", f"b{b}", i, f"{i}.log", bytearray(b"x")) for b in range(5) for i in range(b + 1)]
    data += [("t", "big", 0, "long/" * 60 + "name é漢.log", bytearray(b"a" * 3_000_000)), ("t", "big", 7, "none.log", None)]
    return data, spark.createDataFrame(data, SCHEMA).repartition(5)


@pytest.mark.parametrize("codec", ["gzip", "zstd"])
def test_parts_are_packed_and_read_one_by_one(spark, tmp_path, codec):
    data, files = sent(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # little data would be one task
    index = bundle_parts.write_parts(files, f"{tmp_path}/p", codec=codec, part_members=64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    big = index.filter("sender_id = 's' AND bundle_id = 'big'")
    assert big.count() == 16 and big.select("file").distinct().count() > 1  # by several tasks
    got = bundle_parts.placed(index).filter("bundle_id = 'big' AND sender_id = 's'").orderBy("part").collect()
    assert [r["first_member"] for r in got] == list(range(0, 1000, 64))
    assert [r["archive_offset"] for r in got] == [sum(r["length"] for r in got[:i]) for i in range(16)]
    found = bundle_parts.read_part_members(index, f"{tmp_path}/p", codec=codec)
    want = {}
    for s, b, i, path, content in sorted(data, key=lambda r: r[:3]):
        own = want.setdefault((s, b), [])
        own.append((s, b, len(own), path, "file", len(content or b""), bytes(content or b"")))
    read = sorted((*r[:6], bytes(r["content"])) for r in found.collect() if r["error"] is None)
    assert read == sorted(row for own in want.values() for row in own)
    small = bundle_parts.read_part_members(index, f"{tmp_path}/p", codec=codec, max_content_bytes=10)
    assert {r["size_bytes"] for r in small.filter("content IS NULL").collect()} == {len(c) for *_, c in data if c and len(c) > 10}


def test_joined_files_are_plain_archives_and_read_by_many_tasks(spark, tmp_path, monkeypatch):
    data, files = sent(spark)
    index = bundle_parts.write_parts(files, f"{tmp_path}/p", part_members=64)
    joined = bundle_parts.join_parts(index, f"{tmp_path}/p", f"{tmp_path}/a", named()).collect()
    assert len(joined) == 7
    for row in joined:
        with open(row["path"], "rb") as opened:
            whole = opened.read()
        assert len(whole) == row["length"]
        with tarfile.open(fileobj=io.BytesIO(whole)) as tar:
            names = [m.name for m in tar]
        own = [r for r in data if (r[0], r[1]) == (row["sender_id"], row["bundle_id"])]
        assert names == [r[3] for r in sorted(own, key=lambda r: r[2])]
    monkeypatch.setattr("stowage.sources.archive_files.TASK_BYTES", 2000)
    assert len(ArchiveReader({"path": f"{tmp_path}/a"}).partitions()) > 7
    found = with_archives(spark).read.format("archive_members").load(f"{tmp_path}/a")
    got = [(r["path"].split("/")[-1], r["member_idx"], r["name"], bytes(r["content"])) for r in found.collect()]
    want = []
    for s, b in {(r[0], r[1]) for r in data}:
        own = sorted((r for r in data if (r[0], r[1]) == (s, b)), key=lambda r: r[2])
        want += [(f"{s}--{b}.tar.gz", i, r[3], bytes(r[4] or b"")) for i, r in enumerate(own)]
    assert sorted(got) == sorted(want)


def test_filters_reach_the_reader(spark, tmp_path):
    _, files = sent(spark)
    index = bundle_parts.write_parts(files, f"{tmp_path}/p")
    bundle_parts.join_parts(index, f"{tmp_path}/p", f"{tmp_path}/a", named()).collect()
    source = with_archives(spark).read.format("archive_members")
    chosen = source.load(f"{tmp_path}/a").filter("name = 'd/77.log' OR name = 'd/78.log'").filter("size_bytes < 100")
    assert rows(chosen, "name", "size_bytes") == [("d/77.log", 54), ("d/78.log", 56)]
    by_name = source.load(f"{tmp_path}/a").filter(F.col("name").startswith("d/") & (F.col("size_bytes") >= 147))
    assert by_name.count() == sum(len(b"%d" % i * (i % 50)) >= 147 for i in range(1000))
    plan = by_name._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in plan and "147" not in plan  # nothing is left for Spark to test
    reader = ArchiveReader({"path": f"{tmp_path}/a"})
    from pyspark.sql.datasource import EqualTo, Not

    kept = list(reader.pushFilters([EqualTo(("path",), f"{tmp_path}/a/t--big.tar.gz"), Not(EqualTo(("name",), "x"))]))
    assert len(kept) == 1 and len(reader.partitions()) == 1  # files of other paths are not opened
    bare = source.option("content", "false").load(f"{tmp_path}/a")
    assert bare.filter("content IS NOT NULL").isEmpty() and bare.count() == 1017


def test_foreign_and_damaged_files(spark, tmp_path):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        folder = tarfile.TarInfo("d")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
        info = tarfile.TarInfo("d/a.log")
        info.size = 3
        tar.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "ok.tgz").write_bytes(gzip.compress(out.getvalue()))
    (tmp_path / "cut.tar.gz").write_bytes(gzip.compress(out.getvalue())[:60])
    (tmp_path / "note.txt").write_bytes(b"no archive")
    found = with_archives(spark).read.format("archive_members").load(str(tmp_path))
    got = sorted((r["path"].split("/")[-1], r["member_idx"], r["name"], r["member_type"]) for r in found.collect() if not r["error"])
    assert ("ok.tgz", 0, "d", "dir") in got and ("ok.tgz", 1, "d/a.log", "file") in got
    assert found.filter("error IS NOT NULL").select("member_type").first()[0] == "unreadable"
    empty = with_archives(spark).read.format("archive_members").load(str(tmp_path)).filter("path = 'none'")
    assert empty.count() == 0


def test_small_archives_share_a_task(spark, tmp_path):
    """As many tasks as there is to read, not as there are files; damage in one ends that one."""
    for i in range(600):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for k in range(i % 3):
                info = tarfile.TarInfo(f"{k}.log")
                info.size = 4
                tar.addfile(info, io.BytesIO(b"%04d" % i))
        whole = gzip.compress(out.getvalue())
        folder = tmp_path / "a" / ("x" if i % 2 else "longer")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.tar.gz").write_bytes(whole[:30] if i == 301 else whole)
    (tmp_path / "a" / "longer" / "302.tar.gz.frames").write_bytes(b"")  # nothing is cut there
    assert 2 <= len(ArchiveReader({"path": f"{tmp_path}/a"}).partitions()) <= 4
    found = with_archives(spark).read.format("archive_members").load(f"{tmp_path}/a")
    assert found.rdd.getNumPartitions() <= 4
    got = [(r["path"].split("/")[-1], r["member_idx"], r["name"], bytes(r["content"])) for r in found.filter("error IS NULL").collect()]
    assert sorted(got) == sorted((f"{i}.tar.gz", k, f"{k}.log", b"%04d" % i) for i in range(600) if i != 301 for k in range(i % 3))
    assert [r["path"].split("/")[-1] for r in found.filter("error IS NOT NULL").collect()] == ["301.tar.gz"]
    alone = with_archives(spark).read.format("archive_members").load(f"{tmp_path}/a/x/5.tar.gz")
    assert alone.count() == 2


def test_files_are_listed_as_the_store_lists_them(tmp_path):
    (tmp_path / "a" / ".b").mkdir(parents=True)
    (tmp_path / "o").mkdir()
    for at, name in enumerate(("a/x.tgz", "a/.b/é y.tgz", "a/.hidden", "o/z.tgz")):
        (tmp_path / name).write_bytes(b"." * at)
    (tmp_path / "a" / "linked").symlink_to(tmp_path / "o")
    (tmp_path / "a" / "link.tgz").symlink_to(tmp_path / "a" / "x.tgz")
    (tmp_path / "a" / "gone.tgz").symlink_to("/no/such")
    store = fs.LocalFileSystem()
    want = store.get_file_info(fs.FileSelector(f"{tmp_path}/a", recursive=True))
    want = sorted((f.path, f.size) for f in want if f.type == fs.FileType.File)
    assert len(want) == 5 and sorted(files_below(store, f"{tmp_path}/a")) == want
    below = [(f"{tmp_path}/{p}", n) for p, n in files_below(fs.SubTreeFileSystem(str(tmp_path), store), "a")]
    assert sorted(below) == want


def test_manifest_chunks_are_the_canonical_text(spark):
    data = [
        (s, b, i, f"{i}\x1f\\é\".log", hashlib.sha256(b"%d" % i).hexdigest(), i, 1776586264.0 + i)
        for s, b, n in (("a", "one", 1), ("a", 'two","files":[]', 250), ("b", "one", 40), ("x", "one", 2))
        for i in range(n)
    ]
    schema = "sender_id string, bundle_id string, member_idx long, relative_path string, sha256 string, size_bytes long, mtime double"
    chosen = spark.createDataFrame(data, schema).repartition(4)
    whole = manifest.build_manifests(chosen, F.lit("t\x1f"), F.lit("/r"))
    chunks = bundle_parts.manifest_chunks(chosen, F.lit("t\x1f"), F.lit("/r"), entries=16)
    texts = {}
    for r in chunks.orderBy(*KEYS, "slice").collect():
        texts.setdefault((r["sender_id"], r["bundle_id"]), []).append(r["chunk"])
    assert {k: "".join(v) for k, v in texts.items()} == {(r[0], r[1]): r["manifest"] for r in whole.select(*KEYS, "manifest").collect()}
    assert len(texts["a", 'two","files":[]']) == 16
    senders = digests.with_signing_pads(spark.createDataFrame([("a", "k" * 70), ("b", "")], "sender_id string, secret string"))
    want = manifest.sign(whole, senders)
    got = bundle_parts.sign_chunks(chunks, senders)
    assert rows(got, *KEYS, "n_files", "signature") == rows(want, *KEYS, "n_files", "signature")
    assert rows(got, *KEYS, "n_bytes") == rows(want, *KEYS, F.octet_length("manifest").cast("long"))


def test_nothing_to_pack(spark, tmp_path):
    index = bundle_parts.write_parts(spark.createDataFrame([], SCHEMA), f"{tmp_path}/p")
    assert index.count() == 0 and bundle_parts.read_part_members(index, f"{tmp_path}/p").count() == 0
