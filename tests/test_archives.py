import gzip
import io
import tarfile

import pytest
import zstandard
from pyspark.sql import functions as F

from frames import rows
from stowage.operators import manifest, validate
from stowage.schemas import Limits
from stowage.sources import archives


def tar_bytes(files, dirs=()):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name in dirs:
            info = tarfile.TarInfo(name)
            info.type = tarfile.DIRTYPE
            tar.addfile(info)
        for name, content in files:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    return out.getvalue()


def squeeze(data):
    return zstandard.ZstdCompressor().compress(data)


def table(spark, **blobs):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in blobs.items()], "label string, archive binary")


FILES = [("a.log", b"alpha"), ("b/c.log", b"\x00" * 10), ("big.log", b"x" * 3000), ("empty.log", b"")]


def test_members(spark):
    df = table(spark, one=gzip.compress(tar_bytes(FILES, ["b"])), bad=b"junk", cut=gzip.compress(tar_bytes(FILES))[:-40])
    got = archives.read_members(df, ["label"], "gzip", max_content_bytes=1000)
    whole = rows(got.filter("label = 'one'"), "member_idx", "name", "member_type", "size_bytes", F.length("content"))
    assert whole == [
        (0, "b", "dir", 0, None),
        (1, "a.log", "file", 5, 5),
        (2, "b/c.log", "file", 10, 10),
        (3, "big.log", "file", 3000, None),
        (4, "empty.log", "file", 0, 0),
    ]
    assert got.filter("label = 'bad'").first().error is not None
    assert got.filter("label = 'cut' AND error IS NOT NULL").count() == 1


def test_listing_keeps_order(spark):
    names = [f"{i:04d}.log" for i in range(1500)]
    df = table(spark, z=squeeze(tar_bytes([(n, b"x") for n in reversed(names)])))
    got = archives.list_members(df, ["label"]).orderBy("member_idx").collect()
    assert [r.name for r in got] == names[::-1]


def test_validity(spark):
    good = tar_bytes(FILES)
    df = table(
        spark,
        good=squeeze(good),
        empty=squeeze(b""),
        junk=squeeze(b"just text, no archive" * 100),
        broken=b"\x00\x01" + squeeze(good),
        nothing=b"",
        torn_tail=squeeze(good[:1100]),
    )
    lenient = dict(rows(archives.check_archives(df, ["label"]), "label", "valid"))
    assert lenient == {"good": True, "empty": True, "junk": False, "broken": False, "nothing": True, "torn_tail": True}
    strict = {r.label: (r.valid, r.failed_stage) for r in archives.check_backup_files(df, ["label"]).collect()}
    assert strict == {
        "good": (True, None),
        "empty": (True, None),
        "junk": (False, "tar"),
        "broken": (False, "zstd"),
        "nothing": (False, "zstd"),
        "torn_tail": (False, "tar"),
    }


def test_round_trip(spark):
    data = [("s", f"b{b}", i, f"d/{i}.log", bytearray(f"{b}-{i}".encode())) for b in range(6) for i in range(b + 1)]
    files = spark.createDataFrame(data, "sender_id string, bundle_id string, member_idx long, relative_path string, content binary")
    packed = archives.pack_bundles(files, Limits(max_files=4, max_bundle_bytes=11))
    assert rows(packed, "bundle_id", "n_files", "n_bytes", "status", F.isnull("archive")) == [
        ("b0", 1, 3, "ok", False),
        ("b1", 2, 6, "ok", False),
        ("b2", 3, 9, "ok", False),
        ("b3", 4, 12, "bundle_too_large", True),
        ("b4", 5, 15, "too_many_files", True),
        ("b5", 6, 18, "too_many_files", True),
    ]
    packed = packed.filter("status = 'ok'")
    back = archives.read_members(packed, list(validate.BUNDLE), "gzip")
    want = sorted((b, i, p, bytes(c)) for _, b, i, p, c in data if b in ("b0", "b1", "b2"))
    assert sorted((r.bundle_id, r.member_idx, r.name, bytes(r.content)) for r in back.collect()) == want


def test_a_sender_packs_bundles_of_any_size(spark):
    """More members than a receiver takes are packed all the same, and read back."""
    data = [("s", "big", i, f"{i}.log", bytearray(b"x")) for i in range(Limits().max_files + 5)]
    files = spark.createDataFrame(data, "sender_id string, bundle_id string, member_idx long, relative_path string, content binary")
    packed = archives.pack_bundles(files)
    assert rows(packed, "n_files", "status", F.isnull("archive")) == [(len(data), "ok", False)]
    assert archives.list_members(archives.pack_bundles(files, codec="zstd"), list(validate.BUNDLE)).count() == len(data)
    listed = files.selectExpr("* except (content)", "'00' AS sha256", "1L AS size_bytes", "0D AS mtime")
    built = manifest.build_manifests(listed, F.lit("t"), F.lit("/"))
    assert rows(built, "n_files", "status") == [(len(data), "ok")]
    assert manifest.manifest_entries(manifest.read_manifests(built), validate.BUNDLE).count() == len(data)


def test_content_is_shuffled_once(spark, monkeypatch):
    """Sizes are added up on the scan; the only exchange under the archives is the one for packing."""
    data = [("s", f"b{b}", i, f"{i}.log", bytearray(b"xyz")) for b in range(6) for i in range(b + 1)]
    schema = "sender_id string, bundle_id string, member_idx long, relative_path string, content binary"
    files = spark.createDataFrame(data, schema)

    def packed_with(most):
        monkeypatch.setattr(archives, "BROADCAST_ROWS", most)
        packed = archives.pack_bundles(files, Limits(max_files=4))
        plan = packed._jdf.queryExecution().executedPlan().toString()
        return sorted(map(tuple, packed.collect())), sum("Exchange hashpartitioning" in line for line in plan.splitlines())

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        few, exchanges = packed_with(50_000)
        many, _ = packed_with(0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert exchanges == 1 and few == many and sum("ok" in r for r in few) == 4


def test_reading_stops_at_the_first_cap(spark):
    """An archive that goes on after a cap is broken is not read further; the verdict is the same."""
    files = [(f"{i}.log", b"x" * (30 if i == 3 else 5)) for i in range(50)]
    df = table(spark, one=gzip.compress(tar_bytes(files)))
    for limits, last in ((Limits(max_files=8), 8), (Limits(max_file_bytes=20), 3), (Limits(max_bundle_bytes=50), 5), (Limits(), 49)):
        whole = archives.read_members(df, ["label"], "gzip")
        cut = archives.read_members(df, ["label"], "gzip", stop_at=limits)
        assert cut.agg(F.max("member_idx")).first()[0] == last
        one, other = (
            validate.bundle_verdicts(m, None, limits, ("label",)).select("accepted", "reason", "at_member").collect()
            for m in (whole, cut)
        )
        assert one == other
