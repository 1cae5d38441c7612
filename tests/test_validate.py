import hashlib

import pytest
from pyspark.sql import functions as F

from frames import rows
from stowage.operators import validate
from stowage.schemas import MEMBER, REASONS, Limits

KEYS = ["sender_id", "bundle_id"]
MANIFEST = "sender_id string, bundle_id string, idx long, relative_path string, sha256 string, size_bytes long"


def members(spark, files, bundle="b", sender="alpha"):
    data = []
    for i, item in enumerate(files):
        name, content, *kind = item
        size = kind[1] if len(kind) > 1 else len(content)
        data.append((sender, bundle, i, name, kind[0] if kind else "file", size, bytearray(content)))
    return spark.createDataFrame(data, MEMBER)


def declared(spark, files, bundle="b", sender="alpha"):
    data = [(sender, bundle, i, p, hashlib.sha256(c).hexdigest(), len(c)) for i, (p, c) in enumerate(files)]
    return spark.createDataFrame(data, MANIFEST)


def verdict(spark, files, limits=Limits(), manifest=None, **options):
    manifest = [(n.lstrip("/"), c) for n, c, *_ in files] if manifest is None else manifest
    found = validate.bundle_verdicts(
        members(spark, files), declared(spark, manifest), limits, width=3, **options
    ).collect()
    assert len(found) == 1
    return found[0]


def test_happy_path(spark):
    got = verdict(spark, [("a.log", b"alpha\n"), ("nested/b.log", b"beta\n")])
    assert got.accepted and got.reason is None and got.n_members == 2 and got.n_bytes == 11


@pytest.mark.parametrize(
    ("files", "limits", "reason", "at"),
    [
        ([("a.exe", b"x")], Limits(), "ext_not_allowed", 0),
        ([("evil.log", b"", "link")], Limits(), "path_unsafe", 0),
        ([("dev.log", b"", "special")], Limits(), "path_unsafe", 0),
        ([("../escape.log", b"x")], Limits(), "path_unsafe", 0),
        ([("/etc/ok.log", b"x")], Limits(), None, None),
        ([("d", b"", "dir"), ("d/a.log", b"x")], Limits(), None, None),
        ([("big.log", b"x" * 2048)], Limits(max_file_bytes=1024), "file_too_large", 0),
        ([("a.log", b"x" * 100)], Limits(max_file_bytes=100), None, None),
        ([("a.log", b"x" * 800), ("b.log", b"x" * 800)], Limits(max_bundle_bytes=1000), "bundle_too_large", 1),
        ([("a.log", b"x" * 500), ("b.log", b"x" * 500)], Limits(max_bundle_bytes=1000), None, None),
        ([("ok.log", b"ok\x00bad")], Limits(), "not_text", 0),
        ([("ok.log", b"a" * 10_000 + b"\x00")], Limits(probe_bytes=5000), None, None),
        ([("ok.log", b"")], Limits(), None, None),
        ([(".log", b"x")], Limits(), "ext_not_allowed", 0),
        ([("UPPER.LOG", b"x")], Limits(), None, None),
        ([("a.txt", b"x")], Limits(extensions=(".log", ".txt")), None, None),
        # A later phase never beats an earlier one, whatever the member order.
        ([("a.log", b"\x00"), ("b.log", b"x"), ("c.exe", b"x")], Limits(), "ext_not_allowed", 2),
        # In one phase the first member decides, on one member the first rule.
        ([("a.exe", b"x" * 50), ("../b.log", b"x")], Limits(max_file_bytes=10), "ext_not_allowed", 0),
        ([("a.log", b"x" * 50)], Limits(max_file_bytes=10, max_bundle_bytes=5), "file_too_large", 0),
    ],
)
def test_rules(spark, files, limits, reason, at):
    got = verdict(spark, files, limits)
    assert (got.reason, got.at_member, got.accepted) == (reason, at, reason is None)
    assert got.reason is None or got.reason in REASONS


def test_extensions_refused_by_default(spark):
    refused = ".sh .exe .py .pyc .txt .json .ndjson .md .csv .tsv .yaml .yml".split() + [""]
    base = members(spark, [("a.log", b"x")], bundle="ok")
    for extension in refused:
        base = base.unionByName(members(spark, [(f"file{extension}", b"x")], bundle=f"b{extension}"))
    got = rows(validate.bundle_verdicts(base, None), "bundle_id", "reason")
    assert got == sorted([(f"b{e}", "ext_not_allowed") for e in refused] + [("ok", None)])


def test_count_cap(spark):
    five = [(f"{i}.log", b"x") for i in range(5)]
    assert verdict(spark, five, Limits(max_files=5)).accepted
    over = verdict(spark, five, Limits(max_files=3), manifest=five[:3])
    assert (over.reason, over.phase, over.at_member) == ("too_many_files", 1, 3)
    by_manifest = verdict(spark, five, Limits(max_files=3))
    assert (by_manifest.reason, by_manifest.phase, by_manifest.at_member) == ("too_many_files", 0, None)


def test_hashes(spark):
    files = [("a.log", b"one"), ("b.log", b"two")]
    assert verdict(spark, files, manifest=[("a.log", b"one")]).reason == "hash_mismatch"
    wrong = verdict(spark, files, manifest=[("a.log", b"one"), ("b.log", b"other")])
    assert (wrong.reason, wrong.phase, wrong.at_member) == ("hash_mismatch", 3, 1)
    last_wins = verdict(spark, files, manifest=[("b.log", b"other"), ("a.log", b"one"), ("b.log", b"two")])
    assert last_wins.accepted
    more = files + [("c.log", b"three")]
    assert verdict(spark, files, manifest=more).accepted
    strict = verdict(spark, files, manifest=more, strict_missing=True)
    assert (strict.reason, strict.phase, strict.at_member) == ("hash_mismatch", 3, None)


def test_bundle_known_from_its_manifest_only(spark):
    none = members(spark, [("a.log", b"x")]).filter(F.lit(False))
    got = validate.bundle_verdicts(none, declared(spark, [("a.log", b"x")])).collect()
    assert [(r.accepted, r.n_members) for r in got] == [(True, 0)]


def test_two_senders_with_one_bundle_id(spark):
    both = members(spark, [("a.log", b"x")], sender="alpha").unionByName(members(spark, [("a.exe", b"x")], sender="beta"))
    got = validate.bundle_verdicts(both, None)
    assert rows(got, "sender_id", "accepted") == [("alpha", True), ("beta", False)]


def test_whole_bundle_and_invariants(spark):
    """A huge bundle among small ones: every member is accounted for once."""
    small = [("s", f"b{b}", i, f"{i}.log") for b in range(20) for i in range(b % 6 + 1)]
    huge = [("s", "huge", i, f"{i}.log") for i in range(400)]
    base = spark.createDataFrame(small + huge, "sender_id string, bundle_id string, member_idx long, name string").withColumns(
        {"member_type": F.lit("file"), "size_bytes": F.lit(10).cast("long"), "content": F.lit("x").cast("binary")}
    )
    limits = Limits(max_files=5)
    checked = validate.checked_members(base, limits)
    findings = validate.member_findings(checked, None, limits, width=16)
    verdicts = validate.verdicts_from(findings, None, limits)
    assert verdicts.count() == 21
    assert rows(verdicts.filter("bundle_id = 'huge'"), "accepted", "reason", "at_member") == [(False, "too_many_files", 5)]
    accepted = validate.accepted_members(findings, verdicts, limits)
    good = {r.bundle_id for r in verdicts.filter("accepted").collect()}
    assert accepted.count() == sum(1 for m in small if m[1] in good)
    totals = validate.audit_totals(verdicts)
    assert totals.filter("NOT accepted AND file_count <> 0").count() == 0


def test_undeclared_and_missing(spark):
    got = validate.undeclared_and_missing(
        validate.checked_members(members(spark, [("a.log", b"x"), ("./b.log", b"y")])),
        declared(spark, [("b.log", b"y"), ("c.log", b"z")]),
    )
    assert rows(got, "relative_path", "side") == [("a.log", "undeclared"), ("c.log", "missing")]


def test_limits_must_be_positive():
    with pytest.raises(ValueError):
        Limits(max_files=0)
