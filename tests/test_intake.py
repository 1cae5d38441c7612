import hashlib
import hmac
import io
import json
import tarfile
from datetime import datetime, timezone

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from frames import rows
from stowage.functions import digests
from stowage.operators import audit, intake, manifest
from stowage.schemas import ARRIVAL, Limits
from stowage.sinks import known, tables
from stowage.sources import archives
from stowage.streaming import intake_stream

KEYS = ["sender_id", "bundle_id"]
BUNDLE = "019237d0-2c41-71a5-9f7e-bd6a10b53c07"


def make_manifest(contents, bundle=BUNDLE, sender="alpha", version=1, **change):
    body = {
        "bundle_id": bundle,
        "files": [
            {"mtime": "2026-04-19T08:11:04Z", "relative_path": p, "sha256": hashlib.sha256(c).hexdigest(), "size_bytes": len(c)}
            for p, c in contents.items()
        ],
        "schema_version": version,
        "sender_id": sender,
        "sent_at": "2026-04-19T08:12:00Z",
        "source_root": "/tmp/src",
        **change,
    }
    return json.dumps(body, separators=(",", ":"), sort_keys=True).encode() + b"\n"


def make_tar(files, link=None):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, content in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
        if link:
            info = tarfile.TarInfo(link)
            info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
            tar.addfile(info)
    return out.getvalue()


def signed(body, secret="secret-alpha"):
    return "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def upload(number, files, sender="alpha", bundle=BUNDLE, token="token-alpha", secret="secret-alpha", body=None, tar=None, signature=None):
    body = make_manifest(files, bundle, sender) if body is None else body
    tar = make_tar(files) if tar is None else tar
    return (number, sender, bundle, token, signature or signed(body, secret), "127.0.0.1", bytearray(body), bytearray(tar))


def sender_table(spark):
    raw = spark.createDataFrame([("alpha", "token-alpha", "secret-alpha"), ("beta", "token-beta", "secret-beta")], "sender_id string, token string, secret string")
    return digests.with_signing_pads(raw.withColumn("token_sha", F.sha2("token", 256)).drop("token"))


OK = {"app.log": b"hello\n", "nested/b.log": b"beta\n"}
LIMITS = Limits(max_file_bytes=1000, max_bundle_bytes=5000, max_files=4)


def uploads():
    other = lambda n: f"{BUNDLE[:-2]}{n:02d}"
    long_name = {"x" * 50 + f"{i}.log": b"y" * 900 for i in range(4)}
    noise = bytes(hashlib.sha256(str(i).encode()).digest()[0] for i in range(6000))
    return {
        1: (upload(1, OK), "accept", None),
        2: (upload(2, OK), "replay", None),
        3: (upload(3, OK, sender="beta", token="token-beta", secret="secret-beta"), "accept", None),
        4: (upload(4, OK, bundle=other(4), token="wrong"), "refused", "auth"),
        5: (upload(5, OK, bundle=other(5), sender="gamma"), "refused", "auth"),
        6: (upload(6, OK, bundle=other(6), secret="not-the-secret"), "refused", "auth"),
        # other(7) is the bundle of 1, stored by then: its signature is not looked at.
        7: (upload(7, OK, bundle=other(7), signature="md5=00"), "replay", None),
        8: (upload(8, OK, bundle=other(8), body=make_manifest(OK, other(8), "someone")), "refused", "auth"),
        9: (upload(9, OK, bundle=other(9), body=make_manifest(OK, other(1))), "refused", "auth"),
        10: (upload(10, OK, bundle=other(10), body=b"{oops\n"), "refused", "path_unsafe"),
        11: (upload(11, OK, bundle=other(11), body=make_manifest(OK, other(11), version=99)), "refused", "schema_unsupported"),
        12: (upload(12, {"bad.exe": b"MZ\n"}, bundle=other(12)), "reject", "ext_not_allowed"),
        13: (upload(13, {"../escape.log": b"boom\n"}, bundle=other(13)), "reject", "path_unsafe"),
        14: (upload(14, OK, bundle=other(14), tar=make_tar(OK, link="evil.log")), "reject", "path_unsafe"),
        15: (upload(15, {"app.log": b"ok\x00bin\n"}, bundle=other(15)), "reject", "not_text"),
        16: (upload(16, OK, bundle=other(16), tar=make_tar({**OK, "app.log": b"tampered"})), "reject", "hash_mismatch"),
        17: (upload(17, {"big.log": b"z" * 1001}, bundle=other(17)), "reject", "file_too_large"),
        18: (upload(18, {f"{i}.log": b"" for i in range(5)}, bundle=other(18)), "reject", "too_many_files"),
        19: (upload(19, long_name, bundle=other(19)), "accept", None),
        20: (upload(20, OK, bundle=other(20), tar=noise), "refused", "bundle_too_large"),
        21: (upload(21, OK, bundle=other(21), tar=b"no archive"), "reject", "path_unsafe"),
        22: (upload(22, {}, bundle=other(22)), "accept", None),
        23: (upload(23, OK, bundle=other(16)), "accept", None),
        24: (upload(24, OK, bundle=other(24), token=None), "refused", "auth"),
        25: (upload(25, OK, bundle=other(25), signature="md5=00"), "refused", "auth"),
    }


def take_in(spark, data, stored=None, **options):
    arrivals = spark.createDataFrame(data, ARRIVAL)
    stored = spark.createDataFrame(stored or [], "sender_id string, bundle_id string")
    gated = intake.gate(intake.described(arrivals), sender_table(spark), stored, LIMITS)
    members = archives.read_members(intake.archives_to_open(arrivals, gated), ["attempt_id"], "gzip", LIMITS.max_file_bytes)
    return intake.accept_bundles(gated, members, F.lit("2026-04-19 08:12:05").cast("timestamp"), LIMITS, width=2, **options)


def test_outcome_of_every_kind_of_upload(spark):
    cases = uploads()
    result = take_in(spark, [c[0] for c in cases.values()])
    got = {r.attempt_id: (r.status, r.reason) for r in result.outcomes.collect()}
    assert got == {n: (c[1], c[2]) for n, c in cases.items()}

    records = {r.attempt_id: r for r in result.audit.collect()}
    assert set(records) == {n for n, c in cases.items() if c[1] in ("accept", "reject")}
    accepted = records[1]
    assert (accepted.event, accepted.file_count, accepted.reject_reason) == ("accept", 2, None)
    raw = cases[1][0]
    assert accepted.receipt_sha256 == hashlib.sha256(bytes(raw[6]) + b"\x00" + bytes(raw[7])).hexdigest()
    assert accepted.byte_count == len(raw[7]) and accepted.ts == "2026-04-19T08:12:05Z"
    assert (records[12].event, records[12].file_count, records[12].reject_reason) == ("reject", 0, "ext_not_allowed")

    receipts = {(r.sender_id, r.bundle_id): r for r in result.receipts.collect()}
    assert len(receipts) == 5
    files = receipts[("alpha", BUNDLE)].per_file_sha256_verified
    assert [(f.relative_path, f.sha256, f.size_bytes) for f in files] == [
        (p, hashlib.sha256(c).hexdigest(), len(c)) for p, c in OK.items()
    ]
    assert receipts[("alpha", BUNDLE)].status == "accept"
    assert [r for r in receipts.values() if r.bundle_id.endswith("22")][0].per_file_sha256_verified == []
    assert result.accepted.groupBy(*KEYS).count().count() == 4


def test_every_attempt_in_the_audit_when_asked(spark):
    cases = uploads()
    result = take_in(spark, [c[0] for c in cases.values()], audit_all=True)
    got = {r.attempt_id: (r.event, r.reject_reason) for r in result.audit.collect()}
    assert got == {n: ("accept" if c[1] in ("accept", "replay") else "reject", c[2]) for n, c in cases.items()}


def test_stored_bundles_are_replays_before_the_signature_is_checked(spark):
    bad = upload(1, OK, secret="not-the-secret")
    wrong_token = upload(2, OK, token="x")
    other_sender = upload(3, OK, sender="beta", token="token-beta", secret="secret-beta")
    got = take_in(spark, [bad, wrong_token, other_sender], stored=[("alpha", BUNDLE)]).outcomes
    assert rows(got, "attempt_id", "status") == [(1, "replay"), (2, "refused"), (3, "accept")]


def test_manifest_round_trip(spark):
    files = [("alpha", BUNDLE, i, p, hashlib.sha256(c).hexdigest(), len(c), 1776586264.9) for i, (p, c) in enumerate(OK.items())]
    chosen = spark.createDataFrame(files, "sender_id string, bundle_id string, member_idx long, relative_path string, sha256 string, size_bytes long, mtime double")
    built = manifest.build_manifests(chosen, F.lit("2026-04-19T08:12:00Z"), F.lit("/tmp/src"))
    body = make_manifest(OK)
    row = manifest.sign(built, sender_table(spark)).first()
    assert row.manifest.encode() == body and row.signature == signed(body) and row.status == "ok"
    read = manifest.read_manifests(built)
    assert rows(manifest.manifest_entries(read, tuple(KEYS)), "idx", "relative_path") == [(0, "app.log"), (1, "nested/b.log")]
    over = manifest.build_manifests(chosen, F.lit("t"), F.lit("/"), Limits(max_files=1))
    assert rows(over, "bundle_id", "n_files", "manifest", "status") == [(BUNDLE, 2, None, "too_many_files")]


@pytest.mark.parametrize(
    ("body", "reason"),
    [
        (make_manifest(OK), None),
        (make_manifest(OK, extra="ignored"), None),
        (make_manifest({}), None),
        (b"[1]", "path_unsafe"),
        (b"", "path_unsafe"),
        (make_manifest(OK, sent_at=None), "path_unsafe"),
        (make_manifest(OK, files=[{"relative_path": "a"}]), "path_unsafe"),
        (make_manifest(OK, version=2), "schema_unsupported"),
    ],
)
def test_manifest_parse(spark, body, reason):
    df = spark.createDataFrame([(bytearray(body),)], "manifest binary")
    assert manifest.read_manifests(df).first().manifest_reason == reason


def test_signatures(spark):
    body = make_manifest(OK)
    cases = [(body, signed(body), True), (body, signed(body, "x"), False), (body + b" ", signed(body), False), (body, signed(body)[7:], False), (body, None, False)]
    df = spark.createDataFrame([(bytearray(b), s) for b, s, _ in cases], "b binary, s string").join(sender_table(spark).filter("sender_id = 'alpha'"))
    got = df.select("b", "s", digests.signature_matches(F.col("b"), F.col("s"), F.col("ipad"), F.col("opad")).alias("ok")).collect()
    assert [r.ok for r in got] == [ok for _, _, ok in cases]


def test_reverify_names_changed_and_missing_files(spark):
    schema = "sender_id string, bundle_id string, relative_path string, sha256 string"
    expected = spark.createDataFrame([("a", "b", "1", "x"), ("a", "b", "2", "y"), ("a", "b", "3", "z")], schema)
    stored = spark.createDataFrame([("a", "b", "1", "x"), ("a", "b", "2", "edited"), ("a", "c", "3", "z")], schema)
    assert rows(intake.reverify(expected, stored), "relative_path", "problem") == [("2", "mismatch"), ("3", "missing")]


def test_quarantine_paths_and_collisions(spark, tmp_path):
    members = spark.createDataFrame([("a", "b1", 0, "x.log"), ("c", "b1", 0, "x.log")], "sender_id string, bundle_id string, member_idx long, relative_path string")
    at = F.lit("2026-04-09 23:59:59").cast("timestamp")
    tables.write_quarantine(members, at, str(tmp_path / "q"))
    stored = spark.read.parquet(str(tmp_path / "q"))
    assert rows(stored, "path") == [("a/2026/04/09/b1",), ("c/2026/04/09/b1",)]
    assert (tmp_path / "q" / "sender_id=a" / "yyyy=2026" / "mm=04" / "dd=09").is_dir()
    with pytest.raises(tables.QuarantineCollision):
        tables.write_quarantine(members, at, str(tmp_path / "q"), stored)
    assert [r.path for r in intake.list_bundles(stored.select("sender_id", "path")).collect()] == ["a/2026/04/09/b1", "c/2026/04/09/b1"]
    assert intake.list_bundles(stored, "c").count() == 1


def clock(batch):
    return datetime(2026, 4, 19, 8, 12, batch, tzinfo=timezone.utc)


def test_stream(spark, tmp_path):
    root, landing = str(tmp_path / "store"), str(tmp_path / "landing")
    senders = sender_table(spark)
    cases = uploads()
    second = [upload(100, OK), upload(101, OK, bundle="later-1"), upload(102, {"bad.exe": b"x"}, bundle="later-2")]
    for batch in ([c[0] for c in cases.values()], second):
        spark.createDataFrame(batch, ARRIVAL).write.mode("append").parquet(landing)
        intake_stream.run_available(spark, landing, root, str(tmp_path / "check"), senders, LIMITS, clock)
    outcomes = {r.attempt_id: r.status for r in spark.read.parquet(f"{root}/outcomes").collect()}
    assert outcomes == {**{n: c[1] for n, c in cases.items()}, 100: "replay", 101: "accept", 102: "reject"}
    lines = spark.read.parquet(f"{root}/audit/lines")
    as_log = lines.select(F.col("sender_id").alias("chain_id"), F.lit("f").alias("file_id"), F.lit(True).alias("active"), F.col("attempt_id").alias("seq"), "line")
    assert rows(audit.verify_chains(as_log), "chain_id", "n_lines", "ok") == [
        ("alpha", sum(c[1] in ("accept", "reject") and c[0][1] == "alpha" for c in cases.values()) + 2, True),
        ("beta", 1, True),
    ]
    ordered = lines.filter("sender_id = 'alpha'").orderBy("attempt_id").collect()
    offsets = {r.bundle_id: r.audit_log_offset for r in spark.read.parquet(f"{root}/answers").filter("sender_id = 'alpha'").collect()}
    for at, row in enumerate(ordered):
        if row.event == "accept":
            assert offsets.pop(row.bundle_id) == sum(len(r.line) + 1 for r in ordered[:at])
    assert offsets == {}
    stored = {(r.sender_id, r.bundle_id): bytes(r.manifest) for r in spark.read.parquet(f"{root}/manifests").collect()}
    assert len(stored) == 6 and stored[("alpha", BUNDLE)] == make_manifest(OK)
    before = {t: rows(spark.read.parquet(f"{root}/{t}").drop("batch_id")) for t in ("members", "receipts", "answers", "audit/lines", "audit/heads")}

    # The last batch again, as after a lost driver: nothing is added or changed.
    again = spark.createDataFrame(second, ARRIVAL)
    intake_stream.batch_writer(root, senders, LIMITS, clock)(again, 1)
    after = {t: rows(spark.read.parquet(f"{root}/{t}").drop("batch_id")) for t in before}
    assert after == before
    assert intake_stream.stored_bundles(spark, root).count() == 6


def test_results_do_not_depend_on_batches(spark, tmp_path):
    sent = [
        upload(1, OK, bundle="a", tar=b"no archive"),
        upload(2, OK, bundle="a"),
        upload(3, OK, bundle="a", signature="md5=00"),
        upload(4, OK, bundle="a", tar=b"no archive"),
        upload(5, OK, bundle="a", token="x"),
        upload(6, OK, bundle="b", signature="md5=00"),
    ]
    landing, results = str(tmp_path / "landing"), []
    for one in sent:
        spark.createDataFrame([one], ARRIVAL).coalesce(1).write.mode("append").parquet(landing)
    for most in (1, 1000):
        root = str(tmp_path / f"store-{most}")
        always = lambda _batch: clock(0)
        intake_stream.run_available(spark, landing, root, f"{root}-check", sender_table(spark), LIMITS, always, most)
        read = lambda name: spark.read.parquet(f"{root}/{name}")
        results.append(
            (
                rows(read("outcomes"), "attempt_id", "status", "reason", "n_members"),
                rows(read("receipts"), "sender_id", "bundle_id"),
                rows(read("audit/lines"), "attempt_id", "line"),
            )
        )
    assert results[0] == results[1]
    assert [r[:3] for r in results[0][0]] == [
        (1, "reject", "path_unsafe"), (2, "accept", None), (3, "replay", None),
        (4, "replay", None), (5, "refused", "auth"), (6, "refused", "auth"),
    ]


def test_only_the_newest_batch_is_opened(spark, tmp_path):
    root = str(tmp_path / "heads")
    assert tables.newest_batch(spark, root, "n long", 5).count() == 0
    for batch in range(11):
        tables.write_batch(spark.range(1).selectExpr(f"{batch} AS n"), root, batch)
    heads = tables.newest_batch(spark, root, "n int", 10)
    assert rows(heads) == [(9,)] and all("batch_id=9/" in f for f in heads.inputFiles())


def test_a_batch_reads_the_buckets_of_its_own_bundles(spark, tmp_path, monkeypatch):
    """Ten batches: what one looks into is bounded, every stored bundle it names is found, repeats change nothing."""
    for name, value in {"MERGE_EVERY": 2, "REWRITE_EVERY": 3, "BUCKET_ROWS": 150}.items():
        monkeypatch.setattr(known, name, value)
    root, index, schema = f"{tmp_path}/receipts", f"{tmp_path}/known", "sender_id string, bundle_id string"
    opened = {}
    for batch in range(10):
        for _ in range(2 if batch == 3 else 1):
            asked = [("s", f"{batch // 2}-1"), ("s", f"{max(0, batch - 1)}-2"), ("s", f"{batch}-3"), ("t", "0-1")]
            attempts = spark.createDataFrame(asked, schema)
            found = known.stored_among(attempts, root, index, batch)
            if batch in (0, 4, 9):
                met = sorted(tuple(r) for r in attempts.join(found.distinct(), KEYS, "left_semi").collect())
                assert met == sorted({k for k in asked if k[0] == "s" and int(k[1].split("-")[0]) < batch})
            files = [f.removeprefix("file:").replace("//", "/") for f in found.inputFiles()]
            opened[batch] = sum(pq.read_metadata(f).num_rows for f in files if "/known/" in f)
            assert sum("/receipts/" in f for f in files) <= 2
            rows_ = [("s", f"{batch}-{i}") for i in range(200)]
            tables.write_batch(spark.createDataFrame(rows_, schema).coalesce(1), root, batch)
            known.merge(spark, root, index, batch)
    states = [known.State.parsed(p.name) for p in (tmp_path / "known").iterdir() if p.name.startswith("state=")]
    assert len(states) == 2 and max(s.rows for s in states) >= 2000 and max(s.bits for s in states) >= 4
    # An attempt looks into one bucket, however many bundles are stored (a repeated batch appends twice).
    assert 150 < max(opened.values()) <= len(asked) * 150 * 1.3, opened


def test_stored_receipts_are_read_back(spark):
    text = '{"bundle_id":"b","received_at":"t","per_file_sha256_verified":[{"relative_path":"a","sha256":"x","size_bytes":1}],"audit_log_offset":0,"status":"accept"}'
    df = spark.createDataFrame([(1, text), (2, "{}"), (3, "junk")], "n int, receipt string")
    assert rows(intake.read_receipts(df), "n", "readable") == [(1, True), (2, False), (3, False)]
    files = intake.receipt_files(intake.read_receipts(df).filter("readable").select("r.*").withColumn("sender_id", F.lit("s")))
    assert rows(files) == [("s", "b", "a", "x", 1)]


def test_replay_split(spark):
    attempts = spark.createDataFrame([(i, "a", f"b{i % 3}") for i in range(9)] + [(9, "c", "b0")], "attempt_id long, sender_id string, bundle_id string")
    stored = spark.createDataFrame([("a", "b1")], "sender_id string, bundle_id string")
    got = intake.replay_split(attempts, stored)
    assert rows(got.filter("NOT replay"), "attempt_id") == [(0,), (2,), (9,)]
