import fnmatch
import hashlib
import hmac
import json
from pathlib import PurePosixPath

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frames import rows
from stowage.functions import canonical, digests, globs, ids, paths, text
from stowage.operators.restore import path_excluded

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "name", ["a.log", "nested/dir/app.log", "UPPER.LOG", ".log", "a.tar.gz", "noext", "a.", "x/.hidden", "a b.LoG"]
)
def test_extension_is_the_final_suffix(spark, name):
    assert one(spark, name, paths.extension) == PurePosixPath(name).suffix.lower().rstrip(".")


@pytest.mark.parametrize(
    ("raw", "tidy"),
    [("/etc/ok.log", "etc/ok.log"), ("a//b/./c", "a/b/c"), ("./a", "a"), ("a/../b", "a/../b"), ("a/", "a"), ("a", "a")],
)
def test_normal_form(spark, raw, tidy):
    assert one(spark, raw, paths.normalise) == tidy


@pytest.mark.parametrize(
    ("name", "unsafe"),
    [("../x", True), ("a/../../x", True), ("a/../x", False), ("a..b/x", False), ("/etc/x", False), ("a/b/../../..", True)],
)
def test_climbing_out_of_the_root(spark, name, unsafe):
    assert one(spark, name, paths.escapes_root) is unsafe


def test_depth_parent_and_name(spark):
    df = spark.createDataFrame([("a/b/c.log",), ("c.log",), ("",)], "x string")
    got = rows(df, paths.depth(F.col("x")), paths.parent(F.col("x")), paths.base_name(F.col("x")))
    assert got == [(0, "", ""), (1, "", "c.log"), (3, "a/b", "c.log")]


def test_ancestors(spark):
    assert one(spark, "a/b/c", paths.ancestors) == ["a", "a/b"]
    assert one(spark, "a/b", lambda x: paths.ancestors(x, include_self=True)) == ["a", "a/b"]
    assert one(spark, "a/b", lambda x: paths.ancestors(x, True, True)) == ["", "a", "a/b"]
    assert one(spark, "", lambda x: paths.ancestors(x, True, True)) == [""]
    assert one(spark, "a", paths.ancestors) == []


@pytest.mark.parametrize(
    ("path", "patterns", "ignore", "expected"),
    [
        ("/project/.git", [".git", "*.pyc"], True, False),
        ("/project/file.pyc", ["*.pyc"], False, True),
        ("/project/.git/objects", [".git"], False, True),
        ("/project/src/main.py", [".git", "*.pyc"], False, False),
        ("/other/project/file.txt", ["*.txt"], False, False),
        ("/project/node_modules/pkg", ["node_modules/"], False, True),
        ("/project/sub/deep/__pycache__/file.pyc", ["__pycache__"], False, True),
        ("/project/any/file.txt", [], False, False),
        ("src/test.pyc", ["*.pyc"], False, True),
        ("/project/a/postfix/spool/q/1", ["*/postfix/spool/*"], False, True),
    ],
)
def test_exclusion_cases(spark, path, patterns, ignore, expected):
    assert one(spark, path, lambda x: path_excluded(x, "/project", tuple(patterns), ignore)) is expected


PIECE = st.text(alphabet="ab.x[1]", min_size=1, max_size=4).filter(lambda p: p not in (".", ".."))
GLOB = st.lists(st.sampled_from(["a", "b", ".", "x", "*", "?", "[ab]", "[!a]", "/", "1"]), min_size=1, max_size=5).map("".join)


@FEW
@given(st.lists(st.lists(PIECE, min_size=1, max_size=3).map("/".join), min_size=20, max_size=40), st.lists(GLOB, min_size=1, max_size=3))
def test_exclusion_agrees_with_shell_globs(spark, names, patterns):
    def by_hand(name):
        parts = name.split("/")
        for pattern in patterns:
            clean = pattern.rstrip("/")
            candidates = [(name, clean), (name, pattern), *[(p, clean) for p in parts]]
            if any(fnmatch.fnmatchcase(value, glob) for value, glob in candidates):
                return True
        return False

    df = spark.createDataFrame([(n,) for n in set(names)], "x string")
    got = {r[0]: r[1] for r in df.select("x", globs.excluded(F.col("x"), tuple(patterns))).collect()}
    assert got == {n: by_hand(n) for n in set(names)}


def test_size_text(spark):
    got = [one(spark, n, text.human_size, "long") for n in (0, 1024, 1048575, 1048576, 5 * 1048576 + 300_000)]
    assert got == ["0.0 KiB", "1.0 KiB", "1024.0 KiB", "1.0 MiB", "5.3 MiB"]


@pytest.mark.parametrize(
    ("content", "probe", "found"),
    [
        (b"ok\x00bad", 8192, True),
        (b"a" * 10_000 + b"\x00", 5000, False),
        (b"", 8192, False),
        (b"\xe0\x00\x00a", 8192, True),
        (b"\xf0\x00", 8192, True),
        (b"\x10\x01", 8192, False),
        (b"a" * 8191 + b"\x00", 8192, True),
        (b"a" * 8192 + b"\x00", 8192, False),
    ],
)
def test_nul_probe(spark, content, probe, found):
    assert one(spark, bytearray(content), lambda x: text.has_nul(x, probe), "binary") is found


def test_window_names(spark):
    assert text.window_seconds(" 15M ") == 900
    assert text.window_seconds("all") is None and text.window_seconds("  ") is None
    with pytest.raises(ValueError):
        text.window_seconds("2w")
    assert one(spark, " 1H", text.clean_window_key) == "1h"
    with pytest.raises(Exception, match="unknown window"):
        one(spark, "2w", text.clean_window_key)


def test_extension_list(spark):
    assert one(spark, "log, .TXT,,LOG , ", paths.clean_extension_list) == [".log", ".txt"]


@pytest.mark.parametrize(
    ("sender", "ok"), [("alpha", True), ("a" * 64, True), ("a" * 65, False), ("-a", False), ("a b", False), ("A_1-x", True), ("", False)]
)
def test_sender_id(spark, sender, ok):
    assert one(spark, sender, text.valid_sender_id) is ok


@pytest.mark.parametrize("secret", ["s", "clé", "k" * 64, "k" * 65, "x" * 200])
def test_signature_is_hmac(spark, secret):
    message = '{"é":1}\n'
    pads = digests.with_signing_pads(spark.createDataFrame([(secret,)], "secret string"))
    got = pads.select(digests.signature(F.lit(message), F.col("ipad"), F.col("opad"))).first()[0]
    assert got == "sha256=" + hmac.new(secret.encode(), message.encode(), hashlib.sha256).hexdigest()


@FEW
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x2030, exclude_categories=["Cs"])), min_size=10, max_size=20))
def test_canonical_text_of_any_string(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = [r[0] for r in df.select(canonical.lower_escapes(F.to_json(F.struct("x")))).collect()]
    assert got == [json.dumps({"x": v}, ensure_ascii=False, separators=(",", ":")) for v in values]


def test_audit_line_keeps_order_and_nulls(spark):
    values = dict(
        ts="t", event="accept", sender_id="a", bundle_id="b", remote_addr="r", byte_count=1, file_count=2,
        reject_reason=None, receipt_sha256="x", prev_hash="0",
    )
    cols = {k: F.lit(v) for k, v in values.items()}
    line = spark.range(1).select(canonical.audit_line(**cols)).first()[0]
    assert line == json.dumps(values, separators=(",", ":"))
    head = spark.range(1).select(canonical.audit_line_head(**cols)).first()[0]
    assert f'{head}0"}}' == line


def test_bundle_id_is_a_version_7_uuid(spark):
    import uuid

    made = [r[0] for r in spark.range(50).select(ids.uuid7(F.lit("2026-04-19 08:12:00").cast("timestamp"))).collect()]
    assert len(set(made)) == 50
    for value in made:
        parsed = uuid.UUID(value)
        assert parsed.version == 7 and parsed.variant == uuid.RFC_4122
        assert parsed.int >> 80 == 1776586320000
