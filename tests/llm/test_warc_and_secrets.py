import gzip
import hashlib
import json
import re
from collections import defaultdict

import pytest

from stowage.llm import blob_ledger, warc

# -- secrets ------------------------------------------------------------------

SECRETS = [
    None,
    "",
    'password = "hunter22" and Token:abcdefgh',
    "token:token: abcdef",
    "apikey=abc APIKEY=abcdefgh api_key: 'zzzzzz'",
    "paſſword=abcdefgh toKen=abcdefgh",
    "AKIA" + "A" * 16 + " AKIASHORT AKIA" + "B9" * 10,
    "x" + "0123456789abcdef" * 2 + "G" + "a" * 23 + " " + "f" * 24,
    "secret=" + "a" * 24,
    "é漢\U0001f600 passwd=abcdef",
    "long " * 40_000 + "secret: tail/end+x",
]


def brute_spans(text):
    text = text or ""
    kinds = (
        ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
        ("access", r"(AKIA[A-Z0-9]+)", 20),
        ("hex", r"([0-9a-f]+)", 24),
    )
    found = []
    for place, (kind, pattern, least) in enumerate(kinds):
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m[1]) >= least:
                found.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return [f[2] for f in sorted(found)]


def summed(found):
    return found.select("doc_id", "n_assign", "n_access", "n_hex", blob_ledger.listed(found).alias("spans"))


def expected(rows):
    want = []
    for doc_id, text in rows:
        spans = brute_spans(text)
        want.append((doc_id, *(sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")), ",".join(spans)))
    return sorted(want, key=str)


def test_secrets_equal_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(SECRETS)] + [(100 + i, SECRETS[2]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = blob_ledger.scan(docs, str(tmp_path / "ledger"))
    assert sorted(map(tuple, summed(found).collect()), key=str) == expected(rows)
    ledger = blob_ledger.read_ledger(spark, str(tmp_path / "ledger"))
    assert ledger.count() == 3 * len({t or "" for _, t in rows})


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    rows = [(i, t) for i, t in enumerate(SECRETS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    blob_ledger.scan(docs, folder).count()
    more = docs.union(spark.createDataFrame([(500, "secret=brandnew"), (501, SECRETS[2])], docs.schema))
    versions = lambda d: d.selectExpr(
        "doc_id AS version", "sha2(coalesce(text, ''), 256) AS blob", "coalesce(text, '') AS body"
    )
    ledger = blob_ledger.read_ledger(spark, folder)
    assert blob_ledger.scan_new(versions(docs), ledger).count() == 0
    new = blob_ledger.scan_new(versions(more), ledger).collect()
    assert {r["blob"] for r in new} == {hashlib.sha256(b"secret=brandnew").hexdigest()} and len(new) == 3
    found = blob_ledger.scan(more, folder)
    assert sorted(map(tuple, summed(found).collect()), key=str) == expected([(r[0], r[1]) for r in more.collect()])
    # A new version of one rule is all that is scanned next.
    second = tuple(
        blob_ledger.Rule(r.name, 2, r.pattern, r.group, 30, r.any_case) if r.name == "hex" else r for r in blob_ledger.RULES
    )
    todo = blob_ledger.scan_new(versions(more), blob_ledger.read_ledger(spark, folder), second).collect()
    assert {(r["rule"], r["rule_version"]) for r in todo} == {("hex", 2)}
    assert len(todo) == len({t or "" for _, t in rows}) + 1


def test_secrets_odd(odd_docs, no_docs, tmp_path):
    found = blob_ledger.scan(odd_docs, str(tmp_path / "a"))
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted(map(tuple, summed(found).collect()), key=str) == expected(rows)
    assert blob_ledger.scan(no_docs, str(tmp_path / "b")).count() == 0


# -- WARC ---------------------------------------------------------------------


def brute_captures(rows):
    newest = defaultdict(list)
    for page_id, html in rows:
        newest[html or ""].append(page_id)
    found = set()
    for page_id, html in rows:
        data = (html or "").encode()
        ids = [i for i in newest[html or ""] if i is not None]
        top = max(ids) if ids else None
        revisit = len(data) >= 1000 and page_id != top
        found.add((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(found, key=str)


def pages(spark):
    big, wide = "<p>" + "x" * 1200, "é" * 500
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else f"<b>{i}</b>" * (i % 7) * 30) for i in range(200)]
    rows += [
        (300, None, None), (301, "http://h/\r\nX: y", ""), (302, "u", None), (303, "u", "s" * 999), (304, "u", "s" * 999),
        (305, "u", wide), (306, "u", wide), (307, "u", "z" * 300_000), (None, "u", big), (None, "u", "alone" * 300),
        (-5, "u", "r\r\n\r\nWARC/1.1\r\n" * 100),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), [(r[0], r[2]) for r in rows]


def test_archive_round_trip(spark):
    frame, rows = pages(spark)
    found = warc.archive(frame.repartition(5))
    assert sorted(set(map(tuple, found.collect())), key=str) == brute_captures(rows)
    assert found.count() == len(rows)


def test_archive_odd(spark):
    frame, _ = pages(spark)
    assert warc.archive(frame.limit(0)).count() == 0
    twice = frame.union(frame).selectExpr("*", "page_id AS digest", "html AS payload")
    assert warc.archive(twice).count() == 2 * frame.count()


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_filters_reach_the_reader(spark, tmp_path, compression):
    frame, rows = pages(spark)
    folder = str(tmp_path / "w")
    warc.with_warc(spark)
    warc.captures(frame).write.format("warc").option("compression", compression).mode("append").save(folder)
    read = spark.read.format("warc").option("partitionBytes", 4096)
    assert read.load(folder).count() == len(rows)
    revisits = read.load(folder).filter("warc_type = 'revisit' AND content_length = 0")
    plan = revisits._jdf.queryExecution().executedPlan().toString()
    assert "content_length" in plan and re.search(r"Filter [^\n]*warc_type", plan) is None
    want = sum(1 for r in brute_captures(rows) if r[3] == "revisit")
    assert revisits.count() == want
    some = read.load(folder).filter("record_id IN ('<urn:page:303>', '<urn:page:307>')").collect()
    assert sorted(len(r["payload"]) for r in some) == [999, 300_000]
    bare = read.option("payload", "false").load(folder).filter("warc_type = 'response'").collect()
    assert all(r["payload"] is None for r in bare) and max(r["content_length"] for r in bare) == 300_000
    # Files of a failed write are in no list.
    (tmp_path / "w" / "lost.warc").write_bytes(b"rubbish")
    assert read.load(folder).count() == len(rows)


def test_foreign_archives(spark, tmp_path):
    """Members without the length field, and headers in other cases and orders."""
    record = lambda n, body: (
        b"WARC/1.0\r\ncontent-length: %d\r\nWARC-Target-URI: http://x/%d\r\nwarc-type: response\r\nWARC-Filename:\r\n a b\r\n\r\n"
        % (len(body), n)
        + body
        + b"\r\n\r\n"
    )
    bodies = [b"", b"abc", b"q" * 50_000, b"\r\n\r\n" * 9]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(i, b)) for i, b in enumerate(bodies)))
    (tmp_path / "b.warc").write_bytes(b"".join(record(i, b) for i, b in enumerate(bodies)))
    warc.with_warc(spark)
    found = spark.read.format("warc").load(str(tmp_path)).collect()
    assert sorted(bytes(r["payload"]) for r in found) == sorted(bodies * 2)
    none = spark.read.format("warc").load(str(tmp_path)).filter("warc_type = 'revisit'")
    assert none.count() == 0
    (tmp_path / "x.committed").write_text(json.dumps(["b.warc"]))
    assert spark.read.format("warc").load(str(tmp_path)).count() == len(bodies)
