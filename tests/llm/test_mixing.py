import math
import re
from collections import defaultdict

import pytest
from frames import broadcast_parts

from stowage.llm import mixing


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    """Share by weight, stop at the limit, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = float(cap * sizes[s])
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def brute_rates(docs, target, cap=3):
    """The tilt by bisection."""
    total = sum(docs)
    if target >= cap * total * (1 - 1e-12):
        return [cap] * len(docs)
    mean = total / len(docs)
    low, high = -1e6, 1e6
    rate = lambda t, x: min(cap, math.exp(min(50, t * x / mean)))
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(x * rate(mid, x) for x in docs) < target else (low, mid)
    return [rate(low, x) for x in docs]


def corpus(spark):
    rows = []
    for i in range(600):
        source = ["a", "b", "c", "d", "é", None, "tiny", "one"][i % 8]
        n = {"tiny": 2, "one": 40}.get(source, 1 + (i * 37) % 211)
        rows.append((i, " ".join(["w"] * n), source))
    rows += [(700, None, "a"), (701, " \n", "b"), (702, "", "void")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_mix_meets_targets(spark):
    docs, rows = corpus(spark)
    found = mixing.mix(docs).collect()
    sizes, by_source = defaultdict(int), defaultdict(list)
    for doc_id, text, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        by_source[source].append((doc_id, n))
    want = brute_targets(sizes)
    got = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows) == len(got)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for source, docs_of in by_source.items():
        rates = dict(zip((i for i, n in docs_of if n), brute_rates([n for _, n in docs_of if n], want[source]), strict=True)) if sizes[source] else {}
        taken = 0
        for doc_id, n in docs_of:
            r = got[doc_id]
            assert (r["source"], r["size"], r["source_size"]) == (source, n, sizes[source])
            assert r["target"] == pytest.approx(want[source], rel=1e-12)
            assert r["taken"] == r["copies"] * n <= 3 * n
            if n:
                assert r["rate"] == pytest.approx(rates[doc_id], rel=1e-5)
                assert abs(r["copies"] - r["rate"]) < 1
            taken += r["taken"]
        assert abs(taken - want[source]) <= max(n for _, n in docs_of) + 1e-6


def test_mix_is_repeatable_and_rows_follow_it(spark):
    docs, _ = corpus(spark)
    first = sorted(mixing.mix(docs).select("doc_id", "taken").collect())
    assert sorted(mixing.mix(docs.repartition(5)).select("doc_id", "taken").collect()) == first
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    rows = defaultdict(int)
    mixed = mixing.mixed_rows(docs)
    assert mixed.schema == docs.schema
    for r in mixed.collect():
        rows[r["doc_id"]] += 1
    assert dict(rows) == {k: v for k, v in copies.items() if v}


def test_mix_odd(odd_docs, no_docs):
    found = mixing.mix(odd_docs).collect()
    assert len(found) == odd_docs.count()
    assert sum(r["target"] for r in {r["source"]: r for r in found}.values()) == pytest.approx(sum(r["size"] for r in found))
    mixed = mixing.mixed_rows(odd_docs)
    assert mixed.schema == odd_docs.schema
    assert mixed.count() == sum(r["copies"] for r in found)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_rows(no_docs).count() == 0


def test_one_source_keeps_everything(spark):
    docs = spark.createDataFrame([(i, "w " * (i + 1), "s") for i in range(50)], "doc_id long, text string, source string")
    assert all(r["copies"] == 1 for r in mixing.mix(docs).collect())


def test_small_tables_are_few_files(spark, monkeypatch):
    """One row a source is no reason for a file a source: every file costs its executor child processes."""
    docs, rows = corpus(spark)
    own, files, conf = mixing.through_table, defaultdict(list), {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}

    def counted(df, label):
        written = own(df, label)
        files[label].append(len(written.inputFiles()))
        return written

    monkeypatch.setattr(mixing, "through_table", counted)
    monkeypatch.setattr(mixing, "prepared", lambda session: session)
    before = {key: spark.conf.get(key) for key in conf}
    want = sorted(mixing.mix(docs.coalesce(2)).select("doc_id", "copies", "taken").collect())
    files.clear()
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        found = sorted(mixing.mix(docs.coalesce(2)).select("doc_id", "copies", "taken").collect())
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert found == want and len(found) == len(rows)
    assert set(files["mix-state"]) == {1} and files["mix-cells"][0] <= 2 >= files["mix-sizes"][0]
    assert sum(map(sum, files.values())) <= 6 + len(files["mix-state"])


def test_rows_of_all_documents_are_not_broadcast(spark):
    """Their table is a small file of many rows."""
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('word ', CAST(id % 9 AS INT)) AS text", "'s' AS source")
    assert not any("FileScan parquet [doc_id" in part for part in broadcast_parts(mixing.mix(docs)))
