import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from frames import broadcast_parts
from hypothesis import given, settings
from hypothesis import strategies as st

from stowage.llm import components, exact_dedup, simhash
from stowage.llm import quotient_filter as qf
from stowage.session import through_table


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(1, 2**40)), max_size=30), max_size=5),
    st.sampled_from([0, 3, 8]),
)
def test_filters_merge_without_loss(parts, bits):
    block = 5 if bits else 0
    want = defaultdict(int)
    filters = []
    for part in parts:
        own = defaultdict(int)
        for value, n in part:
            value = (value >> bits) | (block << (64 - bits)) if bits else value
            own[value] += n
            want[value] += n
        values = np.array(sorted(own), np.uint64)
        filters.append(qf.encode(values, np.array([own[int(v)] for v in values], np.int64), bits))
    values, counts = qf.merged([qf.decode(f, block, bits) for f in filters])
    assert dict(zip(values.tolist(), counts.tolist(), strict=True)) == want
    again = qf.decode(qf.encode(values, counts, bits), block, bits)
    assert again[0].tolist() == values.tolist() and again[1].tolist() == counts.tolist()


def exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    found = []
    for doc_id, text in rows:
        ids = [i for i in groups[text or ""] if i is not None]
        keep = max(ids) if ids else None
        sha = hashlib.sha256((text or "").encode()).hexdigest()
        found.append((doc_id, keep, len(groups[text or ""]), doc_id == keep, sha))
    return sorted(found, key=str)


def test_exact_dedup_odd(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = exact_dedup.exact_dedup(odd_docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, found.collect()), key=str) == exact(rows)
    kept = exact_dedup.kept_rows(odd_docs)
    assert kept.schema == odd_docs.schema
    texts = [r["text"] or "" for r in kept.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in rows})
    assert exact_dedup.exact_dedup(no_docs).count() == 0 and exact_dedup.kept_rows(no_docs).count() == 0


def test_exact_dedup_hot_text(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 500}") for i in range(3000)]
    found = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert sorted(map(tuple, found.collect()), key=str) == exact(rows)


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Smallest id reachable over pairs within two bits."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprint_equals_brute_force():
    rng = random.Random(3)
    for text in ["", " ", "A b", "Ünï côde WORDS\x0bhere", *(" ".join(rng.choices("aé B c\t".split(" "), k=k)) for k in range(40))]:
        assert simhash.fingerprint(text) == brute_fingerprint(text), text


def near_fingerprints(rng, n):
    base = [rng.getrandbits(64) for _ in range(n // 8)]
    found = []
    for _ in range(n):
        fp = rng.choice(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            fp ^= 1 << rng.randrange(64)
        found.append(fp)
    return found


def as_long(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("distance, most", [(2, 200), (2, 3), (3, 3)])
def test_links_lose_no_near_pair(spark, monkeypatch, distance, most):
    """Also where many fingerprints share a segment, which then is not looked up."""
    monkeypatch.setattr(simhash, "MOST_A_VALUE", most)
    rng = random.Random(5)
    fps = near_fingerprints(rng, 160) + [0, 1, 3, (1 << 64) - 1, (1 << 63) - 1, 1 << 63]
    fps += [(0xABCDEF01 << 32) ^ (rng.choice([0, 1 << 40]) if i % 3 else 0) ^ (0b1011 << i % 20) for i in range(60)]
    fps += [0x12345678 ^ (1 << 33 + i % 25) ^ (rng.choice([0, 4]) if i % 2 else 0) for i in range(60)]
    distinct = sorted(set(fps))
    frame = spark.createDataFrame([(as_long(v),) for v in distinct], "fp long")
    got = sorted(map(tuple, simhash.links(frame, distance).collect()))
    want = [(u, v) for u in distinct for v in distinct if u != v and (u ^ v).bit_count() <= distance]
    assert got == sorted((as_long(u), as_long(v)) for u, v in want if as_long(u) < as_long(v))


def test_exploded_rows_are_not_broadcast(spark):
    """Nor the fingerprints they are looked up in: Spark takes an exploded frame for as small as its input."""
    stored = through_table(spark.range(1000).selectExpr("xxhash64(id) AS fp"), "test-fingerprints")
    found = simhash.links(stored)
    assert "Generate explode" in found._jdf.queryExecution().executedPlan().toString()
    assert not any("Generate explode" in part or "FileScan parquet [fp" in part for part in broadcast_parts(found))


def test_rows_of_all_documents_are_not_broadcast(spark):
    """Their table is a small file of many rows where fingerprints repeat."""
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('text of document ', id % 3) AS text")
    parts = broadcast_parts(simhash.near_duplicates(docs))
    assert not any("FileScan parquet [doc_id" in part for part in parts)


def test_components_of_a_long_chain(spark):
    links = spark.range(0, 400).selectExpr("id AS u", "id + 1 AS v").union(spark.range(1000, 1002).selectExpr("id AS u", "id AS v"))
    found = {r["node"]: r["root"] for r in components.roots(links).collect()}
    assert found == {i: 0 for i in range(1, 401)}


def test_near_duplicates_odd(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"] or "") for r in rows]
    found = brute_components(fps)
    least = defaultdict(list)
    for r, c in zip(rows, found, strict=True):
        if r["doc_id"] is not None:
            least[c].append(r["doc_id"])
    want = sorted(
        ((r["doc_id"], f"{fp:016x}", min(least[c], default=None)) for r, fp, c in zip(rows, fps, found, strict=True)), key=str
    )
    got = simhash.near_duplicates(odd_docs).select("doc_id", "fingerprint", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == want
    kept = simhash.kept_rows(odd_docs)
    assert kept.schema == odd_docs.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({w[2] for w in want})
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.kept_rows(no_docs).count() == 0


@pytest.mark.parametrize("n", [300])
def test_near_copies_of_one_document(spark, n):
    """A large group of near copies is one component, in whatever order they link."""
    rng = random.Random(9)
    words = [rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(40)) for _ in range(400)]
    rows = []
    for i in range(n):
        own = list(words)
        own[rng.randrange(len(own))] = f"edit{i}"
        rows.append((i, " ".join(own)))
    fps = [brute_fingerprint(t) for _, t in rows]
    want = brute_components(fps)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want))


def test_near_dedup_keeps_a_row_of_every_component(spark):
    """Null and shared ids: rows of other texts are documents of their own."""
    rng = random.Random(11)
    far = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(7)]
    rows = [(3, far[0], 1), (5, far[1], 2), (5, far[0], 3), (5, far[2], 4), (5, far[2], 0)]
    rows += [(None, far[3], 5), (None, far[4], 6), (None, far[4], 7), (None, far[0], 8), (None, far[5], 9), (9, far[6].upper(), 10), (9, far[6], 11)]
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    groups = defaultdict(list)
    for row, c in zip(rows, brute_components(fps), strict=True):
        groups[c].append(row)
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest(), r[2])
    want = sorted((min(g, key=order) for g in groups.values()), key=str)
    assert len(want) == 7
    kept = simhash.kept_rows(spark.createDataFrame(rows, "doc_id long, text string, z int").repartition(5))
    assert sorted(map(tuple, kept.collect()), key=str) == want
