import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from stowage.llm import outliers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def brute_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def brute_vector(counts):
    n, letters, symbols, lines, repeats = counts
    return [
        round(1000 * x)
        for x in (
            math.log1p(n),
            math.log((letters + 250) / (n + 50)),
            math.log1p(100 * symbols / (letters + 250)),
            math.log1p(100 * lines / (n + 50)),
            math.log1p(100 * repeats / (n + 50)),
        )
    ]


def prose(rng, words):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(words))


def junk(rng, words):
    return " ".join(w + rng.choice(["***", "$$$", "###"]) for w in prose(rng, words).split())


def table(spark, seed=1, groups=(("en", "a", 400), ("de", "b", 150), (None, None, 40), ("en", None, 80))):
    """Prose with one junk document in twenty, in groups of which the last two are pooled."""
    rng = random.Random(seed)
    rows, bad = [], set()
    for lang, source, n in groups:
        for i in range(n):
            size = rng.randint(20, 300)
            if i % 20 == 7:
                bad.add(len(rows))
            rows.append((len(rows), (junk if i % 20 == 7 else prose)(rng, size), lang, source))
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows, bad


def test_counts_equal_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        texts = [
            "".join(rng.choice(rng.choice(["a b", "ab \n", "é a #|\n\t", "a", "\r\x0b 漢"])) for _ in range(size))
            for size in rng.choices([0, 1, 9, 10, 40, 300], k=rng.choice([1, 2, 20]))
        ]
        assert outliers.counts_of([t.encode() for t in texts]) == [brute_counts(t) for t in texts]


def test_odd_rows(odd_docs, no_docs):
    found = outliers.judged(odd_docs)
    want = []
    for r in odd_docs.collect():
        counts = brute_counts(r["text"] or "")
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        want.append((r["doc_id"], *counts, failed, not failed))  # too few for an estimate
    columns = ["doc_id", *outliers.COUNTS, "base_failed", "kept"]
    assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted(want, key=str)
    assert outliers.judged(no_docs).count() == 0


def test_junk_is_rejected_and_prose_kept(spark):
    docs, rows, bad = table(spark)
    found = {r["doc_id"]: r for r in outliers.judged(docs).collect()}
    assert len(found) == len(rows)
    assert {i for i, r in found.items() if not r["kept"]} == bad
    assert not any(r["base_failed"] for r in found.values())


def test_a_long_text_is_no_outlier(spark):
    rng = random.Random(9)
    docs, rows, bad = table(spark)
    long = spark.createDataFrame([(10_000, prose(rng, 60_000), "en", "a")], SCHEMA)
    found = outliers.judged(docs.unionByName(long)).filter("doc_id = 10000").first()
    assert found["kept"] and found["n_words"] == 60_000


def test_estimates_equal_a_slow_version(spark):
    """Concentration in numpy on the sorted rows of a group: near the binned one, and no better determinant."""
    docs, rows, _ = table(spark, groups=(("en", "a", 600),))
    measured = outliers.measured(docs)
    vectors = measured.select("lang_key", "source_key", *(f"x{i}" for i in range(5)))
    estimate = outliers.estimates(vectors).first()
    x = np.array([brute_vector(brute_counts(t)) for _, t, _, _ in rows], float)
    assert sorted(map(tuple, measured.select(*(f"x{i}" for i in range(5))).collect())) == sorted(map(tuple, x.astype(int)))
    floors = np.diag((1000 * np.array(outliers.FLOORS)) ** 2)
    middle = np.median(x, axis=0)
    scatter = np.diag((1.4826 * np.median(np.abs(x - middle), axis=0)) ** 2) + floors
    h = int(outliers.H_SHARE * len(x))
    for _ in range(100):
        off = x - middle
        d2 = np.einsum("ij,jk,ik->i", off, np.linalg.inv(scatter), off)
        near = x[np.argsort(d2, kind="stable")[:h]]
        middle, scatter = near.mean(axis=0), np.cov(near.T, bias=True) + floors
    assert abs(estimate["logdet"] - np.linalg.slogdet(scatter)[1]) < 0.02
    # Both bins and sorted rows may end at neighbouring subsets.
    assert np.allclose(estimate["centre"], middle, rtol=0.02, atol=15)


def test_reruns_and_partitions_agree(spark):
    docs, _, _ = table(spark)
    a = sorted(map(tuple, outliers.judged(docs).collect()))
    b = sorted(map(tuple, outliers.judged(docs.repartition(11, F.rand(3))).collect()))
    assert a == b


def test_chi_squared():
    assert abs(outliers.chi2_quantile(0.95, 5) - 11.0705) < 1e-3
    assert abs(outliers.chi2_cdf(7.779, 4) - 0.9) < 1e-3
    rng = np.random.default_rng(1)
    d2 = np.sort((rng.normal(size=(400_000, 5)) ** 2).sum(axis=1))[:300_000]
    # The nearest three quarters of normal vectors vary so much less.
    assert abs(5 / d2.mean() - outliers.consistency(0.75, 5)) < 0.01
