import hashlib
import math
import random
import re
import zlib

import numpy as np

from stowage.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_features(text):
    words = WORD.findall(text.translate(LOWER))
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute(rows, target):
    """Rows as (doc_id, n_words, n_features, weight, score, rank), in lists of features and Python numbers."""
    found = [(i, *brute_features(t or "")) for i, t in rows]
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, _, buckets in found:
        np.add.at(s, buckets, 1)
    for text in target:
        np.add.at(t, brute_features(text or "")[1], 1)
    s_all, t_all = int(s.sum()), int(t.sum())
    gain = [
        math.floor(1000 * math.log((int(t[b]) + 1) * (s_all + 10_000) / ((int(s[b]) + 1) * (t_all + 10_000))))
        for b in range(10_000)
    ]
    scored = []
    for i, n, buckets in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets)
        scored.append([i, n, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    enough = sorted((r for r in scored if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for rank, row in enumerate(enough[: 5 * len(enough) // 100], 1):
        row[5] = rank
    return sorted(map(tuple, scored), key=str)


def odd_text(rng):
    letters = rng.choice(["a B", "abZ \n", "é9 #|\n\t", "a", "漢 ", "the of and\0"])
    return "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 9, 40, 300, 3000])))


def test_features_and_weights_equal_brute_force():
    rng = random.Random(2)
    for trial in range(60):
        texts = [odd_text(rng) for _ in range(rng.choice([1, 2, 20, 150]))]
        if trial % 5 == 0:
            texts.append("x" * 700 + " y " + "z" * 65 + " " + "W" * 64 + " q")
        words, own, bucket = resample.features([t.encode() for t in texts])
        planes = resample.planes_of(len(texts), own, bucket)
        gains = np.array([rng.randint(-30_000, 30_000) for _ in range(resample.BUCKETS)])
        weights = resample.weights_of(planes, *resample.gain_planes(gains))
        for i, text in enumerate(texts):
            n, buckets = brute_features(text)
            assert words[i] == n and sorted(bucket[own == i].tolist()) == sorted(buckets)
            assert weights[i] == sum(int(gains[b]) for b in buckets)


def test_gain_planes_hold_the_ends():
    for gains in ([0], [-1], [1], [-8, 7], [8, -7], [2**40, -(2**40)]):
        every = np.zeros(resample.BUCKETS, np.int64)
        every[: len(gains)] = gains
        plane, worth = resample.gain_planes(every)
        bits = np.unpackbits(plane.view(np.uint8), axis=1, count=resample.BUCKETS, bitorder="little").astype(np.int64)
        assert (bits * worth[:, None]).sum(axis=0).tolist() == every.tolist()


def test_odd_rows(spark, odd_docs, no_docs):
    target = spark.createDataFrame([("one two three",), (None,)], "text string")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = resample.resample(odd_docs, target)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, ["one two three", None])
    assert resample.resample(no_docs, target).count() == 0
    assert resample.resample(odd_docs, target.limit(0)).count() == len(rows)


def test_draw_over_ranges_and_ties(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(5, 80)))) for i in range(900)]
    rows += [(900 + i, rows[0][1]) for i in range(300)] + [(5, rows[7][1]), (None, rows[8][1]), (None, rows[9][1])] + rows[:20]
    target = [" ".join(rng.choices(words[:40], k=60)) for _ in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    found = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == brute(rows, target)
    ranks = sorted(r[5] for r in got if r[5] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 40
