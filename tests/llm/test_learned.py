import math
import random
import zlib

import numpy as np
import pytest

from stowage.llm import language, toxicity

CLEAN = "the and of with them water stone light house garden river over under every many walk talk green blue".split()
BAD = ["rotten", "vilest", "rottenly"]


def bags(n, seed, toxic_share=0.25):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choices(CLEAN, k=rng.randint(3, 9))) for _ in range(rng.randint(1, 12))]
        toxic = rng.random() < toxic_share
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(BAD) + " end"
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic), 1))
    return rows, labels


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    label = np.array([1, 0, 1])
    sentences_of, lengths = np.array([2, 1, 3]), np.array([2, 0, 3, 1, 1, 2])
    features = rng.integers(0, 5, lengths.sum())
    weights, bias = rng.normal(size=5), -1.0
    gradient, _ = toxicity.bag_gradient(label, sentences_of, lengths, features, weights, bias)
    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-6
        up = toxicity.bag_gradient(label, sentences_of, lengths, features, weights + step[:5], bias + step[5])[1]
        down = toxicity.bag_gradient(label, sentences_of, lengths, features, weights - step[:5], bias - step[5])[1]
        assert gradient[k] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-7)


def test_noisy_or():
    z = np.array([-1.0, 0.5, -30.0])
    p = 1 / (1 + np.exp(-z))
    assert toxicity.noisy_or(z) == pytest.approx(1 - np.prod(1 - p))


@pytest.fixture(scope="module")
def learned(spark):
    rows, labels = bags(900, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    return docs, dict((i, t) for i, t, _ in labels), toxicity.train(docs, marks.filter("doc_id < 700"))


def test_toxicity_holds_out(spark, learned):
    docs, labels, model = learned
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [i for i in scores if i >= 700]
    assert len(scores) == 900 and all(0 <= s <= 1 for s in scores.values())
    right = sum((scores[i] >= 0.5) == labels[i] for i in held) / len(held)
    assert right > 0.97
    kept = {r["doc_id"] for r in toxicity.kept_rows(docs, model).collect()}
    assert kept == {i for i, s in scores.items() if s < 0.5}


def test_toxicity_locates_the_sentence(learned):
    docs, labels, model = learned
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = toxicity.locate(docs, model).collect()
    assert found and all(texts[r["doc_id"]][r["start"] : r["end"]] == r["sentence"] for r in found)
    assert sum(any(b in r["sentence"] for b in BAD) for r in found) / len(found) > 0.97


def test_toxicity_odd(spark, odd_docs, no_docs, learned):
    model = learned[2]
    found = toxicity.score(odd_docs, model).collect()
    assert len(found) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in found)
    kept = toxicity.kept_rows(odd_docs, model)
    assert kept.schema == odd_docs.schema and kept.count() == len(found)
    assert toxicity.score(no_docs, model).count() == 0
    labels = "doc_id long, toxic int"
    nothing = toxicity.train(odd_docs, spark.createDataFrame([], labels))
    assert {r["score"] for r in toxicity.score(odd_docs, nothing).collect()} == {0.0}
    one_class = toxicity.train(odd_docs, spark.createDataFrame([(1, 1), (None, 0), (3, None), (999, 0)], labels))
    assert {r["score"] for r in toxicity.score(odd_docs, one_class).collect()} == {1.0}
    assert toxicity.locate(odd_docs, nothing).count() == 0


def brute_ngrams(text):
    points = [ord(c) for c in text.lower()]
    found = []
    for n in language.ORDERS:
        for i in range(len(points) - n + 1):
            h = n * 0x27D4EB2F & 0xFFFFFFFF
            for k in range(n):
                h = ((h ^ points[i + k]) * language._FACTORS[k]) & 0xFFFFFFFF
                h ^= h >> 15
            found.append(h & (language.WIDTH - 1))
    return found


def test_ngrams_stay_within_texts():
    texts = ["", "a", "ab", "Ünï 漢", "\U0001f600x", "abc" * 5]
    buckets, counts = language.ngrams(texts)
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert sorted(buckets[at : at + n].tolist()) == sorted(brute_ngrams(text))
        at += n
    assert at == len(buckets)


SYLLABLES = {"en": ["the", "ing", "wh", "ou", "th"], "fr": ["eau", "qu", "é", "tion", "les"], "de": ["sch", "ung", "ich", "ß", "der"]}


def speech(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(1, 30))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_language_equals_brute_force(spark):
    rows = speech(300, 1) + [(900, None, "en"), (901, "eau the", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    counts = {lang: {} for lang in SYLLABLES}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            for b in brute_ngrams(text):
                counts[lang][b] = counts[lang].get(b, 0) + 1
    n = {lang: sum(1 for _, t, x in rows if x == lang and t is not None) for lang in SYLLABLES}
    assert model.languages == sorted(SYLLABLES)
    found = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    for doc_id, text, _ in rows[:60]:
        logits = {}
        for lang, own in counts.items():
            total = sum(own.values()) + language.SMOOTHING * language.WIDTH
            logits[lang] = math.log(n[lang] / sum(n.values())) + sum(
                math.log((own.get(b, 0) + language.SMOOTHING) / total) for b in brute_ngrams(text)
            )
        best = max(logits, key=logits.get)
        assert found[doc_id]["lang_pred"] == best
        chance = 1 / sum(math.exp(v - logits[best]) for v in logits.values())
        assert found[doc_id]["score"] == pytest.approx(chance, abs=1e-3)


def test_language_holds_out(spark):
    rows = speech(800, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    model = language.fit(docs.filter("crc32(cast(doc_id as string)) % 4 <> 2"))
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).collect()}
    held = [(i, lang) for i, _, lang in rows if fold(i) == 2]
    assert held and sum(found[i] == lang for i, lang in held) / len(held) > 0.97


def test_language_odd(spark, odd_docs, no_docs):
    model = language.fit(odd_docs)
    found = language.predict(odd_docs, model).select("doc_id", "lang_pred", "score").collect()
    assert len(found) == odd_docs.count()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for r in found:
        lettered = any(c.isalpha() for c in texts[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == (not lettered)
        assert 0 < r["score"] <= 1 if lettered else r["score"] == 0
    assert language.predict(no_docs, model).count() == 0
    untrained = language.fit(no_docs)
    assert {r["lang_pred"] for r in language.predict(odd_docs, untrained).collect()} == {"und"}
