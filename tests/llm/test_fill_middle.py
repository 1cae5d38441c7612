import hashlib
import random
import re

from pyspark.sql import functions as F

from stowage.llm import fill_middle

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text):
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def run(docs):
    made = fill_middle.transform(docs)
    back = fill_middle.restored(F.col("form"), F.col("output"))
    return sorted(map(tuple, made.withColumn("back", back).collect()), key=str)


def odd_text(rng):
    letters = rng.choice(["ab", "ab é漢 \n.", "x", "é漢\U0001f600", "abcdef .,\n0123", "<PSM>", "\0a"])
    return "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 60, 400, 9000])))


def test_counting_and_places():
    """With a memory so small that chunks are forgotten and met again."""
    rng, memory = random.Random(1), fill_middle.ChunkMemory(5000)
    for _ in range(40):
        texts = [odd_text(rng) for _ in range(30)]
        for text, counted in zip(texts, fill_middle.count_tokens([t.encode() for t in texts], memory), strict=True):
            tokens = list(TOKEN.finditer(text))
            assert counted.n == len(tokens)
            for at in [0, counted.n, *(rng.randint(0, counted.n) for _ in range(4))]:
                want = tokens[at].start() if at < counted.n else len(text)
                assert counted.place(at) == (len(text[:want].encode()), want)


def test_chunks_of_shared_passages_are_shared():
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefghij klmno") for _ in range(20_000))
    memory = fill_middle.ChunkMemory()
    first = fill_middle.count_tokens([("one " + passage).encode()], memory)[0]
    held = len(memory.young)
    second = fill_middle.count_tokens([(passage * 1 + " at another place").encode()], memory)[0]
    assert set(second.chunks[2:-2]) <= set(first.chunks) and len(memory.young) <= held + 4
    assert all(len(c) <= fill_middle.LONGEST for c in first.chunks)
    assert b"".join(second.chunks) == (passage + " at another place").encode()


def test_chunks_do_not_depend_on_neighbours():
    rng = random.Random(3)
    texts = [odd_text(rng).encode() for _ in range(50)]
    together = [c.chunks for c in fill_middle.count_tokens(texts, fill_middle.ChunkMemory())]
    assert together == [fill_middle.count_tokens([t], fill_middle.ChunkMemory())[0].chunks for t in texts]


def test_broken_utf8_ends():
    counted = fill_middle.count_tokens([b"\x80" * 20_000], fill_middle.ChunkMemory())[0]
    assert b"".join(counted.chunks) == b"\x80" * 20_000


def test_odd_rows(odd_docs, no_docs):
    want = [brute(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    assert run(odd_docs) == sorted(want, key=str)
    assert run(no_docs) == []


def test_forms_and_restoring(spark):
    rng = random.Random(4)
    rows = [(i, odd_text(rng)) for i in range(600)]
    rows += [(600 + i, t) for i, t in enumerate(["a<", "<P", "S>", "<<S>", "<P>", "x<M>y", "<P ", ">", "<"] * 4)]
    found = run(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert found == sorted((brute(i, t) for i, t in rows), key=str)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_other_shares(spark):
    docs = spark.createDataFrame([(i, "some words here") for i in range(200)], "doc_id long, text string")
    forms = {r["form"] for r in fill_middle.transform(docs, plain_of_100=0, suffix_first_of_100=100).collect()}
    assert forms == {"spm"}
