import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_dedup import brute_components, brute_fingerprint

from stowage.llm import mixing, queries, toxicity

FOUL, PLAIN = "vile rotten scum filth hate".split(), "river stone cloud maple winter lantern harbour meadow".split()


def text_of(rng, words, n):
    return " ".join(rng.choices(words, k=n)) + "."


@pytest.fixture()
def tables(spark, tmp_path):
    """Documents of every awkward kind with columns that clash with inner names, and labels, as a data folder."""
    rng = random.Random(4)
    rows = []
    for i in range(160):
        foul = i % 8 == 3
        text = " ".join(text_of(rng, FOUL if foul and k == 1 else PLAIN, 12) for k in range(3))
        rows.append([i, text, "en", f"s{i % 3}", len(text)])
    copies = [[200 + i, rows[i][1], "de", "s1", 1] for i in range(0, 40, 2)]
    near = [[300 + i, rows[i][1].replace(".", " .").replace(" .", "."), None, None, None] for i in range(0, 20, 5)]
    upper = [[400 + i, rows[i][1].upper(), "en", "s0", 3] for i in range(1, 30, 4)]
    odd = [[None, "null id " + rows[5][1], "en", None, 1], [None, None, None, None, None], [500, "", "en", "s2", 0], [501, "word " * 1_500, "en", "s2", 1]]
    everything = rows + copies + near + upper + odd + [list(rows[0])]
    data = [
        (*r, {"k": str(i % 2)}, f"clash {i % 3}", i % 5, [i], f"r{i}") for i, r in enumerate(everything)
    ]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, "
        "extra map<string,string>, __key string, __rank int, __rows array<int>, row string"
    )
    spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 8 == 3)) for i in range(160)] + [(None, None, None), (999, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def collected(frame):
    return [r.asDict() for r in frame.collect()]


def by_row(rows):
    return sorted(r["row"] for r in rows)


def test_every_stage_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "mixing", "pieces"]

    labels = spark.read.parquet(f"{tables}/labels.parquet")
    scored = toxicity.score(docs, queries.toxic_model(docs, labels))
    kept = stages["toxicity"](spark, docs, tables)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    scores = Counter((r["doc_id"], r["score"] >= 0.5) for r in scored.collect())
    left = collected(kept)
    assert Counter(r["doc_id"] for r in left) == Counter({i: n for (i, bad), n in scores.items() if not bad})
    foul = {r["doc_id"] for r in collected(docs) if r["doc_id"] is not None and r["doc_id"] < 160 and r["doc_id"] % 8 == 3}
    assert len(foul & {r["doc_id"] for r in left}) <= 2 and len({r["doc_id"] for r in left} - foul) >= 150

    groups = defaultdict(list)
    for r in left:
        groups[r["text"] or ""].append(r)
    # Largest id, nulls smallest; then the first in order of all columns, of which `row` breaks ties last here.
    def first(rows):
        top = max((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows)
        return [r for r in rows if (r["doc_id"] is not None, r["doc_id"] or 0) == top]

    deduped = stages["exact dedup"](spark, kept, tables)
    got = collected(deduped)
    assert deduped.schema == docs.schema and len(got) == len(groups)
    for r in got:
        assert r["row"] in {c["row"] for c in first(groups[r["text"] or ""])}

    near = stages["simhash near-dedup"](spark, deduped, tables)
    components = defaultdict(list)
    for r, c in zip(got, brute_components([brute_fingerprint(r["text"] or "") for r in got]), strict=True):
        components[c].append(r)
    order = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert near.schema == docs.schema and by_row(collected(near)) == by_row(min(g, key=order) for g in components.values())

    mixed = stages["mixing"](spark, near, tables)
    assert mixed.schema == docs.schema
    times = Counter(r["row"] for r in mixed.collect())
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(near).filter("doc_id IS NOT NULL").collect()}
    for r in collected(near):
        assert times[r["row"]] <= mixing.CAP
        if r["doc_id"] is not None:
            assert times[r["row"]] == taken[r["doc_id"]]
        if not (r["text"] or "").split():
            assert times[r["row"]] == 0

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = stages["pieces"](spark, mixed, tables)
    want = sorted((str(r["doc_id"]), library.encode(r["text"] or "")) for r in collected(mixed))
    assert sorted((str(r["doc_id"]), r["ids"]) for r in collected(pieces)) == want


def test_run_is_its_stages(spark, tables):
    found = corpus_pipeline.run(spark, tables)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
    digest = lambda frame: sorted(map(tuple, frame.select("doc_id", "n_tokens", "ids_sha256").collect()), key=str)
    assert digest(found) == digest(docs) and found.count() > 100


def test_empty_tables_go_through(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").filter(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        if name == "toxicity":
            continue  # without documents there is nothing to learn from
        docs = stage(spark, docs, tables)
        assert docs.count() == 0
