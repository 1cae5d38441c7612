import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from stowage.llm import pieces, records

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "a", "B", " ", "  ", "\n", "é", "́", "漢", "\0", "\t", "The", "ing", "Σ", "ΣΑΣ", "'s", "'", "▁", "​",
    "<|endoftext|>", "<|start", "oftext|>", "<s>", "<0x0A>", "　", "İ", "ǅ", "1", "½", " ", "\x85", "\xa0",
    "\U0001f600", "ﬁ", "①", "Å", "がﾞ", "\r", "\x1c", "각", "ᄀ", "ᅡ", ".", "Ｆ",
]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 16))) for _ in range(n)]


def test_pieces_equal_the_library():
    own = pieces.Encoder(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert own.in_parts
    for text in odd_texts(4000, 1):
        ids = own.encode(text)
        assert ids.tolist() == library.encode(text), repr(text)
        starts, ends = own.spans(text, ids)
        proto = library.encode(text, return_type="proto")
        for i, piece in enumerate(proto.pieces):
            if not piece.piece.startswith("<0x"):  # bytes have spans of their own here
                assert (starts[i], ends[i]) == (piece.begin, piece.end), repr(text)
        # Spans follow one another and cover the text.
        assert (starts[1:] == ends[:-1]).all()
        if len(ids):
            assert starts[0] == 0 and ends[-1] == len(text.encode())


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_normalisation_by_a_compiled_map(rule, squeeze):
    """The longest known prefix is replaced, and offsets are those of the library."""
    library = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze
    )
    spec = sentencepiece_model_pb2.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec
    own = pieces.Normaliser(spec, False, [])
    for text in odd_texts(2000, 2):
        text = text.replace("\0", "")
        want, offsets = library.normalize(text, with_offsets=True)
        got = own(text)
        assert got.data.decode() == want, repr(text)
        if want:
            edges = np.cumsum([0] + [len(c.encode()) for c in want])
            characters = [len(text.encode()[: got.source[e]].decode()) for e in edges]
            assert characters == list(offsets), repr(text)


def test_encode_decode_odd(odd_docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = pieces.encode(odd_docs, MODEL)
    texts = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    want = sorted(((i, library.encode(t)) for i, t in texts), key=str)
    assert sorted(((r["doc_id"], r["ids"]) for r in found.collect()), key=str) == want
    decoded = pieces.decode(found, MODEL).collect()
    assert sorted(map(tuple, decoded), key=str) == sorted(((i, library.decode(ids)) for i, ids in want), key=str)
    summed = pieces.round_trip(odd_docs, MODEL, with_ids=True).collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(map(tuple, summed), key=str) == sorted(
        (
            (i, len(ids), len(t.encode()), digest(",".join(map(str, ids))), digest(library.decode(ids)), ids)
            for i, t in texts
            for ids in [library.encode(t)]
        ),
        key=str,
    )
    assert pieces.encode(no_docs, MODEL).count() == 0 and pieces.round_trip(no_docs, MODEL).count() == 0


def test_words_equal_whole_texts():
    own = records.WordEncoder(WORDS)
    library = Tokenizer.from_file(WORDS)
    assert own.by_word and own.width == 2
    texts = odd_texts(4000, 3)
    for text, tokens in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(tokens, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    byte_level = records.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not byte_level.by_word
    assert np.frombuffer(byte_level.encode(["a  b"])[0], "<u2").tolist() == byte_level.tokenizer.encode("a  b").ids


def test_latin_texts_need_no_whole_encoding():
    """All characters up to U+00FF, pieces found at once: no word is given to the slower whole encoder."""
    own, library, rng = records.WordEncoder(WORDS), Tokenizer.from_file(WORDS), random.Random(7)
    letters = [chr(c) for c in range(0x100)]
    often = ["'s", "'LL", "'", "Don't", "(a", "b)c", "3rd", "É", "ß", " ", "\n", "<|", "|>"]
    texts = letters + [a + c + b for c in letters for a in ("a", "É", "7", ".", "'", " ") for b in ("b", "s", " ", "!", "2")]
    texts += ["".join(rng.choices(letters + often * 12, k=rng.randint(1, 24))) for _ in range(6000)] + ["Ab" * 40_000]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]

    class MergesOnly:
        model = own.tokenizer.model

    own.tokenizer = MergesOnly()
    for text, tokens, ids in zip(texts, own.encode(texts), want, strict=True):
        assert np.frombuffer(tokens, "<u2").tolist() == ids, repr(text)
    own = records.WordEncoder(WORDS)  # beside texts of other characters and added tokens
    for text in ("é<|endoftext|>é", "eé\u0301", "É漢", "'S"):
        want = library.encode(text, add_special_tokens=False).ids
        assert [np.frombuffer(b, "<u2").tolist() for b in own.encode([text, "É's", text])][::2] == [want, want]


def test_only_words_beyond_latin_are_encoded_whole():
    own, library, given = records.WordEncoder(WORDS), Tokenizer.from_file(WORDS), []
    text = "“Don't DON'T (a3)b 3rd café É!’ \x1c \x85 naïve… x"

    class Noted:
        model = own.tokenizer.model

        def encode_batch_fast(self, words, **how):
            given.extend(words)
            return library.encode_batch_fast(words, **how)

    own.tokenizer = Noted()
    assert np.frombuffer(own.encode([text])[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    assert sorted(given) == sorted(["“Don't", "É!’", "naïve…"])


def brute_records(rows):
    library = Tokenizer.from_file(WORDS)
    start, found = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        found.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


def test_records_round_trip(spark):
    rows = [(i * 3, t) for i, t in enumerate(odd_texts(400, 4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = records.records(docs, WORDS).collect()
    assert sorted(map(tuple, found)) == brute_records(rows)


def test_records_odd(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = sorted(map(tuple, records.records(odd_docs, WORDS).collect()), key=lambda r: r[1])
    want = brute_records(rows)
    assert [r[0] for r in found] == [r[0] for r in want]
    assert sorted(r[2:] for r in found) == sorted(r[2:] for r in want)
    assert [r[1] for r in found] == np.cumsum([0] + [r[2] for r in found[:-1]]).tolist()
    assert records.records(no_docs, WORDS).count() == 0


def test_shuffled_reads_and_damage(spark, tmp_path):
    rows = [(i, f"text {i} of many") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = str(tmp_path / "records")
    records.write_records(docs, WORDS, folder)
    assert records.read_index(spark, folder).count() == 300
    one = [r["doc_id"] for r in records.read_shuffled(spark, folder, 1).collect()]
    two = [r["doc_id"] for r in records.read_shuffled(spark, folder, 2).collect()]
    assert sorted(one) == sorted(two) == list(range(300)) and one != two != list(range(300))
    assert [r["doc_id"] for r in records.read_shuffled(spark, folder, 1).collect()] == one
    library = Tokenizer.from_file(WORDS)
    for r in records.read_shuffled(spark, folder, 1).take(3):
        assert r["ids"] == library.encode(rows[r["doc_id"]][1], add_special_tokens=False).ids + [1]
    # What a lost task left behind is in no manifest.
    (tmp_path / "records" / "part-000000-lost.rec").write_bytes(b"rubbish")
    assert records.read_records(spark, folder).count() == 300
    victim = next(p for p in (tmp_path / "records").glob("*.rec") if p.stat().st_size > 100)
    data = bytearray(victim.read_bytes())
    data[40] ^= 1
    victim.write_bytes(bytes(data))
    with pytest.raises(Exception, match="damaged"):
        records.read_records(spark, folder).collect()
