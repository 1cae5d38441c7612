"""Token ids as length-delimited binary records with a separate offset index.

A data file is a row of frames, one a sequence:

    8 bytes   length of the payload, little-endian
    4 bytes   masked checksum of those 8 bytes
    payload
    4 bytes   masked checksum of the payload

The checksum is CRC-32, masked by rotating it right by 15 bits and adding a
constant, so that a checksum of data that holds checksums is no weaker.  The
payload is the sequence's id (8 bytes, and one byte that says if it is null), one
byte for the width of a token, and the tokens, little-endian, in 2 bytes where
the vocabulary allows it, else in 4.

The index file beside it holds the offset of every frame and the end, 8 bytes
each, so that a reader in shuffled order fetches any record without scanning.

Files hold ranges of ids, in order.  A task writes its own file under a name of
its own; the manifest, a table, names the files of the tasks that succeeded.
What a lost or repeated task left behind is named nowhere.

Splitting words: in a text of Latin-1 characters nothing composes and letters lower-case
one by one, so one pattern finds the pieces that the vocabulary's rules split, and a
task remembers their tokens.  In other texts the rules still drop white space and never
match across it: words are encoded independently and remembered, those of Latin-1
characters by their pieces.  Tokenizers of other rules are given whole texts.

Defined cases: a null text counts as empty; its sequence is the end token alone.
Null ids come first.  Rows that share an id follow each other by a hash of their
texts; equal rows are equal sequences.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.llm.common import blocks, fresh_folder, prepared, text_of
from stowage.llm.files import open_folder

#: Words and pieces of words that a task remembers, twice over and those of a block more; none longer than LONGEST.
MEMORY, PIECES, LONGEST = 600_000, 500_000, 48
END_ID = 1
#: The only splitting rule for which words are known to be independent (fixed value).
WORDWISE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_WORD = re.compile(r"[^ \n]+")
#: What str.split takes for white space and the vocabulary's rules do not.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: The pieces of WORDWISE_SPLIT in lower-cased text of Latin-1 characters; endings before marks, letters first for speed.
_LATIN = re.compile(
    "[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|'(?:s|t|re|ve|m|ll|d)"
    "|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
)
_LENGTH, _CHECK, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<q?B")
#: Letters of two bytes as the vocabulary writes bytes that are no printed character: shifted out of their way.
_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHIFTED = dict(zip([b for b in range(256) if b not in _BYTES], range(256, 512), strict=False))
_AS_BYTES = {c: "".join(chr(_SHIFTED.get(b, b)) for b in chr(c).encode()) for c in range(0x100)}
MANIFEST = "part int, file string, index string, records long, tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = _LENGTH.pack(len(payload))
    return b"".join((length, _CHECK.pack(masked(length)), payload, _CHECK.pack(masked(payload))))


def read_frame(file) -> bytes | None:
    """The next payload of an open file; None at its end."""
    head = file.read(12)
    if not head:
        return None
    if len(head) < 12 or _CHECK.unpack_from(head, 8)[0] != masked(head[:8]):
        raise ValueError("damaged length of a record")
    (length,) = _LENGTH.unpack_from(head)
    body = file.read(length + 4)
    if len(body) < length + 4 or _CHECK.unpack_from(body, length)[0] != masked(body[:length]):
        raise ValueError("damaged record")
    return body[:length]


def pack(doc_id: int | None, tokens: bytes, width: int) -> bytes:
    return _HEAD.pack(doc_id or 0, doc_id is None, width) + tokens


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = _HEAD.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=_HEAD.size)


class WordEncoder:
    """A tokenizer, loaded once a task, that remembers the tokens of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        steps = (rules.get("normalizer") or {}).get("normalizers", [])
        splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = (
            [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and steps[1]["pattern"] == {"Regex": r"\s+"}
            and [s["type"] for s in splits] == ["Split", "ByteLevel"]
            and splits[0]["pattern"] == {"Regex": WORDWISE_SPLIT}
            and splits[0]["behavior"] == "Removed"
            and splits[0]["invert"]
            and not splits[1]["add_prefix_space"]
            and not any(
                re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["normalized"] for t in rules["added_tokens"]
            )
        )
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.added = [t["content"] for t in rules["added_tokens"]]
        self.encoded = [self._bytes([i]) for i in range(self.tokenizer.get_vocab_size())] if self.by_word else []
        self.words, self.pieces = Memory(MEMORY), Memory(PIECES)

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The tokens of each text as little-endian integers."""
        if not self.by_word:
            return [self._bytes(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        plain = [self._is_latin(t) for t in texts]
        found = [_LATIN.findall(t.lower()) for t, p in zip(texts, plain, strict=True) if p]
        known = self.pieces.with_all(set().union(*found), self._pieces)
        latin = iter([b"".join(map(known.__getitem__, pieces)) for pieces in found])
        rest = [t for t, p in zip(texts, plain, strict=True) if not p]
        others = iter(self._in_words(rest) if rest else ())
        return [next(latin) if p else next(others) for p in plain]

    def _is_latin(self, text: str) -> bool:
        """Latin-1 characters alone, and no token that is looked for before all rules."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        return not any(t in text for t in self.added)

    def _in_words(self, texts: list[str]) -> list[bytes]:
        words = [_WORD.findall(t) if any(c in t for c in _NOT_SPACE) else t.split() for t in texts]
        known = self.words.with_all(set().union(*words), self._words)
        return [b"".join(map(known.__getitem__, found)) for found in words]

    def _words(self, words: list[str]) -> list[bytes]:
        """Words of Latin-1 characters by their pieces, the others as the tokenizer encodes them."""
        parts = [_LATIN.findall(w.lower()) if self._is_latin(w) else None for w in words]
        pieces = self.pieces.with_all(set().union(*filter(None, parts)), self._pieces)
        others = [w for w, found in zip(words, parts, strict=True) if found is None]
        whole = iter(self.tokenizer.encode_batch_fast(others, add_special_tokens=False))
        return [self._bytes(next(whole).ids) if found is None else b"".join(map(pieces.__getitem__, found)) for found in parts]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """What no rule changes or splits goes to the vocabulary's merges at once."""
        merge = self.tokenizer.model.tokenize
        shown = [p if p.isascii() and p.isprintable() else p.translate(_AS_BYTES) for p in pieces]
        return [b"".join([self.encoded[token.id] for token in merge(p)]) for p in shown]


class Memory:
    """Tokens by string; the older half is forgotten when it is full."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []

    def with_all(self, strings: set[str], encode: Callable[[list[str]], list[bytes]]) -> dict[str, bytes]:
        """A dictionary that holds the tokens of all strings; what is not remembered is encoded."""
        for string in self.long:
            self.young.pop(string, None)
        if len(self.young) > self.most:
            self.old, self.young = self.young, {"": b""}
        young, old = self.young, self.old
        absent = strings.difference(young)
        new = []
        for string in absent:
            ids = old.get(string)
            if ids is None:
                new.append(string)
            else:
                young[string] = ids
        young.update(zip(new, encode(new), strict=True))
        self.long = [s for s in new if len(s) > LONGEST]
        return young


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_records(
    docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID
) -> DataFrame:
    """Encode every text and write its record, in order of ids; the manifest of the files."""
    spark = prepared(docs.sparkSession)
    body = text_of(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(body).alias("tie"), body.alias("body"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_encoder(tokenizer)
        end = b"" if end_id is None else own._bytes([end_id])
        store, path = open_folder(folder)
        store.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        offsets, at, n_tokens = [], 0, 0
        with store.open_output_stream(f"{path}/{name}.rec") as out:
            for batch, texts in blocks(batches, "body"):
                framed = []
                for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), own.encode(texts), strict=True):
                    framed.append(frame(pack(doc_id, tokens + end, own.width)))
                    offsets.append(at)
                    at += len(framed[-1])
                    n_tokens += (len(tokens) + len(end)) // own.width
                out.write(b"".join(framed))
        with store.open_output_stream(f"{path}/{name}.idx") as out:
            out.write(np.array([*offsets, at], "<u8").tobytes())
        if offsets:
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "file": f"{name}.rec", "index": f"{name}.idx", "records": len(offsets), "tokens": n_tokens}],
                pa.schema([("part", pa.int32()), ("file", pa.string()), ("index", pa.string()), ("records", pa.int64()), ("tokens", pa.int64())]),
            )

    ordered.select("doc_id", "body").mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _one_a_task(manifest: DataFrame) -> DataFrame:
    """About one file a task; the manifest has a row a file."""
    return manifest.repartition(max(1, manifest.count()), "file")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, checksums verified.

    start: tokens of all records before; ids_crc32: unsigned CRC-32 of the tokens
    as little-endian unsigned 32-bit integers.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    manifest = read_manifest(spark, folder).withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_folder(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20) as file:
                    rows: list[tuple] = []
                    while (payload := read_frame(file)) is not None:
                        doc_id, tokens = unpack(payload)
                        rows.append((doc_id, start, len(tokens), zlib.crc32(tokens.astype("<u4").tobytes())))
                        start += len(tokens)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    return _one_a_task(manifest.select("file", "base")).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"]
    )


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(file, record, offset, length) of every frame, from the index files alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_folder(folder)
        for batch in batches:
            for file, index in zip(batch.column("file").to_pylist(), batch.column("index").to_pylist(), strict=True):
                with store.open_input_stream(f"{path}/{index}") as opened:
                    offsets = np.frombuffer(opened.read(), "<u8").astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file] * (len(offsets) - 1)),
                        pa.array(np.arange(len(offsets) - 1)),
                        pa.array(offsets[:-1]),
                        pa.array(np.diff(offsets)),
                    ],
                    names=["file", "record", "offset", "length"],
                )

    return _one_a_task(read_manifest(spark, folder).select("file", "index")).mapInArrow(
        read, "file string, record long, offset long, length long"
    )


def read_shuffled(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """(doc_id, ids) of all records in an order that the seed decides.

    Only index rows are shuffled; each task then fetches its records by offset.
    """
    order = F.xxhash64("file", "record", F.lit(seed))
    shuffled = read_index(spark, folder).repartitionByRange(order).sortWithinPartitions(order)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_folder(folder)
        opened: dict = {}
        for batch in batches:
            rows = []
            for name, offset in zip(batch.column("file").to_pylist(), batch.column("offset").to_pylist(), strict=True):
                if name not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    opened[name] = store.open_input_file(f"{path}/{name}")
                opened[name].seek(offset)
                rows.append(unpack(read_frame(opened[name])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].tolist() for r in rows], pa.list_(pa.int64()))],
                names=["doc_id", "ids"],
            )

    return shuffled.select("file", "offset").mapInArrow(fetch, "doc_id long, ids array<long>")


def records(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write all records to a new shared folder and read them back."""
    folder = fresh_folder(docs.sparkSession, "token-records")
    write_records(docs, tokenizer, folder, id_col, text_col, end_id)
    return read_records(docs.sparkSession, folder)
