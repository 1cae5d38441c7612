"""SentencePiece encoding that keeps byte offsets, and decoding.

The text is normalised as the model says: at each place the longest prefix that
the compiled character map knows is replaced, white space is marked, and for
every byte of the result the source byte it came from is recorded.  The library
segments the text; the pieces' lengths in the normalised text then project every
piece onto a span of source bytes.  Spans follow one another and cover the text.

Segmenting a text in parts: where no piece of the vocabulary joins two
characters, a merge never crosses between them, so a BPE model segments both
sides independently.  If the vocabulary holds no piece with a word mark after
another character and none with a line feed, texts are cut there and the
segmentation of a part is remembered by the task.  Models for which this is not
so are given whole texts.

Defined cases: a null text counts as empty; an empty text has no pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from stowage.llm.common import blocks, prepared, text_of

#: Parts of texts whose pieces a task remembers, and the longest that it remembers.
MEMORY, LONGEST = 80_000, 48

_MARK = "▁"
_MARK_BYTES = _MARK.encode()
_PART = re.compile(r" +[^ \n]*|[^ \n]+|\n")
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_BPE = 2


class CharacterMap:
    """Longest-prefix replacement by a compiled character map.

    The map is a length, a double-array trie of that many bytes, and the
    replacements, each ended by a zero byte.  A unit of the trie holds a label, the
    offset to its children and a flag for a value; the value is where the
    replacement starts.
    """

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
        self.texts = compiled[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest known prefix of data[at:], and the prefix's length."""
        units, found = self.units, None
        node = self._children(units[0])
        for length, byte in enumerate(data[at:], 1):
            node ^= byte
            if node >= len(units) or units[node] & 0x800000FF != byte:
                break
            unit = units[node]
            node ^= self._children(unit)
            if unit >> 8 & 1:
                found = (units[node] & 0x7FFFFFFF, length)
        if found is None:
            return None
        start, length = found
        return self.texts[start : self.texts.index(0, start)], length

    @staticmethod
    def _children(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


@dataclass(frozen=True)
class Normalised:
    data: bytes
    #: Source byte of each byte of data, and last the length of the source.
    source: np.ndarray


class Normaliser:
    """Normalisation by a model's own rules, with alignment to the source."""

    def __init__(self, spec, suffix: bool, whole: list[bytes]):
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.mark = _MARK_BYTES if spec.escape_whitespaces else b" "
        self.suffix = suffix
        self.whole = sorted(whole, key=len, reverse=True)  # symbols that are never changed
        self.plain = not (self.map or self.squeeze or self.suffix or self.whole)

    def _next(self, data: bytes, at: int) -> tuple[bytes, int]:
        for symbol in self.whole:
            if data.startswith(symbol, at):
                return symbol, len(symbol)
        found = self.map.longest(data, at) if self.map else None
        if found:
            return found
        first = data[at]
        length = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return data[at : at + length], length

    def __call__(self, text: str) -> Normalised:
        data = text.encode("utf-8")
        if self.plain:
            return self._aligned(data)
        out, source = bytearray(), []
        at = 0
        if self.squeeze:
            while at < len(data):
                piece, length = self._next(data, at)
                if piece != b" ":
                    break
                at += length
        if at == len(data):
            return Normalised(b"", np.array([len(data)]))
        if self.prefix and not self.suffix:
            out += self.mark
            source += [at] * len(self.mark)
        after_space = self.squeeze
        while at < len(data):
            piece, length = self._next(data, at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                for byte in piece:
                    new = self.mark if byte == 0x20 else bytes((byte,))
                    out += new
                    source += [at] * len(new)
                after_space = self.squeeze and piece.endswith(b" ")
            at += length
        if self.squeeze:
            while out.endswith(self.mark) and len(out) > 0:
                del out[-len(self.mark) :]
                at = source[-len(self.mark)]
                del source[-len(self.mark) :]
        if self.prefix and self.suffix:
            out += self.mark
            source += [at] * len(self.mark)
        return Normalised(bytes(out), np.array([*source, at]))

    def _aligned(self, data: bytes) -> Normalised:
        """Only spaces change: each becomes a mark."""
        if not data:
            return Normalised(b"", np.zeros(1, np.int64))
        width = np.where(np.frombuffer(data, np.uint8) == 0x20, len(self.mark), 1)
        lead = len(self.mark) if self.prefix else 0
        source = np.concatenate([np.zeros(lead, np.int64), np.repeat(np.arange(len(data)), width), [len(data)]])
        return Normalised(self.mark * bool(lead) + data.replace(b" ", self.mark), source)


class Encoder:
    """A model, loaded once a task."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        spec = proto.normalizer_spec
        pieces = [(p.piece, p.type) for p in proto.pieces]
        self.normalise = Normaliser(
            spec, proto.trainer_spec.treat_whitespace_as_suffix, [p.encode() for p, kind in pieces if kind == _USER]
        )
        #: Bytes of each piece in the normalised text; -1 where the text decides.
        self.width = np.array([1 if k == _BYTE else len(p.encode()) if k == _NORMAL or k == _USER else -1 for p, k in pieces])
        normal = [p for p, kind in pieces if kind in (_NORMAL, _USER)]
        self.in_parts = (
            proto.trainer_spec.model_type == _BPE
            and self.normalise.plain
            and spec.add_dummy_prefix
            and spec.escape_whitespaces
            and proto.trainer_spec.byte_fallback
            and not any("\n" in p or " " in p or re.search(f"[^{_MARK}]{_MARK}", p) for p in normal)
        )
        if self.in_parts:
            proto.normalizer_spec.add_dummy_prefix = False
            self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        # Ids of parts as decimals; what was used since the last change of
        # generation, and what was used before it.
        self.memory: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def _remembered(self, parts: set[str]) -> dict[str, str]:
        """Decimal ids of parts of texts."""
        known, new = {}, []
        for part in parts:
            ids = self.memory.get(part)
            if ids is None:
                ids = self.older.get(part)
                if ids is None:
                    new.append(part)
                    continue
                self.memory[part] = ids
            known[part] = ids
        for part, ids in zip(new, self.bare.encode(new, num_threads=1) if new else (), strict=True):
            known[part] = text = ",".join(map(str, ids))
            if len(part) <= LONGEST:
                self.memory[part] = text
        if len(self.memory) > MEMORY:
            self.older, self.memory = self.memory, {}
        return known

    def decimals(self, texts: list[str]) -> list[str]:
        """Ids of each text, in decimal, joined by commas."""
        parts = [_PART.findall(" " + t) if t and self.in_parts and _MARK not in t else None for t in texts]
        known = self._remembered({p for found in parts if found for p in found})
        return [
            ",".join([known[p] for p in found]) if found else ",".join(map(str, self.processor.encode(text)))
            for text, found in zip(texts, parts, strict=True)
        ]

    def encode(self, text: str) -> np.ndarray:
        return self.ids(self.decimals([text])[0])

    @staticmethod
    def ids(decimals: str) -> np.ndarray:
        return np.fromstring(decimals, np.int32, sep=",") if decimals else np.zeros(0, np.int32)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every piece in the bytes of the text."""
        normal = self.normalise(text)
        width = self.width[ids]
        if (width < 0).any():  # unknown characters: the pieces tell their own text
            width = np.array([len(p.encode()) for p in self.processor.encode(text, out_type=str)])
        edges = np.concatenate([[0], np.cumsum(width)])
        if edges[-1] != len(normal.data):
            raise ValueError("pieces do not cover the normalised text")
        return normal.source[edges[:-1]], normal.source[edges[1:]]

    def decode(self, ids: np.ndarray) -> str:
        return self.processor.decode(ids.tolist())


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    prepared(docs.sparkSession)
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(F.col(f"`{text_col}`")).alias("body"))
    return narrow, narrow.schema["doc_id"].dataType.simpleString()


def _lists(values: list[np.ndarray]) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values).astype(np.int32) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends): the pieces of every text and their spans of source bytes."""
    narrow, kind = _narrow(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(model)
        for batch, texts in blocks(batches, "body"):
            ids = [own.ids(d) for d in own.decimals(texts)]
            spans = [own.spans(t, i) for t, i in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _lists(ids), _lists([s for s, _ in spans]), _lists([e for _, e in spans])],
                names=["doc_id", "ids", "starts", "ends"],
            )

    return narrow.mapInArrow(run, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from arrays of ids; a null array counts as empty."""
    prepared(encoded.sparkSession)
    narrow = encoded.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>")).alias("ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(model)
        for batch in batches:
            texts = own.processor.decode(batch.column("ids").to_pylist(), num_threads=1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Encode and decode every text in one pass and sum up both.

    doc_id, n_tokens, span_bytes (source bytes that the spans cover), ids_sha256
    (of decimal ids joined by commas), decoded_sha256, and the ids if asked for.
    """
    narrow, kind = _narrow(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(model)
        for batch, texts in blocks(batches, "body"):
            encoded = [(own.ids(d), d) for d in own.decimals(texts)]
            covered = []
            for text, (ids, _) in zip(texts, encoded, strict=True):
                starts, ends = own.spans(text, ids)
                covered.append(int((ends - starts).sum()))
            decoded = [own.decode(ids) for ids, _ in encoded]
            columns = [
                batch.column("doc_id"),
                pa.array([len(ids) for ids, _ in encoded], pa.int64()),
                pa.array(covered, pa.int64()),
                pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in encoded]),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decoded]),
            ]
            names = ["doc_id", "n_tokens", "span_bytes", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(_lists([ids for ids, _ in encoded]))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, n_tokens long, span_bytes long, ids_sha256 string, decoded_sha256 string"
    return narrow.mapInArrow(run, schema + ", ids array<int>" * with_ids)
