"""Fill-in-middle by content-defined chunk memoization.

A text is counted in tokens: a run of ASCII letters, or one other code point.  Two
token positions, drawn from a hash of the document's id, cut it into prefix, middle
and suffix, which are written in prefix-suffix-middle or suffix-prefix-middle order.

Counting goes by chunks.  A rolling hash over the text's bytes ends a chunk where
its upper bits are zero, so equal passages are cut alike wherever they stand, and
most chunks of a copied passage have been met before.  A task remembers chunks by
their content (a dictionary of bytes: the hash finds an entry, the bytes verify it)
with their boundary summary: tokens, code points, and whether the chunk begins and
ends with a letter.  Summaries combine: where one chunk ends with a letter and the
next begins with one, the run goes on and one token less starts.  Running counts
locate the chunk in which a cut falls, and only that chunk is scanned.

Nothing is shuffled.  The memory of a task is bounded by MEMORY_BYTES twice.

Defined cases: a null text counts as empty and is plain, as are texts that hold one
of the markers.  A null id is hashed as an empty one.  Repeated rows get equal
answers, each its own.  A text of any length is cut into chunks of LONGEST bytes at
most.  Columns beside id and text are not read.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import blocks, prepared, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents so many stay plain, and of a hundred others so many put the suffix first.
PLAIN_OF_100, SUFFIX_FIRST_OF_100 = 10, 20
SEED = 1
#: Bytes that the rolling hash sees; chunks are no shorter, but for the last of a text.
WINDOW = 32
#: A chunk ends where so many upper bits of the hash are zero, and at LONGEST bytes.
END_BITS, LONGEST = 8, 4096
#: A task remembers chunks of so many bytes, and as many of those it remembered before.
MEMORY_BYTES = 32 << 20

_GEAR = np.random.default_rng(20_250_301).integers(0, 1 << 32, 256, np.uint32)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True

Summary = tuple[int, int, bool, bool]


def ends_of_chunks(raw: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of texts that lie side by side in raw, text by text.

    starts: where each text starts, and the end of the last.  No chunk ends inside a
    code point, and no end depends on a neighbouring text.
    """
    rolled = _GEAR[raw]
    reach = 1
    while reach < WINDOW:
        rolled[reach:] = rolled[reach:] + (rolled[:-reach] << np.uint32(reach))
        reach *= 2
    at = np.flatnonzero(rolled >> np.uint32(32 - END_BITS) == 0) + 1
    at = at[at < len(raw)]
    inside = (raw & 0xC0) == 0x80
    candidates = at[~inside[at]].tolist()
    found = []
    for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        ends, last = [], start
        i = bisect_left(candidates, start + WINDOW)
        while last < stop:
            end = candidates[i] if i < len(candidates) else stop
            if end - last > LONGEST:
                end = last + LONGEST
                while inside[end] and end > last + LONGEST - 4:  # a code point has four bytes at most
                    end -= 1
            last = min(end, stop)
            ends.append(last)
            i = bisect_left(candidates, last + WINDOW, i)
        found.append(ends)
    return found


def _token_starts(chunk: bytes) -> np.ndarray:
    """Where the tokens of a chunk start, in bytes, taken alone."""
    raw = np.frombuffer(chunk, np.uint8)
    letter = _LETTER[raw]
    starts = (raw & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(starts)


def summaries(chunks: list[bytes]) -> list[Summary]:
    """(tokens, code points, begins with a letter, ends with a letter) of each chunk."""
    if not chunks:
        return []
    edges = np.cumsum([0, *map(len, chunks)])
    raw = np.frombuffer(b"".join(chunks), np.uint8)
    letter = _LETTER[raw]
    point = (raw & 0xC0) != 0x80
    goes_on = np.zeros(len(raw), bool)
    goes_on[1:] = letter[1:] & letter[:-1]
    goes_on[edges[:-1]] = False
    tokens = np.add.reduceat(point & ~goes_on, edges[:-1], dtype=np.int64)
    points = np.add.reduceat(point, edges[:-1], dtype=np.int64)
    return list(
        zip(tokens.tolist(), points.tolist(), letter[edges[:-1]].tolist(), letter[edges[1:] - 1].tolist(), strict=True)
    )


class ChunkMemory:
    """Summaries of chunks by content; the older half is forgotten when it is full."""

    def __init__(self, most_bytes: int = MEMORY_BYTES):
        self.most_bytes, self.held = most_bytes, 0
        self.young: dict[bytes, Summary] = {}
        self.old: dict[bytes, Summary] = {}

    def look_up(self, chunks: list[bytes]) -> dict[bytes, Summary]:
        """The summaries of chunks; those not remembered are computed together."""
        known, new = {}, []
        for chunk in set(chunks):
            found = self.young.get(chunk)
            if found is None:
                found = self.old.get(chunk)
                if found is None:
                    new.append(chunk)
                    continue
                self._keep(chunk, found)
            known[chunk] = found
        for chunk, found in zip(new, summaries(new), strict=True):
            known[chunk] = found
            self._keep(chunk, found)
        return known

    def _keep(self, chunk: bytes, found: Summary) -> None:
        self.young[chunk] = found
        self.held += len(chunk)
        if self.held > self.most_bytes:
            self.old, self.young, self.held = self.young, {}, 0


class Counted:
    """Tokens and code points of a text, added up from its chunks."""

    def __init__(self, chunks: list[bytes], known: dict[bytes, Summary]):
        found = [known[c] for c in chunks]
        self.chunks = chunks
        #: A chunk that goes on with the run of letters of the one before starts one token less.
        self.joined = [False, *(a[3] and b[2] for a, b in zip(found, found[1:], strict=False))]
        self.before = [0, *accumulate(s[0] - j for s, j in zip(found, self.joined, strict=False))]
        self.points_before = [0, *accumulate(s[1] for s in found)]
        self.bytes_before = [0, *accumulate(map(len, chunks))]
        self.n = self.before[-1]

    def place(self, token: int) -> tuple[int, int]:
        """(byte, code point) at which a token starts; the text's end for the token after the last."""
        if token >= self.n:
            return self.bytes_before[-1], self.points_before[-1]
        # The last chunk with no more than that many tokens before it: chunks that start none lie before.
        i = bisect_left(self.before, token + 1) - 1
        inside = int(_token_starts(self.chunks[i])[token - self.before[i] + self.joined[i]])
        points = len(self.chunks[i][:inside].decode("utf-8", "replace"))
        return self.bytes_before[i] + inside, self.points_before[i] + points


@functools.lru_cache(maxsize=1)
def chunk_memory() -> ChunkMemory:
    """One a Python worker, so that it outlives a batch."""
    return ChunkMemory()


def count_tokens(texts: list[bytes], memory: ChunkMemory) -> list[Counted]:
    starts = np.cumsum([0, *map(len, texts)])
    joined = b"".join(texts)
    ends = ends_of_chunks(np.frombuffer(joined, np.uint8), starts) if joined else [[] for _ in texts]
    cut = [
        [joined[a:b] for a, b in zip([start, *found[:-1]], found, strict=True)] if found else []
        for start, found in zip(starts[:-1].tolist(), ends, strict=True)
    ]
    known = memory.look_up([c for chunks in cut for c in chunks])
    return [Counted(chunks, known) for chunks in cut]


def _drawn(id_col: str, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the document's id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    plain_of_100: int = PLAIN_OF_100,
    suffix_first_of_100: int = SUFFIX_FIRST_OF_100,
) -> DataFrame:
    """One row a row of docs: doc_id, n, form, prefix_chars, middle_chars, output.

    n counts tokens; form is plain, psm or spm; lengths are code points, null if plain.
    """
    prepared(docs.sparkSession)
    narrow = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), text_of(F.col(f"`{text_col}`")).cast("binary").alias("body"), *_drawn(id_col, seed)
    )
    markers = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = markers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = chunk_memory()
        for batch, texts in blocks(batches, "body"):
            drawn = [batch.column(f"h{i}").to_pylist() for i in range(1, 5)]
            rows = []
            for text, counted, h1, h2, h3, h4 in zip(texts, count_tokens(texts, memory), *drawn, strict=True):
                n = counted.n
                if not text or h3 % 100 >= 100 - plain_of_100 or any(marker in text for marker in markers):
                    rows.append((n, "plain", None, None, text))
                    continue
                first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
                (a, a_points), (b, b_points) = counted.place(first), counted.place(last)
                if h4 % 100 < suffix_first_of_100:
                    form, parts = "spm", (s, text[b:], p, text[:a], m, text[a:b])
                else:
                    form, parts = "psm", (p, text[:a], s, text[b:], m, text[a:b])
                rows.append((n, form, a_points, b_points - a_points, b"".join(parts)))
            n, form, prefix, middle, output = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(form, pa.string()),
                    pa.array(prefix, pa.int64()),
                    pa.array(middle, pa.int64()),
                    pa.array(output, pa.binary()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary"
    return narrow.mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def restored(form: Column, output: Column) -> Column:
    """The original text.  No part holds a marker, so the first of each kind is the one written."""
    marked = len(PREFIX)
    rest = lambda at: F.substr(output, at + marked)
    between = lambda start, stop: F.substr(output, start, stop - start)
    suffix_at, prefix_at, middle_at = (F.position(F.lit(x), output) for x in (SUFFIX, PREFIX, MIDDLE))
    first = F.lit(1 + marked)
    return (
        F.when(form == "psm", F.concat(between(first, suffix_at), rest(middle_at), between(suffix_at + marked, middle_at)))
        .when(form == "spm", F.concat(between(prefix_at + marked, middle_at), rest(middle_at), between(first, prefix_at)))
        .otherwise(output)
    )
